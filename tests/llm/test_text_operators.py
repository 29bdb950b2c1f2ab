"""Quality, decontamination, secrets, pieces and repeats against plain versions, and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHES, docs_of, odd_rows, prose, words
from pyspark.sql import functions as F

from dnslake.llm import decontaminate, pieces, quality, secrets, substrings, textops

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# -- helpers ------------------------------------------------------------------------------------

def test_word_and_window_hashes_follow_their_words():
    texts = ["Aa bb aa bb", "", "bb aa bb", "x", "aa  bb"]
    found = textops.Words(*textops.flat(pa.array(texts)), textops.lut_alnum_lower())
    assert found.counts.tolist() == [4, 0, 3, 1, 2]
    assert found.hash[0] == found.hash[2] == found.hash[5] and found.hash[0] != found.hash[1]
    at, code = found.windows(2)
    assert at.tolist() == [0, 1, 2, 4, 5, 8] and code[0] == code[2] == code[4] == code[5] and code[1] == code[3]


def test_block_sums_equal_whole_sums():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 256, 200_003).astype(np.uint8)
    at = np.unique(np.concatenate([rng.integers(0, 200_004, 500), [0, 65_536, 131_072, 200_003]]))
    base = 0x9E3779B97F4A7C15
    whole = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code.astype(np.uint64) * textops.powers(base, len(code))[:len(code)], out=whole[1:])
    assert np.array_equal(textops.sums_at(code, base, at), whole[at])
    assert np.array_equal(textops.powers_at(base, at), textops.powers(base, 200_003)[at])


# -- quality ------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(documents, labels):
    model = quality.train(documents, labels)
    got = (quality.score_documents(documents, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
           .select("doc_id", "score", "predicted", "quality").collect())
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and len(got) > 40
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_quality_odd_rows(spark, documents, labels):
    docs = docs_of(spark, odd_rows())
    model = quality.train(documents, labels)
    scored = quality.score_documents(docs.select("doc_id", "text"), model).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    empty = {r.score for r in scored if not r.text}
    assert len(empty) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r[c] for r in kept.collect() for c in ["score", "predicted"]} <= {"score", "predicted"}


def test_quality_without_labels(spark, labels):
    docs = docs_of(spark, odd_rows())
    got = quality.score_documents(docs, quality.train(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in got] == [0.5]
    assert quality.score_documents(docs.limit(0), quality.Model()).count() == 0


# -- decontamination ----------------------------------------------------------------------------

def plain_scan(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i:i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def case(seed):
    rng = random.Random(seed)
    items = [(i, prose(1000 + i, rng.choice([1, 4, 12, 13, 14, 40]))) for i in range(12)]
    items += [(None, prose(1, 30)), (50, None), (51, ""), (3, items[0][1]), (52, items[5][1].upper())]
    docs = list(odd_rows())
    for k in range(25):
        w = prose(k, rng.randint(0, 300)).split()
        for _ in range(rng.randint(0, 3)):
            source = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(source))
            at = rng.randint(0, len(w))
            w[at:at] = source[a: a + rng.randint(1, 30)]
        docs.append((100 + k, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 600])
def test_scan_equals_plain_scan(spark, block_bytes):
    docs, items = case(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs_of(spark, docs).select("doc_id", "text"), bench, block_bytes=block_bytes)
    rows = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(plain_scan(docs, items), key=str)


def test_remove_documents_and_spans(spark):
    docs, items = case(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs_of(spark, docs)
    bad = {r[0] for r in plain_scan(docs, items) if r[4]}
    kept = decontaminate.remove_documents(frame, bench)
    assert kept.columns == frame.columns and {r["items"] for r in kept.collect()} == {"items"}
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad
    cut = decontaminate.remove_spans(frame, bench)
    assert cut.columns == frame.columns and cut.count() == len(docs)
    left = {r.doc_id: r.text for r in cut.collect()}
    hits = {r[0]: r[1] - r[2] for r in plain_scan(docs, items)}
    assert all(len(words(left[d])) == hits[d] for d in left if d is not None)
    assert decontaminate.scan(frame.limit(0), bench).count() == 0
    assert decontaminate.scan(frame, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


# -- secrets ------------------------------------------------------------------------------------

def plain_spans(text):
    text, out = text or "", []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(["assign", "access", "hex"][k], a, b) for a, k, b in sorted(out)]


def secret_rows():
    rng = random.Random(5)
    token = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    hexs, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = list(odd_rows())
    rows += [(20, "é token=secret: abcdefghi"), (21, "PassWord : 'abcdefgh' apiKey=\"12345678\" api_key=1234567"),
             (22, f"x AKIA{token(11, 'ABC0')} AKIA{token(12, 'ABC0')}"), (23, token(31, hexs) + "g" + token(40, hexs)),
             (24, "toKen=12345678 \u212aey to\u212aen=12345678"), (25, "deadbeef" * 4 + " secret=" + "a" * 8)]
    rows += [(100 + k, f"{prose(k, 9)} \U0001F511 {token(40, mixed)} {prose(k + 50, 5)} {'thhereadingonthersation' * 2}") for k in range(60)]
    return rows


def test_secrets_equal_plain_patterns(spark):
    rows = secret_rows()
    got = secrets.find_secrets(docs_of(spark, rows).select("doc_id", "text")).collect()
    base = sorted([(r.doc_id, r.text, [(s.kind, s.start, s.end) for s in r.spans if s.kind != "random"]) for r in got], key=str)
    assert base == sorted([(i, t, plain_spans(t)) for i, t in rows], key=str)
    for r in got:
        assert [(s.start, secrets.KINDS.index(s.kind)) for s in r.spans] == sorted((s.start, secrets.KINDS.index(s.kind)) for s in r.spans)
    random_spans = [r.text[s.start: s.end] for r in got if r.doc_id and r.doc_id >= 100 for s in r.spans if s.kind == "random"]
    found = [t for t in random_spans if any(c.isdigit() for c in t)]
    assert len(found) >= 57 and not any("thhereading" in t for t in random_spans)


def test_battery_separates_random_from_words():
    rng = np.random.default_rng(2)
    drawn = [secrets.p_random(np.frombuffer(bytes(rng.choice(list(b"0123456789abcdef"), 40).tolist()), np.uint8), 1) for _ in range(400)]
    assert 0.3 < np.mean(drawn) < 0.7 and np.mean(np.array(drawn) < 0.01) < 0.05
    word = np.frombuffer(b"internationalisationofthe", np.uint8)
    assert secrets.p_random(word, secrets.infer(word)) < 0.01


def test_cuts_follow_the_share_of_random_runs():
    bins = np.full(secrets.BINS, 20)
    assert secrets.cuts({(1, 1): bins})[1, 1] == 0.0
    mixed = bins.copy()
    mixed[0] += 5000
    assert 0 < secrets.cuts({(1, 1): mixed})[1, 1] < 0.1
    words_only = np.zeros(secrets.BINS, int)
    words_only[0] = 900
    assert secrets.cuts({(1, 1): words_only})[1, 1] == 2.0


def test_a_copied_run_is_one_test(spark):
    rng = np.random.default_rng(31)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(300)]
    words = [("ab" * 40)[k: k + 36 + k % 2] for k in (0, 1)] + ["abcdefab" + "ba" * k for k in range(12, 17)]
    by_p = {r: secrets.p_random(np.frombuffer(r.encode(), np.uint8), 1) for r in hexes}
    hot = min(hexes, key=lambda r: abs(by_p[r] - 0.7))
    rows = list(enumerate([*hexes, *words]))
    docs = docs_of(spark, rows + [(1000 + k, "see " + hot) for k in range(len(rows) // 2)]).select("doc_id", "text")
    once, all_ = secrets.count_p(docs.where("doc_id < 1000")), secrets.count_p(docs.repartition(5))
    assert once.keys() == all_.keys() and all((once[k] == all_[k]).all() for k in once)
    assert sum(int(v.sum()) for v in once.values()) == len({*hexes, *words})
    spans = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in secrets.find_secrets(docs).collect()}
    assert all(spans[i] for i, r in rows if by_p.get(r, 0) > 0.1) and all(spans[1000 + k] for k in range(len(rows) // 2))


def test_redact(spark):
    docs = docs_of(spark, secret_rows())
    done = secrets.redact(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    for r in done.collect():
        assert r.spans == "spans" and not plain_spans(r.text) and (r.text is None or r.n_chars == len(r.text))
    assert secrets.redact(docs.limit(0)).count() == 0


# -- pieces -------------------------------------------------------------------------------------

def odd_texts():
    return [t for _, t in odd_rows()] + [" a  b ", "ab" * 300 + " " + "é" * 90, "日本語 テキスト", prose(3, 400), "\n\n\tx", " " * 70]


def test_pieces_without_dropout_are_those_of_the_library():
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    texts = [t or "" for t in odd_texts()]
    ids, offs = model.encode(pa.array(texts), np.arange(len(texts)), 0.0, 8, 1)
    assert model.decode(ids, offs) == texts
    for k, text in enumerate(texts):
        if "\u2581" not in text:
            assert ids[offs[k]: offs[k + 1]].tolist() == library.encode(text)


def test_heap_and_matrix_agree(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    texts = prose(9, 300).split() + ["", "internationalisation"]
    keys = np.arange(len(texts))
    one = model.encode(pa.array(texts), keys, 0.3, 4, 9)
    monkeypatch.setattr(pieces, "MATRIX", 0)
    monkeypatch.setattr(pieces, "_WIDTHS", ())
    model._forget(-1.0)
    two = model.encode(pa.array(texts), keys, 0.3, 4, 9)
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])


def test_every_occurrence_draws_anew(spark):
    words_ = ["internationalisation", "of", "the", "reading"]
    docs = docs_of(spark, [(k, " ".join(words_ * 10)) for k in range(100)])
    rows = pieces.encode(docs).collect()
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    whole = {w: tuple(model.encode(pa.array([w]), np.arange(1), 0.0, None, 1)[0].tolist()) for w in words_}
    starts = {w: model.bytes[model.start[whole[w][0]]] for w in words_}
    assert set(starts.values()) == {0x20}
    seen = {w: [] for w in words_}
    for r in rows:
        at, now = 0, []
        for piece in [*r.pieces, None]:
            if now and (piece is None or model.bytes[model.start[piece]] == 0x20):
                seen[words_[at % 4]].append(tuple(now))
                at, now = at + 1, []
            now.append(piece)
        assert at == 40
    assert len(set(seen["internationalisation"])) > 40  # 8 before
    for w in ("of", "the"):  # one or two merges or more, each dropped at a tenth of the occurrences
        share = sum(x != whole[w] for x in seen[w]) / len(seen[w])
        assert 0.07 < share < 0.35 and len(set(seen[w])) > 1


def test_dropout_varies_and_decodes(spark):
    docs = docs_of(spark, list(enumerate(odd_texts())))
    made = pieces.decode(pieces.encode(docs, dropout=0.3))
    rows = made.collect()
    assert all(r.decoded == (r.text or "") and r.n_pieces == len(r.pieces) and r.node == "node" for r in rows)
    again = {r.doc_id: r.pieces for r in pieces.encode(docs.repartition(3), dropout=0.3).collect()}
    assert all(again[r.doc_id] == r.pieces for r in rows)
    other = {r.doc_id: r.pieces for r in pieces.encode(docs, dropout=0.3, seed=2).collect()}
    whole = {r.doc_id: r.pieces for r in pieces.encode(docs, dropout=0.0).collect()}
    long_ones = [r for r in rows if r.text and len(r.text.split()) > 50]
    assert all(other[r.doc_id] != r.pieces and len(whole[r.doc_id]) < len(r.pieces) for r in long_ones)
    assert all(len(r.pieces) >= len(r.text or "") for r in pieces.encode(docs, dropout=1.0).collect())
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


# -- repeats ------------------------------------------------------------------------------------

def plain_repeats(rows, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    times = {}
    for w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            times[k] = times.get(k, 0) + 1
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - size + 1):
            if times[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeat_rows(seed, copies=200):
    rng = random.Random(seed)
    shared = [prose(s, rng.randint(30, 90)).split() for s in range(4)]
    rows = list(odd_rows())
    for k in range(40):
        w = prose(500 + k, rng.randint(0, 200)).split()
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(10)
            at = rng.randint(0, len(w))
            w[at:at] = s[a: a + rng.randint(20, 80)]
        rows.append((100 + k, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1000 + k, prose(k, 5) + " " + " ".join(shared[0])) for k in range(copies)]  # a passage that stands everywhere
    return rows + [(99, "a b " * 60), (98, " ".join(shared[1][:35])), (97, " ".join(shared[1][:34]) + " z")]


@pytest.mark.parametrize("size,part", [(35, 2_000), (35, substrings.BYTES_PER_PART), (8, 5_000), (2, 50_000)])
def test_repeats_equal_plain_version(spark, size, part):
    rows = repeat_rows(size)
    got = substrings.remove_repeats(docs_of(spark, rows).select("doc_id", "text"), size=size, bytes_per_part=part).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got], key=str) \
        == plain_repeats(rows, size)


def test_repeats_odd_tables(spark):
    docs = docs_of(spark, odd_rows())
    got = substrings.remove_repeats(docs)
    assert set(CLASHES) - {"n_words"} <= set(got.columns) and got.count() == docs.count()
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
