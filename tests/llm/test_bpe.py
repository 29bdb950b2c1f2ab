"""BPE against the tokenizers library: every code point, odd texts, whole queries."""

import hashlib
import random

import pyarrow as pa
import pytest
from helpers import CLASHES, docs_of, odd_rows, prose

from dnslake.llm import bpe


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_path(), "rb") as f:
        return bpe.Bpe(f.read(), remembered=50)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def same(own, library, texts):
    ids, offs = own.encode(texts)
    found = [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert found == want, next((t[:80], f, w) for t, f, w in zip(texts, found, want) if f != w)
    decoded = own.decode(pa.array(found, pa.list_(pa.int32())), False).to_pylist()
    assert decoded == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_code_point(own, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 5 == 0)]
    for start in range(0, len(points), 20_000):
        same(own, library, [f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in points[start: start + 20_000]])


def test_random_texts(own, library):
    rng = random.Random(5)
    pools = [range(32, 127), range(0x250), range(0x300, 0x700), range(0x3000), range(0xD800), range(0xE000, 0x110000)]
    parts = [" ", "'s", "'ll", "'", "''re", "'ve've", "Σ", "İ", "́", "<|endoftext|>", "<|startoftext|>", "<|end"]
    for _ in range(100):
        texts = []
        for _ in range(100):
            pool = rng.choice(pools)
            texts.append("".join(rng.choice(parts) if rng.random() < 0.3 else chr(rng.choice(pool))
                                 for _ in range(rng.randint(0, 30))))
        same(own, library, texts)


def test_borders_of_texts(own, library):
    same(own, library, ["it'", "s", "", "'", "l", "l'", "re", "don't", "x'", "", "'s", "a", "<|endoftext|>", "<|endoftext|><|endoftext|>a"])
    same(own, library, [])
    same(own, library, [""])


def test_long_words(own, library):
    same(own, library, ["ab" * 60_000, "x" * 50_001, "é" * 20_000, "!" * 30_000])


def test_memory_is_bounded(own):
    own.encode([prose(k, 500, 5000) for k in range(5)])
    assert len(own.words) <= 50 and len(own.words.old) <= 50


def test_text_of_ids(own):
    ids, _ = own.encode(["Hello  Wörld, it's fine"])
    assert own.decode(pa.array([ids.tolist()], pa.list_(pa.int32())), True).to_pylist() == ["hello wörld , it 's fine"]


def test_unknown_ids_end_the_job(own):
    with pytest.raises(ValueError):
        own.decode(pa.array([[5, 10_000_000]], pa.list_(pa.int32())), False)


def test_other_files_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Bpe(f.read())


def test_rows_and_columns(spark, library):
    docs = docs_of(spark, odd_rows())
    done = bpe.decode(bpe.encode(docs))
    assert done.columns == [*docs.columns, "ids", "n_tokens", "decoded"]
    rows = done.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and [r[c] for c in CLASHES] == CLASHES
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert sum(r.text is None for r in rows) == 2
    clash = docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    assert sorted(map(str, bpe.decode(bpe.encode(clash)).select("ids", "decoded").collect())) == sorted(
        map(str, done.select("ids", "decoded").collect()))
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(nothing).collect()] == ["", ""]


def test_query(spark, library):
    from dnslake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe_ranks"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
