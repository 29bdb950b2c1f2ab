"""Spelling variants against a plain version, with and without full buckets."""

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import LOWER, docs_of, odd_rows
from pyspark.sql import functions as F

from dnslake.llm import variants


def plain_words(rows, least=7):
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                yield run


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return len(a) - len(b) <= 1 and a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k + 1:] == b[k:])


def plain(rows, ratio=10):
    n = {w: c for w, c in Counter(plain_words(rows)).items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def texts(seed, letters, count):
    """Words around a few stems, some of them a hundred times as frequent as others."""
    rng, out = random.Random(seed), []
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(12)]
    for _ in range(count):
        word = rng.choice(stems[: rng.choice([1, 3, 12])])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k, c = rng.randrange(len(word)), rng.choice(letters)
            word = rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k + 1:], word[:k] + c + word[k:]])
        out.append(word.upper() if rng.random() < 0.1 else word)
    return [(k, " ".join(out[k * 40: k * 40 + 40])) for k in range(len(out) // 40)]


def found(spark, rows, **options):
    done = variants.spelling_variants(docs_of(spark, rows), **options)
    assert done.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    listed = [tuple(r) for r in done.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


@pytest.mark.parametrize("letters,options", [
    ("abcdefghij", {}), ("abéÿ×÷À", {}), ("abcdefghij", {"symbols": 2, "bucket": 3}), ("abéÿ×÷À", {"symbols": 3, "bucket": 1}),
    ("ab", {"symbols": 4, "bucket": 2})])
def test_against_plain(spark, letters, options):
    rows = texts(len(letters), letters, 4000)
    assert found(spark, rows, **options) == plain(rows)


def test_one_symbol_is_one_bucket_per_length(spark):
    rows = texts(3, "abcd", 2000)
    assert found(spark, rows, symbols=1, bucket=5) == plain(rows)


def test_chains_of_forms_and_ties(spark):
    rows = [(k, t) for k, t in enumerate(["aaaaaaab " * 2, "aaaaaabb " * 25, "aaaaabbb " * 260, "aaaabbbb " * 2700,
                                          "zzzzzzza zzzzzzza", "zzzzzzzb " * 40, "zzzzzzzc " * 40])]
    done = found(spark, rows)
    assert done == plain(rows)
    root = {r[0]: r[2] for r in done}
    assert root["aaaaaaab"] in ("aaaabbbb", "aaaaabbb")  # one of the runs may have lost a letter


def test_odd_rows(spark):
    assert found(spark, odd_rows()) == plain(odd_rows())
    assert found(spark, odd_rows() * 2) == plain(odd_rows() * 2)
    assert found(spark, []) == set()
    assert found(spark, [(1, None), (2, "")]) == set()


def test_pairs_come_in_both_directions_once(spark):
    rows = texts(9, "abcdef", 3000)
    vocab = variants.vocabulary(docs_of(spark, rows))
    for options in ({}, {"symbols": 2, "bucket": 2}):
        pairs = [tuple(r) for r in variants.near_pairs(vocab, **options).select("word", "near").collect()]
        assert len(pairs) == len(set(pairs)) and {(b, a) for a, b in pairs} == set(pairs)


def test_neighbourhood(spark):
    row = spark.range(1).select(variants.neighbourhood(F.lit("aba"), ["a", "b", "c"], False).alias("n"),
                                variants.neighbourhood(F.lit("aab"), ["a", "b", "c"], True).alias("later")).first()
    assert sorted(row.n) == sorted(["ba", "aa", "ab", "bba", "cba", "aaa", "aca", "abb", "abc"])
    assert sorted(row.later) == sorted(["ab", "aa", "bab", "cab", "abb", "acb", "aac"])
