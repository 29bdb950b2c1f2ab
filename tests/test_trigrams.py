"""The trigram index against a plain scan."""

import random

import pytest

from dnslake.operators import search, trigrams


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc.") for _ in range(rng.randint(1, 9))) + rng.choice([".com", ".net", "", ".ads.com"])
             for _ in range(600)] + ["ab", "a", "Upper.Case.Com"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    path = str(tmp_path_factory.mktemp("trigrams") / "index")
    trigrams.build(df, path)
    return path, spark.createDataFrame([(n,) for n in sorted({n.lower() for n in names})], "name string")


@pytest.mark.parametrize("q", ["abc", "ads.com", "B.C", "*.ads.com", "a", "ab", "", "zzz", "abzzz", ".com", "upper",
                               "/^ab.*[.]com$/", "/abc?/", "/a(bc)*b/", "/ab+c/", "/[ab]c\\.net/", "/abc|cba/", "/ads\\.com$/",
                               "/(?i)ABC/", "/[.]ads[.]com/", "/abc{0,2}/", "/aab{2}/", "/\\.com/", "/[^a]bc[.]/", "/ABC/", "/a\\wc/"])
def test_finds_what_a_scan_finds(spark, index, q):
    path, names = index
    assert sorted(r.name for r in trigrams.find(spark, path, q).collect()) == sorted(
        r.name for r in search.search(names, q).collect())


def test_reads_only_the_shards_of_its_grams(spark, index, capsys):
    capsys.readouterr()
    trigrams.find(spark, index[0], "ads.com").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "In(gram, " in plan


@pytest.mark.parametrize("q,want", [
    ("Abc", ["abc"]), ("ab", []), ("*.ads.com", ["ads.com"]), ("/^ads[.]com$/", ["ads.com"]), ("/abc|def/", []), ("/abcd?efg/", ["abc", "efg"]),
    ("/abcd+efg/", ["abcd", "efg"]), ("/(abc)def/", ["def"]), ("/abc.def/", ["abc", "def"]), ("/abc\\.def/", ["abc.def"]), ("/a\\d+bcd/", []),
    ("/abcd{2}efg/", ["abc", "efg"])])
def test_required_parts(q, want):
    assert trigrams.required(q) == want
