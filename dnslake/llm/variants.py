"""Spelling variants by a reduced alphabet.

Words and their counts come from one aggregation over the texts.  Letters are hashed to a few symbols, which turns
a word into a reduced word; one edit of a word is one edit, or none, of its reduced word.  The one-edit
neighbourhood of every reduced word is written out and joined with the reduced vocabulary; the words of two reduced words
that meet so are verified on their letters by edit distance.  An edit and its inverse join the same two words, so each is written
from one end only: deletions stand for insertions too, replacements go to higher symbols, and equal reduced words are
compared in one order.  Both directions follow from the verified pairs, so the neighbourhoods are covered in full.

A reduced word that very many words share would make its join quadratic.  Words in such a bucket leave the first join; the
words that reach the bucket meet them in a second one over the letters themselves, where no two words share a key, so
nothing is lost and no bucket grows.

Forms climb: each is at least ``ratio`` times as frequent as its word, so a chain has at most log(n) links, and roots
follow in log(log(n)) rounds of pointer doubling.

Defined cases: null and empty texts have no words; a null id counts as the empty string in the hash; repeated rows count again;
other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from dnslake.session import cut_lineage

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
SYMBOLS = 8
#: Most words of one reduced word in the first join.
BUCKET = 256
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def symbol(letter: str, symbols: int) -> str:
    """The hash of a letter: one of ``symbols`` signs."""
    return chr(0x30 + ((ord(letter) * 0x85EBCA6B & 0xFFFFFFFF) >> 12) % symbols)


def words(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word) of every occurrence: runs of letters of at least ``min_length``, A-Z lower-cased, some with a letter dropped."""
    # Runs shorter than the least length can never become words, so the pattern leaves them out.
    pattern = F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}")
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(docs["text"].cast("string"), pattern, F.lit(0))).alias("run"))
    lower = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER))
                        .otherwise(F.col("run")).alias("run"))
    hashed = lower.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(
        F.char_length("word") >= min_length)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``min_count`` times."""
    return words(docs, min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def neighbourhood(word: Column, alphabet: list[str], later: bool) -> Column:
    """The distinct strings one deletion or one replacement away; with ``later`` only replacements by later signs."""
    places = F.sequence(F.lit(1), F.char_length(word))
    signs = F.array(*[F.lit(s) for s in sorted(alphabet)])

    def head(i: Column) -> Column:
        return F.substring(word, F.lit(1), i - 1)

    def tail(i: Column) -> Column:
        return F.substring(word, i + 1, F.char_length(word))

    def others(i: Column) -> Column:
        here = F.substring(word, i, F.lit(1))
        return F.filter(signs, lambda s: s > here if later else s != here)

    shorter = F.array_distinct(F.transform(places, lambda i: F.concat(head(i), tail(i))))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(others(i), lambda s: F.concat(head(i), s, tail(i)))))
    return F.concat(shorter, replaced)


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """(word, n, near, near_n) of every two words that differ by one edit, in both directions.

    Neighbourhoods are written per reduced word, not per word, and travel as pairs of 64-bit hashes.  Two reduced words of one hash
    only bring more candidates, since pairs are verified on the words and counted once.
    """
    letters = F.translate("word", "".join(LETTERS), "".join(symbol(c, symbols) for c in LETTERS))
    vocab = vocab.select("word", "n", letters.alias("reduced"), F.xxhash64(letters).alias("key"))
    alphabet = sorted({symbol(c, symbols) for c in LETTERS})
    reduced = cut_lineage(vocab.groupBy("reduced", "key").agg(F.count("*").alias("size")))
    around = F.concat(F.array("reduced"), neighbourhood(F.col("reduced"), alphabet, True))
    reach = reduced.select(F.col("key").alias("own"), F.explode(F.transform(around, lambda r: F.xxhash64(r))).alias("key"))
    links = reach.join(reduced.groupBy("key").agg(F.sum("size").alias("size")), "key")
    firsts = vocab.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("key").alias("own"))
    # Equal reduced words meet from both ends, all others from one.
    once = (F.col("own") != F.col("key")) | (F.col("a") < F.col("word"))
    met = (links.where(F.col("size") <= bucket).select("own", "key").join(firsts, "own")
           .join(vocab.select("word", "n", "key"), "key").where(once & (F.levenshtein("a", "word", 1) == 1)).select("a", "a_n", "word", "n"))
    if not reduced.where(F.col("size") > bucket).isEmpty():
        # Over the letters themselves every key is one word, so the words that reach a full bucket find theirs directly.
        full = links.where(F.col("size") > bucket).select("own", "key")
        near_full = firsts.join(full.select("own").distinct(), "own", "left_semi")
        fine = near_full.select("a", "a_n", "own", F.explode(neighbourhood(F.col("a"), LETTERS, False)).alias("word"))
        found = fine.join(vocab.join(full.select("key").distinct(), "key", "left_semi").select("word", "n", "key"), "word")
        met = met.unionByName(found.join(full, ["own", "key"], "left_semi").where(once).select("a", "a_n", "word", "n"))
    pairs = met.distinct()
    there = F.struct("a", "a_n", "word", "n")
    back = F.struct(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("a").alias("word"), F.col("a_n").alias("n"))
    return pairs.select(F.explode(F.array(there, back)).alias("p")).select(
        F.col("p.a").alias("word"), F.col("p.a_n").alias("n"), F.col("p.word").alias("near"), F.col("p.n").alias("near_n"))


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, n, n_near, form_n) of every word."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(
        (-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    wins = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    return vocab.join(best, "word", "left").select(
        "word", F.when(wins, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(wins, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) of the words that have a form; ``most`` is the greatest count of a word."""
    links = cut_lineage(found.where("form is not null").select("word", F.col("form").alias("root")))
    longest = max(1, math.floor(math.log(max(most, ratio), ratio)) + 1) if ratio > 1 else most
    for _ in range(max(1, math.ceil(math.log2(longest)))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = cut_lineage(links.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return links


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      symbols: int = SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    if ratio < 2 or min_length < 1:
        raise ValueError("ratio must be 2 or more and min_length 1 or more")
    vocab = cut_lineage(vocabulary(docs, min_length, min_count))
    most = vocab.agg(F.max("n")).first()[0] or 0
    found = cut_lineage(forms(vocab, near_pairs(vocab, symbols, bucket), ratio))
    return found.join(roots(found, most, ratio), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
