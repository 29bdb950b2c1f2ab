"""Benchmark decontamination: every window of training words is looked up among benchmark windows.

The windows of the benchmark (``size`` consecutive words; an item with fewer words is one window) become
a sorted array of hashes that every task receives.  Its size is bounded: items are dealt into blocks of
at most ``block_bytes`` of text, measured before anything is sent; more than one block means more than
one pass over the documents, never a larger broadcast.  A bit table answers most look-ups, binary search
the rest, and every hit is verified word for word.

Defined cases: a null or empty text has no words, no hits and is not contaminated; items that are null,
have a null id or no words are ignored; two items of one id count as one; repeated documents are judged
one by one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dnslake.llm import textops
from dnslake.llm.frames import add_columns, pack, unpack
from dnslake.session import cut_lineage

SIZE = 13
BLOCK_BYTES = 32 << 20
WORDS = textops.lut_alnum_lower()
_TABLE_BITS = 22


class Windows:
    """Distinct windows of a block of items, by length."""

    def __init__(self, ids: list[str], texts: list[str], size: int):
        data, offs = textops.flat(pa.array(texts, pa.large_string()))
        words = textops.Words(data, offs, WORDS)
        self.ids = ids
        self.by_length: dict[int, dict] = {}
        for length in range(1, size + 1):
            at, code = words.windows(length)
            whole = words.counts[words.row[at]] == length
            at, code = (at, code) if length == size else (at[whole], code[whole])
            if not len(at):
                continue
            order = np.argsort(code, kind="stable")
            at, code = at[order], code[order]
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(code & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
            texts_of = [normal_words(data, words, j, length) for j in at]
            self.by_length[length] = {"code": code, "table": table, "text": texts_of, "item": words.row[at]}


def normal_words(data: np.ndarray, words: textops.Words, first: int, length: int) -> bytes:
    """The words of one window, in lower case, joined by blanks."""
    raw = WORDS[data[words.starts[first]: words.ends[first + length - 1]]].tobytes()
    return b" ".join(word for word in raw.split(b"\0") if word)


def find(windows: Windows, words: textops.Words) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of a slice are hit, and the items that occur in each row."""
    hit = np.zeros(len(words), bool)
    items: list[set[str]] = [set() for _ in range(len(words.offs) - 1)]
    for length, known in windows.by_length.items():
        at, code = words.windows(length)
        maybe = known["table"][(code & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)]
        at, code = at[maybe], code[maybe]
        lo = np.searchsorted(known["code"], code)
        hi = np.searchsorted(known["code"], code, side="right")
        found = hi > lo
        real = []
        for first, a, b in zip(at[found].tolist(), lo[found].tolist(), hi[found].tolist()):
            text = normal_words(words.data, words, first, length)
            same = [known["item"][k] for k in range(a, b) if known["text"][k] == text]
            if same:
                real.append(first)
                items[words.row[first]].update(windows.ids[k] for k in same)
        if real:
            hit |= textops.cover(np.array(real), length, len(words))
    return hit, items


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """Items in blocks of bounded size (an item larger than a block is a block of its own)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")) \
        .where("id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("id") + 16)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = part.distinct().orderBy("id", "text").collect()  # about block_bytes: n follows the measured size
        if rows:
            yield [r.id for r in rows], [r.text for r in rows]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs``, and n_words, n_hit, n_items (long), items (array of ids in string order),
    hit_words (array of [first, end) word numbers) and contaminated (hits are a twentieth of the words or
    more)."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    spark = docs.sparkSession
    blocks = [(ids, texts) for ids, texts in _blocks(benchmark, block_bytes)] or [([], [])]
    out = docs
    for k, (ids, texts) in enumerate(blocks):
        sent = spark.sparkContext.broadcast((ids, texts))
        out = _scan_block(out, sent, size, first=k == 0)
        if len(blocks) > 1:  # each pass is written, so that the next does not repeat it
            out = cut_lineage(out)
    return (out.withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def _scan_block(docs: DataFrame, sent, size: int, first: bool) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]):
        windows = Windows(*sent.value, size)
        for batch in batches:
            for part in textops.slices(batch, "text"):
                data, offs = textops.flat(part.column("text"))
                words = textops.Words(data, offs, WORDS)
                hit, items = find(windows, words)
                before = None if first else (part.column("__hit_words").to_pylist(), part.column("__items").to_pylist())
                if before:
                    for row, ranges in enumerate(before[0]):
                        items[row].update(before[1][row])
                        for a, b in ranges:
                            hit[words.first[row] + a: words.first[row] + b] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                ranges = [[] for _ in items]
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    while a < b:  # a run of hits may go on into the next row
                        row = int(words.row[a])
                        end = min(b, int(words.first[row + 1]))
                        ranges[row].append([a - int(words.first[row]), end - int(words.first[row])])
                        a = end
                total = np.concatenate([[0], np.cumsum(hit)])
                yield part, {
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "n_hit": pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)),
                    "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    "hit_words": pa.array(ranges, pa.list_(pa.list_(pa.int64())))}

    if not first:
        docs = docs.withColumnsRenamed({"hit_words": "__hit_words", "items": "__items"})
    return add_columns(docs, step,
                       "n_words long, n_hit long, items array<string>, hit_words array<array<bigint>>").drop(
        "__hit_words", "__items")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    return unpack(scan(pack(docs, "text"), benchmark, **how).where(~F.col("contaminated")), docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """All documents; hit words and what stands between neighbouring hit words are cut out of the text."""
    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in textops.slices(batch, "text"):
                data, offs = textops.flat(part.column("text"))
                words = textops.Words(data, offs, WORDS)
                keep = np.ones(len(data) + 1, bool)
                for row, ranges in enumerate(part.column("hit_words").to_pylist()):
                    for a, b in ranges:
                        keep[words.starts[words.first[row] + a]: words.ends[words.first[row] + b - 1]] = False
                texts = [data[a:b][keep[a:b]].tobytes().decode() for a, b in zip(offs[:-1], offs[1:])]
                yield part, {"text": pa.array(texts, pa.string())}

    found = scan(pack(docs, "text"), benchmark, **how)
    return unpack(add_columns(found, step, "text string"), docs.columns)


def items_digest(items: str = "items"):
    """Hash of the ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
