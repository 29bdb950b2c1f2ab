"""Removal of repeated passages: fixed-block anchors, rolling probes, extension to whole repeats.

Any window of ``size`` words holds a whole block of ``(size + 1) // 2`` words at a multiple of that length,
in whichever document it stands.  So the non-overlapping blocks of all documents are the index, and every
rolling window of the block length probes it.  Where a probe meets a block of another place, the words
around it are candidates; the windows of full ``size`` that hold such an anchor are compared, and windows
that occur twice join up to the maximal repeats.

How it runs: documents are dealt into buckets by a hash of their id (one shuffle of the text, which Spark
reuses for all three passes).  A bucket sends its distinct probe hashes, packed four bytes each, to the
part that owns the hash; the part answers with those that met a block.  The same exchange, with 95-bit
hashes, is done for the candidate windows of full size.  Hashes are made distinct before they are sent,
so a passage that stands in a third of all documents is one entry per sender, and no list of places is
ever built.

Defined cases: a null or empty text has no words; a text with fewer than ``size`` words keeps all;
repeated rows are repeats of each other; rows with null ids are treated alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dnslake.llm import textops
from dnslake.llm.frames import parts_for

SIZE = 35
BYTES_PER_PART = 12 << 20
WORDS = textops.lut_blank_separated()
_LOW, _LOW_BITS = np.uint64((1 << 38) - 1), np.uint64(38)


def _probe_keys(code: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Owning part and the 38 bits that are sent of a hash."""
    return ((code >> _LOW_BITS) % np.uint64(parts)).astype(np.int64), code & _LOW


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    got = np.frombuffer(raw, np.uint8).reshape(-1, width)
    wide = np.zeros((len(got), 8), np.uint8)
    wide[:, :width] = got
    return wide.view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values as steps of four bytes; as values of five where a step is too large."""
    steps = np.diff(values, prepend=np.uint64(0))
    return b"4" + _pack(steps, 4) if steps.max(initial=0) < 1 << 32 else b"5" + _pack(values, 5)


def _unpack_sorted(raw: bytes) -> np.ndarray:
    if raw[:1] == b"5":
        return _unpack(raw[1:], 5)
    return np.cumsum(np.frombuffer(raw, "<u4", -1, 1), dtype=np.uint64)


_PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


def _messages(bucket: int, owner: np.ndarray, send) -> dict:
    """One row per owner; ``send(range)`` packs a range of entries sorted by owner."""
    edges = np.flatnonzero(np.diff(np.concatenate([[-1], owner, [-1]])))
    rows = {"part": [], "bucket": [], "body": []}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows["part"].append(int(owner[a]))
        rows["bucket"].append(bucket)
        rows["body"].append(send(slice(a, b)))
    return rows


_MESSAGE = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary())])
_MESSAGE_SQL = "part long, bucket long, body binary"


def _probes(text: pa.Array, bucket: int, block: int, parts: int) -> dict:
    """Distinct probe hashes of some documents; the lowest bits say: is a block, occurs twice here."""
    data, offs = textops.flat(text)
    words = textops.Words(data, offs, WORDS)
    at, code = words.windows(block)
    is_block = (at - words.first[words.row[at]]) % block == 0
    owner, low = _probe_keys(code, parts)
    key = (owner.astype(np.uint64) << _LOW_BITS) | low
    order = np.argsort(key, kind="stable")
    key, is_block = key[order], is_block[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(key)]]))
    blocks = np.logical_or.reduceat(is_block, first) if len(first) else np.zeros(0, bool)
    key = key[first]
    value = ((key & _LOW) << np.uint64(2)) | blocks.astype(np.uint64) | ((times > 1).astype(np.uint64) << np.uint64(1))
    return _messages(bucket, (key >> _LOW_BITS).astype(np.int64), lambda r: _pack_sorted(value[r]))


def _full(words: textops.Words, size: int, only: np.ndarray) -> np.ndarray:
    """95-bit hashes of the windows of full size at ``only``; the lowest bit of b is free."""
    pair = np.empty(len(only), _PAIR)
    pair["a"] = words.windows(size, at=only)[1]
    pair["b"] = (words.windows(size, lane=1, at=only)[1] >> np.uint64(33)).astype(np.uint32) << np.uint32(1)
    return pair


def _runs(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs, and where in it each distinct pair begins."""
    order = np.lexsort((pair["b"], pair["a"]))
    a, b = pair["a"][order], pair["b"][order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order


class _Known:
    """Looks windows up among the repeated ones of a bucket."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def places(self, words: textops.Words, size: int) -> np.ndarray:
        """First words of the windows that are known."""
        at, code = words.windows(size)
        maybe = self.table[(code >> np.uint64(42)).astype(np.int64)]
        at, code = at[maybe], code[maybe]
        place = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
        return at[self.hashes[place] == code]


def _candidates(text: pa.Array, bucket: int, known: np.ndarray, block: int, size: int, parts: int) -> dict:
    """Distinct full windows that hold an anchor; the lowest bit says: occurs twice here."""
    data, offs = textops.flat(text)
    words = textops.Words(data, offs, WORDS)
    at, code = words.windows(block)
    owner, low = _probe_keys(code, parts)
    met = np.isin((owner.astype(np.uint64) << _LOW_BITS) | low, known)
    anchors = at[met]
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(anchors - (size - block), words.first[words.row[anchors]]), 1)
    np.add.at(near, anchors + 1, -1)
    near = np.cumsum(near)[:-1] > 0
    near &= np.arange(len(words)) + size <= words.first[words.row + 1]
    pair = _full(words, size, np.flatnonzero(near))
    order, first = _runs(pair)
    values, times = pair[order[first]], np.diff(np.append(first, len(pair)))
    owner = (values["a"] % np.uint64(parts)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    values, times, owner = values[order], times[order], owner[order]
    values["b"] |= (times > 1).astype(np.uint32)
    return _messages(bucket, owner, lambda r: values[r].tobytes())


def _answer(table: pa.Table, keep) -> pa.Table:
    """Sends back to every bucket those of its entries that ``keep`` chooses."""
    out = {"part": [], "bucket": [], "body": []}
    part = table.column("part")[0].as_py() if table.num_rows else 0
    for row, body in enumerate(keep(table.column("body").to_pylist())):
        if body:
            out["part"].append(part)
            out["bucket"].append(table.column("bucket")[row].as_py())
            out["body"].append(body)
    return pa.table(out, _MESSAGE)


def _met_blocks(bodies: list[bytes]) -> list[bytes]:
    values = [_unpack_sorted(b) for b in bodies]
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    key = flat[order] >> np.uint64(2)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.diff(np.concatenate([first, [len(key)]])) > 1
    bits = np.bitwise_or.reduceat(flat[order] & np.uint64(3), first)
    good = key[first[(several | (bits & np.uint64(2) > 0)) & (bits & np.uint64(1) > 0)]]
    return [_pack(mine[np.isin(mine, good, assume_unique=True)], 5) for mine in (v >> np.uint64(2) for v in values)]


def _met_windows(bodies: list[bytes]) -> list[bytes]:
    got = [np.frombuffer(b, _PAIR) for b in bodies]
    flat = np.concatenate(got)
    twice = flat["b"] & np.uint32(1)
    flat["b"] &= np.uint32(0xFFFFFFFE)
    order, first = _runs(flat)
    times = np.add.reduceat(1 + twice[order].astype(np.int64), first)
    good = np.empty(len(flat), bool)
    good[order] = np.repeat(times > 1, np.diff(np.append(first, len(flat))))
    at, out = 0, []
    for mine in got:
        # 64 bits tell the windows of one bucket apart, which is all the answer is for.
        out.append(np.ascontiguousarray(mine["a"][good[at: at + len(mine)]]).tobytes())
        at += len(mine)
    return out


def _kept(words: textops.Words, removed: np.ndarray) -> list[str]:
    """Per row: the words that stay, joined by one blank."""
    stay = ~removed
    length = (words.ends - words.starts)[stay] + 1
    body = textops.ragged(np.append(words.data, np.uint8(32)), words.starts[stay], length)
    if len(length):
        body[np.cumsum(length) - 1] = 32
    per_row = np.zeros(len(words.counts) + 1, np.int64)
    np.cumsum(np.bincount(words.row[stay], weights=length, minlength=len(words.counts)), out=per_row[1:])
    raw = body.tobytes()
    return [raw[a: max(a, b - 1)].decode() for a, b in zip(per_row[:-1].tolist(), per_row[1:].tolist())]


def remove_repeats(docs: DataFrame, size: int = SIZE, bytes_per_part: int = BYTES_PER_PART) -> DataFrame:
    """All columns of ``docs``, and n_words, n_removed (long) and kept_text (kept words, blank-joined).

    A word goes if it lies in a window of ``size`` words whose words also stand, in that order, somewhere
    else, the same document included.  Windows are judged on the input.
    """
    if size < 2:
        raise ValueError("size must be 2 or more")
    block = (size + 1) // 2
    added = {"n_words", "n_removed", "kept_text"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    parts = parts_for(docs, "text", bytes_per_part)
    names = docs.columns
    keyed = docs.withColumn("__bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long")).repartition(parts, "__bucket")

    def by_bucket(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
        for part in textops.slices(batch, "text", 4 << 20):
            bucket = part.column("__bucket").to_numpy(zero_copy_only=False)
            for b in np.unique(bucket).tolist():
                yield b, part.column("text").take(pa.array(np.flatnonzero(bucket == b)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, text in by_bucket(batch):
                yield pa.RecordBatch.from_pydict(_probes(text, bucket, block, parts), _MESSAGE)

    def exchange(messages: DataFrame, keep) -> DataFrame:
        answers = messages.repartition(parts, "part").groupBy("part").applyInArrow(
            lambda table: _answer(table, keep), _MESSAGE_SQL)
        return answers.withColumnRenamed("bucket", "__bucket").select("__bucket", "part", "body").repartition(parts, "__bucket")

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [np.uint64(p) << _LOW_BITS | _unpack(b, 5) for p, b in
                 zip(right.column("part").to_pylist(), right.column("body").to_pylist())]
        out = [_MESSAGE.empty_table()]
        if known and left.num_rows:
            known = np.unique(np.concatenate(known))
            for batch in left.to_batches():
                for bucket, text in by_bucket(batch):
                    out.append(pa.table(_candidates(text, bucket, known, block, size, parts), _MESSAGE))
        return pa.concat_tables(out)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        bodies = right.column("body").to_pylist()
        known = _Known(np.concatenate([np.frombuffer(b, np.uint64) for b in bodies])) if bodies else None
        total, gone, text = [], [], []
        for batch in left.to_batches():
            for part in textops.slices(batch, "text"):
                words = textops.Words(*textops.flat(part.column("text")), WORDS)
                removed = np.zeros(len(words), bool)
                if known:
                    removed = textops.cover(known.places(words, size), size, len(words))
                total.append(words.counts)
                gone.append(np.bincount(words.row[removed], minlength=len(words.counts)))
                text.extend(_kept(words, removed))
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64())
        return pa.table([*[left.column(n) for n in names], join(total), join(gone), pa.array(text, pa.string())],
                        [*names, "n_words", "n_removed", "kept_text"])

    anchors = exchange(keyed.mapInArrow(probe, _MESSAGE_SQL), _met_blocks)
    windows = exchange(keyed.groupBy("__bucket").cogroup(anchors.groupBy("__bucket"))
                       .applyInArrow(candidates, _MESSAGE_SQL), _met_windows)
    schema = StructType([*docs.schema, StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_text", StringType())])
    return keyed.groupBy("__bucket").cogroup(windows.groupBy("__bucket")).applyInArrow(finish, schema)
