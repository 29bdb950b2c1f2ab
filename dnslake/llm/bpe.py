"""Byte-level BPE with word ends: encoding by a queue of merge ranks, decoding by vocabulary strings.

The tokenizer file gives the vocabulary, the ranked merges, the split pattern and the special tokens.  A text is cut at the special
tokens, put into normal form (NFC, every code point lower-cased on its own) and split into words by the file's
pattern.  In a word the symbols form a doubly linked list; a priority queue holds (rank, place) of each
neighbouring pair that the file can merge.  The least rank goes first, the leftmost of equals; an entry whose
symbols have changed meanwhile is stale and skipped.  Each merge offers the two new pairs beside it, so a word of
m symbols costs m log m, whatever its length.  Workers remember the ids of recent words, in two generations of
bounded size.

The tokenizers library brings Unicode tables of its own.  Characters on whose normal form or kind Python's tables differ
from them (young ones) are found when a worker starts, and texts with such a character are normalised and split
by the library; the merges are made here in any case.

Decoding looks every id up in the vocabulary and joins the strings with one space, as the library does for a file
without a decoder; ``as_text`` instead joins them to the text they stand for.

Defined cases: null and empty texts, and texts of white space alone, have no ids, and a null text stays null; ids that
the vocabulary lacks end the job; repeated rows get equal ids; other columns pass through, columns named like
a new one are replaced.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dnslake.llm import textops
from dnslake.llm.frames import add_columns

#: Words that one generation of a worker's memory holds.
REMEMBERED = 300_000
#: The split pattern that the words of this module follow.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points of the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: Bits of a place in a word.
_PLACE = 32
#: Ids that are decoded at a time.
_DECODED = 1 << 20


def default_path() -> str:
    """The public vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def kinds_of_code_points() -> np.ndarray:
    """Letter, number, white space, other or unassigned, for every code point."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        general = unicodedata.category(chr(c))
        kinds[c] = (_LETTER if general[0] == "L" else _NUMBER if general[0] == "N" else
                    _UNKNOWN if general in ("Cn", "Cs") else _OTHER)
    kinds[list(WHITE_SPACE)] = _SPACE
    return kinds


def normal(text: str) -> str:
    """NFC, every code point in lower case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # str.lower() looks at the neighbours of a capital sigma
        return "".join(map(str.lower, text))
    return text.lower()


def young_letters(kinds: np.ndarray, library_normal) -> list[str]:
    """Characters whose case, order among marks or composition the library sees otherwise than Python."""
    letters = [chr(c) for c in np.flatnonzero((kinds != _UNKNOWN) & (kinds != _SPACE)).tolist()]
    probes = [(c, c) for c in letters]
    for c in letters:
        if unicodedata.combining(c):  # before a mark of the lowest class and after one of the highest
            probes += [(c, f"a{c}\u0334"), (c, f"a\u0345{c}")]
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            probes += [(p, unicodedata.normalize("NFD", c)) for p in unicodedata.normalize("NFD", c)[-1:] + c]
    found = library_normal("\n".join(p for _, p in probes)).split(" ")
    return [c for (c, p), f in zip(probes, found, strict=True) if normal(p) != f]


class _Memory(dict):
    """word -> ids; words of the last generation come back, older ones are worked out again."""

    def __init__(self, work, size: int):
        super().__init__()
        self.work, self.size, self.old = work, size, {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.work(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Bpe:
    """A tokenizer file, ready for use."""

    def __init__(self, raw: bytes, remembered: int = REMEMBERED):
        self.raw = raw
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if (model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"]
                or spec["decoder"] or spec["post_processor"] or steps != ["NFC", "Replace", "Lowercase"]
                or [s["type"] for s in pre] != ["Split", "ByteLevel"] or pre[1]["add_prefix_space"] or pre[1]["use_regex"]
                or pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[0]["pattern"] != {"Regex": PATTERN}):
            raise ValueError("this tokenizer file works in another way than NFC, lower case, split and byte-level BPE")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        # (left id, right id) as one number -> rank; rank -> id of both together
        self.merges = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [vocab[a + b] for a, b in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens of this file take their surroundings into account")
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.mark = os.path.commonprefix(by_length)
        names = {i: name for name, i in {**vocab, **self.special}.items()}
        self.strings = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        byte_of = {c: b for b, c in enumerate(letters)}
        self.texts = [None if n is None else n.encode() if n in self.special else
                      bytes(byte_of[c] for c in n.removesuffix(end)) + (b" " if end and n.endswith(end) else b"")
                      for n in (names.get(i) for i in range(len(self.strings)))]
        self.known: set[str] = set()
        self.words = _Memory(self.merge, remembered)
        self.byte_of = byte_of

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.raw)

    @cached_property
    def kinds(self) -> np.ndarray:
        """Kinds of all code points, with the young ones unknown; decoding needs none."""
        kinds = kinds_of_code_points()
        kinds[[ord(c) for c in young_letters(kinds, self.library.normalizer.normalize_str)]] = _UNKNOWN
        return kinds

    # -- one word ----------------------------------------------------------------------------------

    def merge(self, word: str) -> list[int]:
        """Ids of a word: merges by rank over a doubly linked list of symbols."""
        raw = word.encode()
        n = len(raw)
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        if n == 1:
            return symbol
        ahead, behind = [*range(1, n), -1], [-1, *range(n - 1)]
        rank_of, made, queue = self.merges.get, self.made, []  # entries: rank, then place, in one number
        for i in range(n - 1):
            rank = rank_of(symbol[i] << 32 | symbol[i + 1])
            if rank is not None:
                queue.append(rank << _PLACE | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & (1 << _PLACE) - 1, entry >> _PLACE
            j = ahead[i]
            if symbol[i] < 0 or j < 0 or rank_of(symbol[i] << 32 | symbol[j]) != rank:
                continue  # stale: one of the two was merged since
            both, after, before = made[rank], ahead[j], behind[i]
            symbol[i], symbol[j], ahead[i] = both, -1, after
            if after >= 0:
                behind[after] = i
                rank = rank_of(both << 32 | symbol[after])
                if rank is not None:
                    heappush(queue, rank << _PLACE | i)
            if before >= 0:
                rank = rank_of(symbol[before] << 32 | both)
                if rank is not None:
                    heappush(queue, rank << _PLACE | before)
        return [s for s in symbol if s >= 0]

    # -- texts -------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 offsets of the texts."""
        plain, row, fixed = [], [], []  # stretches without special tokens, their texts; (before which stretch, id)
        for k, text in enumerate(texts):
            for n, piece in enumerate(self.cut.split(text) if self.cut and self.mark in text else [text]):
                plain.append(piece if not n % 2 else "")
                row.append(k)
                fixed.append(self.special[piece] if n % 2 else -1)
        ids, count = self._stretches(plain)
        mine = np.array(fixed, np.int64)
        special = np.flatnonzero(mine >= 0)
        if len(special):
            ids = np.insert(ids, np.cumsum(count)[special], mine[special])  # a special stretch has no ids of its own
            count[special] = 1
        per_text = np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(per_text)])

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, and the number of each."""
        odd = [k for k, t in enumerate(texts) if not t.isascii() and not self._knows(t)]
        lower = [normal(t) for t in texts]
        for k in odd:
            lower[k] = ""
        points = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
        border = np.concatenate([[0], np.cumsum([len(t) for t in lower])]).astype(np.int64)
        first = self._starts(points, border)
        word_of = np.searchsorted(first, border)  # words before each border
        # Words cover all but white space: without it, each ends where the next begins.
        solid = self.kinds[points] != _SPACE
        width = np.where(solid, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 0)
        offset = np.concatenate([[0], np.cumsum(width)])[np.append(first, len(points))]
        body = points[solid].tobytes().decode("utf-32-le").encode()
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(body))
        coded = words.dictionary_encode()
        known = [self.words[w] for w in coded.dictionary.to_pylist()]
        size = np.array([len(k) for k in known], np.int64)
        pool = np.fromiter(chain.from_iterable(known), np.int64)
        which = coded.indices.to_numpy().astype(np.int64)
        ids = textops.ragged(pool, (np.cumsum(size) - size)[which] if len(which) else which, size[which])
        done = np.concatenate([[0], np.cumsum(size[which])])
        count = np.diff(done[word_of])
        if odd:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in odd:
                parts[k] = np.fromiter(chain.from_iterable(map(self.words.__getitem__, self._by_library(texts[k]))), np.int64)
                count[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, count

    def _starts(self, points: np.ndarray, border: np.ndarray) -> np.ndarray:
        """First code points of the words: runs of letters, single digits, runs of other signs, and 's 't 're 've 'm 'll 'd."""
        n = len(points)
        kind = self.kinds[points]
        fresh = np.ones(n + 3, bool)
        fresh[1:n] = kind[1:] != kind[:-1]
        fresh[border] = True
        starts = fresh[:n] & (kind != _SPACE) | (kind == _NUMBER)
        # An apostrophe that is a run of its own takes the letters of a contraction with it.
        at = np.flatnonzero((points == 0x27) & fresh[:n] & fresh[1: n + 1])
        next_, after = (np.append(points, [0, 0, 0])[at + k] for k in (1, 2))
        inside = at + 1 < border[np.searchsorted(border, at, side="right")] if len(at) else np.zeros(0, bool)
        inside2 = at + 2 < border[np.searchsorted(border, at, side="right")] if len(at) else np.zeros(0, bool)
        one = inside & np.isin(next_, [ord(c) for c in "stmd"])
        two = inside2 & ((after == ord("e")) & ((next_ == ord("r")) | (next_ == ord("v")))
                         | (next_ == ord("l")) & (after == ord("l")))
        for found, length in ((at[one], 2), (at[two], 3)):
            starts[found + 1] = False
            rest = found + length
            rest = rest[rest < n]
            starts[rest[kind[rest] != _SPACE]] = True
        return np.flatnonzero(starts)

    def _knows(self, text: str) -> bool:
        fresh = set(text) - self.known
        if any(self.kinds[ord(c)] == _UNKNOWN for c in fresh):
            return False
        self.known |= fresh
        return True

    def _by_library(self, text: str) -> Iterator[str]:
        """Words of a text with young characters."""
        lower = self.library.normalizer.normalize_str(text)
        return (bytes(self.byte_of[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(lower))

    def decode(self, lists: pa.ListArray, as_text: bool) -> pa.Array:
        ids, offs = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if len(ids) and (ids.null_count or pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(self.strings)):
            raise ValueError("an id is not in the vocabulary")
        if as_text:
            numbers, found = ids.to_numpy(), []
            for a, b in zip(offs[:-1], offs[1:]):
                found.append(b"".join(self.texts[i] for i in numbers[a:b].tolist()).decode(errors="replace").removesuffix(" "))
            return pa.array(found, pa.large_string())
        names = self.strings.take(ids).cast(pa.large_string())
        if names.null_count:
            raise ValueError("an id is not in the vocabulary")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), names), pa.scalar(" ", pa.large_string()))


_READY: dict[int, Bpe] = {}


def ready(raw: bytes) -> Bpe:
    """The tokenizer of this worker; kept between tasks."""
    key = hash(raw)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Bpe(raw)
    return _READY[key]


def _file(path: str | None) -> bytes:
    with open(path or default_path(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs``, ids (array of int) and n_tokens (long)."""
    sent = docs.sparkSession.sparkContext.broadcast(_file(path))  # one tokenizer file, a few megabytes

    def step(batches: Iterator[pa.RecordBatch]):
        tokenizer = ready(sent.value)
        for batch in batches:
            for part in textops.slices(batch, "text"):
                texts = textops.as_strings(part.column("text"))
                ids, offs = tokenizer.encode(texts.to_pylist())
                yield part, {"ids": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids)),
                             "n_tokens": pa.array(np.diff(offs), pa.int64())}

    return add_columns(docs, step, "ids array<int>, n_tokens long")


def decode(rows: DataFrame, path: str | None = None, as_text: bool = False) -> DataFrame:
    """All columns of ``rows`` and decoded, the string of their ``ids`` (null ids: the empty string)."""
    sent = rows.sparkSession.sparkContext.broadcast(_file(path))

    def step(batches: Iterator[pa.RecordBatch]):
        tokenizer = ready(sent.value)
        for batch in batches:
            sizes = np.asarray(batch.column("ids").value_lengths().fill_null(0)).astype(np.int64)
            total, start = np.concatenate([[0], np.cumsum(sizes)]), 0
            while start < len(sizes):  # at most _DECODED ids at a time, one row at least
                stop = max(start + 1, int(np.searchsorted(total, total[start] + _DECODED, side="right")) - 1)
                part = batch.slice(start, stop - start)
                ids = part.column("ids")
                flat = pa.ListArray.from_arrays(pa.array(total[start: stop + 1] - total[start], pa.int32()), ids.flatten())
                yield part, {"decoded": tokenizer.decode(flat, as_text).cast(pa.string())}
                start = stop

    return add_columns(rows, step, "decoded string", text="ids")
