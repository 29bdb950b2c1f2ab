"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The model file gives pieces and scores of a merge-type model (byte fallback, a blank before the text).  A text
is cut before each stretch of blanks; as no piece runs from a letter into a blank, such chunks are encoded
on their own.  In a chunk the agenda holds the neighbouring symbols that join to a piece; the best score is
taken first, the leftmost of equals.  A candidate is skipped for good if a keyed hash of (seed, row's key,
chunk's number, chunk, its ends and its piece) falls below the dropout, so every occurrence of a chunk draws anew, and
the same seed and row always give the same pieces.  Without dropout the pieces are those of the model itself.

Agendas of all short chunks advance together as numpy matrices, one merge a round; a long chunk has a heap of its
own.  Without dropout each chunk is encoded once and remembered.  With ``variants`` a chunk has only so many
segmentations per seed, chosen by the row's key and the chunk's number, and these are remembered in the same way.

Symbols that the model does not know, U+2581 in the text among them, become byte pieces; every text is decoded
and compared before it is returned, so ids always decode to the exact text.  Defined cases: null and empty
texts have no pieces, and a null text stays null; rows of equal id and text get equal pieces; a
null id is a key like any other; other columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dnslake.llm import textops
from dnslake.llm.frames import add_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
#: Longest chunk that is encoded in a matrix.
MATRIX = 48
_WIDTHS = (4, 8, 12, 16, 24, 32, MATRIX)
_U = np.uint64
_MASK = (1 << 64) - 1
_BLANK, _MARK = 0x20, "▁"
_NONE = np.int32(1 << 30)
#: Chunks whose pieces a worker remembers.
REMEMBERED = 400_000


class Model:
    """Pieces of a merge-type model as arrays."""

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                              or model.is_unused(i))]
        if any(_MARK in names[i].lstrip(_MARK) for i in normal):
            raise ValueError("a piece runs over a blank; chunks cannot be encoded on their own")
        self.byte_id = np.zeros(256, np.int64)
        texts = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_id[value], texts[i] = i, bytes([value])
        place = {}
        for i in normal:
            place[names[i]] = i
            texts[i] = names[i].replace(_MARK, " ").encode()
        # Letters that only stand inside longer pieces are symbols too; as results they become bytes.
        letters = sorted({c for i in normal for c in names[i]} - set(place))
        extra = {c: n + k for k, c in enumerate(letters)}
        symbols = {**place, **extra}
        self.n, self.letters = n, letters
        self.code_point = np.full(0x110000, -1, np.int64)
        for symbol, i in symbols.items():
            if len(symbol) == 1 and symbol != _MARK:
                self.code_point[ord(symbol)] = i
        if _MARK in place:
            self.code_point[_BLANK] = place[_MARK]
        order = sorted(normal, key=lambda i: -model.get_score(i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        for i in normal:
            name = names[i]
            for k in range(1, len(name)):
                left, right = symbols.get(name[:k]), symbols.get(name[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = (rank[i], i)
        keys = sorted(pairs)
        self.pair_key = np.array(keys, np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in keys], np.int32)
        self.by_rank = np.array(order, np.int64)
        self.pairs = pairs
        # A table of the pairs by hash answers most look-ups that find nothing.
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[self._slot(self.pair_key)] = True
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._forget(0.0)

    def _forget(self, dropout: float) -> None:
        self.dropout = dropout
        self.known, self.known_ids = np.zeros(0, _U), np.zeros(0, np.int64)
        self.known_count = np.zeros(0, np.int64)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(43)).astype(np.int64)

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair makes; _NONE where it makes none."""
        key = (left.astype(np.int64) << 20) | right
        rank = np.full(len(key), _NONE, np.int32)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        known = known[self.maybe[self._slot(key[known])]]
        at = np.minimum(np.searchsorted(self.pair_key, key[known]), len(self.pair_key) - 1)
        same = self.pair_key[at] == key[known]
        rank[known[same]] = self.pair_rank[at[same]]
        return rank

    # -- agendas -----------------------------------------------------------------------------------

    def matrix(self, symbols: np.ndarray, length: np.ndarray, key: np.ndarray, dropout: float):
        """Segment chunks of up to the matrix's width: symbols (left-packed) and their number."""
        rows, width = symbols.shape
        sym, size = symbols.astype(np.int32), length.astype(np.int32)
        place = np.broadcast_to(np.arange(width, dtype=np.int16), sym.shape).copy()
        rank = np.full((rows, width), _NONE, np.int32)
        row, col = np.nonzero(np.arange(width - 1)[None, :] < (size - 1)[:, None])
        self._refresh(sym, place, key, rank, row, col, dropout)
        done_sym, done_size = sym.copy(), size.copy()
        alive = np.arange(rows)
        while len(alive):
            best = rank.argmin(1)
            at = np.arange(len(alive))
            least = rank[at, best]
            open_ = least < _NONE
            if not open_.all():
                shut = ~open_
                done_sym[alive[shut], : sym.shape[1]], done_size[alive[shut]] = sym[shut], size[shut]
                alive, best, least, sym, place, size, key, rank = (
                    x[open_] for x in (alive, best, least, sym, place, size, key, rank))
                if not len(alive):
                    break
                at = np.arange(len(alive))
            sym[at, best] = self.by_rank[least]
            keep = np.ones(sym.shape, bool)
            keep[at, best + 1] = False  # the right one of the two leaves its row
            shape = (len(alive), sym.shape[1] - 1)
            sym, place, rank = (x[keep].reshape(shape) for x in (sym, place, rank))
            size = size - 1
            rank[at, best] = _NONE
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < size - 1)
            self._refresh(sym, place, key, rank, np.concatenate([before, after]),
                          np.concatenate([best[before] - 1, best[after]]), dropout)
        return done_sym, done_size

    def _refresh(self, sym, place, key, rank, row, col, dropout) -> None:
        new = self.joins(sym[row, col], sym[row, col + 1])
        if dropout > 0:
            found = np.flatnonzero(new < _NONE)
            r, c = row[found], col[found]
            draw = _draw(key[r], place[r, c], place[r, c + 1], self.by_rank[new[found]])
            new[found[draw < dropout]] = _NONE
        rank[row, col] = new

    def heap(self, symbols: list[int], key: int, dropout: float) -> list[int]:
        """The same for one chunk of any length."""
        n = len(symbols)
        sym, ahead, behind = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        version, agenda = [0] * n, []

        def offer(i: int) -> None:
            j = ahead[i]
            if j >= n or sym[i] < 0 or sym[j] < 0:
                return
            found = self.pairs.get(sym[i] << 20 | sym[j])
            if found and not (dropout > 0 and _draw_one(key, i, j, found[1]) < dropout):
                heapq.heappush(agenda, (found[0], i, j, version[i], version[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, vi, vj, merged = heapq.heappop(agenda)
            if version[i] != vi or version[j] != vj or ahead[i] != j:
                continue
            sym[i], version[i], version[j] = merged, vi + 1, -1
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            offer(i)
            if behind[i] >= 0:
                offer(behind[i])
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = ahead[i]
        return out

    # -- texts -------------------------------------------------------------------------------------

    def encode(self, text: pa.Array, keys: np.ndarray, dropout: float, variants: int | None, seed: int):
        """(ids, offsets per row) of a slice of texts; without ``variants`` each occurrence of a chunk draws anew."""
        texts = textops.as_strings(text).to_pylist()
        whole = "".join(" " + t if t else "" for t in texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        blank = points == _BLANK
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[offs[:-1][sizes > 0]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(points))
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        row = np.searchsorted(offs, start, side="right") - 1
        number = np.arange(len(start)) - np.searchsorted(start, offs[:-1])[row]
        which = textops.mix(keys[row].astype(_U) + number.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed & _MASK))
        if variants:
            which %= _U(variants)
        elif dropout <= 0:
            which[:] = 0
        code = textops.range_hashes(points, start, end, 0xA0761D6478BD642F)
        key = textops.mix(code ^ (which + _U(1)) * _U(0xE7037ED1A0B428DB) ^ _U(seed * 0x8EBC6AF09C88C6E3 & _MASK))
        if variants or dropout <= 0:
            out, count = self._remembered(points, start, end, key, dropout)
        else:
            out, count = self._chunks(points, start, end, key, dropout)
        wanted = np.frombuffer(whole.encode(), np.uint8)
        if not np.array_equal(self.decoded(out), wanted):  # two chunks with one hash: tell them apart by their text
            names: dict[tuple[str, int], int] = {}
            place = np.array([names.setdefault((whole[a:b], int(v)), len(names)) for a, b, v in zip(start, end, which)])
            one = np.unique(place, return_index=True)[1]
            ids, count = self._chunks(points, start[one], end[one], key[one], dropout)
            out = self._spread(ids, count, place)
            count = count[place]
            if not np.array_equal(self.decoded(out), wanted):
                raise RuntimeError("pieces do not decode to their text")
        per_row = np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per_row)])

    def _remembered(self, points, start, end, key, dropout) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and the number of each; chunks seen more than once are remembered."""
        if dropout != self.dropout:
            self._forget(dropout)
        keys, one, place, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        old = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~old)
        fresh, fresh_count = self._chunks(points, start[one[new]], end[one[new]], keys[new], dropout)
        fresh_begin = np.cumsum(fresh_count) - fresh_count
        known_begin = np.cumsum(self.known_count) - self.known_count
        pool = np.concatenate([self.known_ids, fresh])
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[old], count[old] = known_begin[at[old]], self.known_count[at[old]]
        begin[new], count[new] = fresh_begin + len(self.known_ids), fresh_count
        again = new[times[new] > 1]
        if len(again) and len(self.known) + len(again) <= REMEMBERED:
            merged = np.concatenate([self.known, keys[again]])
            order = np.argsort(merged, kind="stable")
            all_begin = np.concatenate([known_begin, begin[again]])[order]
            self.known_count = np.concatenate([self.known_count, count[again]])[order]
            self.known, self.known_ids = merged[order], textops.ragged(pool, all_begin, self.known_count)
        return textops.ragged(pool, begin[place], count[place]), count[place]

    @staticmethod
    def _spread(ids: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
        begin = np.cumsum(count) - count
        return textops.ragged(ids, begin[place], count[place])

    def _chunks(self, points, start, end, key, dropout) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and the number of each."""
        length = end - start
        found = self.code_point[points]
        symbols = np.where(found >= 0, found, -2 - points)
        results: list[tuple[np.ndarray, np.ndarray]] = []  # chunk numbers, symbols
        low = 0
        for width in _WIDTHS:
            mine = np.flatnonzero((length > low) & (length <= width))
            low = width
            for part in np.array_split(mine, max(1, len(mine) * width // 400_000)):
                if not len(part):
                    continue
                columns = np.arange(width)
                inside = columns < length[part, None]
                index = np.where(inside, start[part, None] + columns, 0)
                sym, size = self.matrix(np.where(inside, symbols[index], -1), length[part], key[part], dropout)
                keep = columns < size[:, None]
                results.append((np.repeat(part, size), sym[keep]))
        for i in np.flatnonzero(length > MATRIX).tolist():
            sym = self.heap(symbols[start[i]: end[i]].tolist(), int(key[i]), dropout)
            results.append((np.full(len(sym), i), np.array(sym, np.int64)))
        if not results:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunk = np.concatenate([r[0] for r in results])
        sym = np.concatenate([r[1] for r in results]).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        chunk, sym = chunk[order], sym[order]
        raw = np.flatnonzero((sym < 0) | (sym >= self.n))
        if len(raw):  # symbols that are no piece become their bytes
            width = np.ones(len(sym), np.int64)
            letters = [chr(-2 - s) if s < 0 else self.letters[s - self.n] for s in sym[raw].tolist()]
            body = [c.encode() for c in letters]
            width[raw] = [len(b) for b in body]
            chunk, sym = np.repeat(chunk, width), np.repeat(sym, width)
            at = np.repeat((np.cumsum(width) - width)[raw], width[raw])
            at = at + np.concatenate([np.arange(len(b)) for b in body])
            sym[at] = self.byte_id[np.frombuffer(b"".join(body), np.uint8)]
        return sym, np.bincount(chunk, minlength=len(start))

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, the blank before each text included."""
        return textops.ragged(self.bytes, self.start[ids], self.length[ids])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        size = np.concatenate([[0], np.cumsum(self.length[ids])])
        raw = self.decoded(ids).tobytes()
        return [raw[a + 1: b].decode() if b > a else "" for a, b in zip(size[offs[:-1]].tolist(), size[offs[1:]].tolist())]


def _draw(key, left, middle, piece) -> np.ndarray:
    x = key ^ left.astype(_U) * _U(0x9E3779B97F4A7C15) ^ middle.astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    return (textops.mix(x ^ piece.astype(_U) * _U(0x165667B19E3779F9)) >> _U(11)) * 2.0 ** -53


def _draw_one(key: int, left: int, middle: int, piece: int) -> float:
    return float(_draw(np.array([key], _U), np.array([left]), np.array([middle]), np.array([piece]))[0])


_READY: dict[int, Model] = {}


def ready_model(proto: bytes) -> Model:
    """The model of this worker; kept between tasks."""
    key = hash(proto)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Model(proto)
    return _READY[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, variants: int | None = None,
           seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, pieces (array of int) and n_pieces (long)."""
    if not 0 <= dropout <= 1 or variants is not None and variants < 1:
        raise ValueError("dropout must be from 0 to 1 and variants 1 or more")
    sent = docs.sparkSession.sparkContext.broadcast(_read(model))  # the model file, under a megabyte

    def step(batches: Iterator[pa.RecordBatch]):
        ready = ready_model(sent.value)
        for batch in batches:
            for part in textops.slices(batch, "text"):
                ids, offs = ready.encode(part.column("text"), part.column("__key").to_numpy(), dropout, variants, seed)
                yield part, {"pieces": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())),
                             "n_pieces": pa.array(np.diff(offs), pa.int64())}

    keyed = docs.withColumn("__key", F.xxhash64("doc_id"))
    return add_columns(keyed, step, "pieces array<int>, n_pieces long").drop("__key")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and decoded: the text of the pieces (null pieces: the empty text)."""
    sent = rows.sparkSession.sparkContext.broadcast(_read(model))

    def step(batches: Iterator[pa.RecordBatch]):
        ready = ready_model(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column("pieces")
                offs = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))])
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield part, {"decoded": pa.array(ready.decode(ids, offs.astype(np.int64)), pa.string())}

    return add_columns(rows, step, "decoded string", text="pieces")
