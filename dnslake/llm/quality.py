"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Each text is seen in three views: its bytes, the shape of its characters, and the shape of its words
(case, punctuation, repetition of the word before).  Every view is cut into pieces and compressed twice,
with a dictionary of good and one of bad labelled text.  The difference of the two sizes, divided by the
length, is the evidence of the view; a logistic curve fitted on held-back labelled rows turns the three
differences into a score.

Only a bounded sample of labelled rows is read for fitting (``dict_rows`` per class, ``fit_rows`` for the
curve, texts up to ``sample_chars``); every text of the input is scored, whole.

Defined cases: a null text scores as the empty text; an empty text gets the score of zero evidence; rows
with a null ``doc_id`` are scored and never used for fitting; labels other than 0 and 1 are ignored; of
several labels of one id the smallest counts; a class without labelled rows gives every text the share of
label 1 (0.5 without any label); repeated rows are scored one by one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from dnslake.llm import textops
from dnslake.llm.frames import add_columns, bound_text, pack, unpack

THRESHOLD = 0.3
PIECE = 2048
LEVEL = 3
#: Bytes added to the length before dividing, so that a few bytes of a short text weigh little.
DAMPING = 60
VIEWS = ("bytes", "shape", "words")
DICT_BYTES = {"bytes": 112_640, "shape": 16_384, "words": 16_384}


def held_out(doc_id: Column) -> Column:
    """Rows never used for fitting: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _shape_table() -> np.ndarray:
    table = np.full(256, ord("#"), np.uint8)
    table[97:123] = ord("a")
    table[128:] = ord("a")
    table[65:91] = ord("A")
    table[48:58] = ord("0")
    for b in b" \n\t.,;:!?|$%&*#'\"-":
        table[b] = b
    return table


SHAPE = _shape_table()
BLANKS = textops.lut_blank_separated()


def views(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row offsets) of each view of a slice of texts."""
    words = textops.Words(data, offs, BLANKS)
    code = np.zeros(len(words), np.uint8)
    if len(words):
        first, second = data[words.starts], data[np.minimum(words.starts + 1, words.ends - 1)]
        last = data[words.ends - 1]
        upper = (first >= 65) & (first < 91)
        code = (1 + upper + 2 * ((second >= 65) & (second < 91)) + 4 * np.minimum(words.ends - words.starts - 1, 3)
                ).astype(np.uint8)
        code += np.where(SHAPE[last] == ord("a"), 0, np.where((last == 46) | (last == 44), 16, 32)).astype(np.uint8)
        again = np.zeros(len(words), bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        code[again] |= 128
    return [(data, offs), (SHAPE[data], offs), (code, words.first)]


def _compressor(dictionary: bytes, kind: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind),
        write_content_size=False, write_checksum=False, write_dict_id=False)


def _train(pieces: list[bytes], size: int) -> tuple[bytes, int]:
    """A trained dictionary; of too few pieces, their own bytes."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:] or b"        ", zstandard.DICT_TYPE_RAWCONTENT


@dataclass
class Model:
    """Dictionaries of (good, bad) per view, the curve, and the score where no class can be learned."""

    dictionaries: list[list[tuple[bytes, int]]] = field(default_factory=list)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.5

    def evidence(self, text: pa.Array) -> np.ndarray:
        """Per text and view: (size under bad - size under good) / (length + DAMPING)."""
        packers = getattr(self, "_packers", None)
        if packers is None:
            packers = self._packers = [[_compressor(*d) for d in pair] for pair in self.dictionaries]
        data, offs = textops.flat(text)
        out = np.zeros((len(offs) - 1, len(self.dictionaries)))
        for v, (body, at) in enumerate(views(data, offs)):
            raw, (good, bad) = body.tobytes(), packers[v]
            for i in range(len(at) - 1):
                difference = 0
                for start in range(at[i], at[i + 1], PIECE):
                    piece = raw[start: min(start + PIECE, at[i + 1])]
                    difference += len(bad.compress(piece)) - len(good.compress(piece))
                out[i, v] = difference / (at[i + 1] - at[i] + DAMPING)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def score(self, text: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(text), self.constant)
        return _curve(self.evidence(text), self.centre, self.scale, self.weights)


def _curve(x, centre, scale, weights):
    z = np.clip((x - centre) / scale @ weights[:-1] + weights[-1], -30, 30)
    return 1 / (1 + np.exp(-z))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 40):
    """Ridge logistic regression by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return centre, scale, w


def _sliced(texts: list[str]) -> Iterator[pa.Array]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    return (part.column("text") for part in textops.slices(batch, "text"))


def _pieces(texts: list[str]) -> list[list[bytes]]:
    """Per view, the pieces of all texts."""
    out: list[list[bytes]] = [[] for _ in VIEWS]
    for part in _sliced(texts):
        for v, (body, at) in enumerate(views(*textops.flat(part))):
            out[v] += [body[s: min(s + PIECE, at[i + 1])].tobytes() for i in range(len(at) - 1)
                       for s in range(at[i], at[i + 1], PIECE)]
    return out


def train(docs: DataFrame, labels: DataFrame, dict_rows: int = 1500, fit_rows: int = 5000,
          sample_chars: int = 40_000) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Rows are dealt by a hash of their id: one half can go into dictionaries (at most ``dict_rows`` of
    each class), the other into the curve (at most ``fit_rows``).  ``sample_chars`` bounds what one
    row of the sample can bring to the driver.
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
             .withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
             .withColumn("deal", F.xxhash64("doc_id", F.lit("deal"))))

    def some(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy("deal", "doc_id").limit(n)

    first = known.where("half = 0")
    chosen = (some(first.where("quality = 1"), dict_rows).unionByName(some(first.where("quality = 0"), dict_rows))
              .unionByName(some(known.where("half = 1"), fit_rows)).select("doc_id", "quality", "half"))
    sample = (docs.select(F.col("doc_id").cast("long"), bound_text(docs).alias("text"))
              .where(F.length("text") <= sample_chars)
              .join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
              .dropDuplicates(["doc_id"]).collect())  # at most 2 * dict_rows + fit_rows rows
    sample.sort(key=lambda r: r.doc_id)
    groups = {q: [r.text for r in sample if r.half == 0 and r.quality == q] for q in (1, 0)}
    curve = [r for r in sample if r.half == 1]
    y = np.array([r.quality for r in curve], float)
    if not groups[1] or not groups[0] or not 0 < y.sum() < len(y):
        every = [r.quality for r in sample]
        return Model(constant=float(np.mean(every)) if every else 0.5)
    good, bad = _pieces(groups[1]), _pieces(groups[0])
    model = Model([[_train(good[v], DICT_BYTES[k]), _train(bad[v], DICT_BYTES[k])] for v, k in enumerate(VIEWS)])
    x = np.concatenate([model.evidence(part) for part in _sliced([r.text for r in curve])])
    model.centre, model.scale, model.weights = _logistic(x, y)
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and ``score`` (double) and ``predicted`` (int)."""
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                score = model.score(part.column("text"))
                yield part, {"score": pa.array(score, pa.float64()),
                             "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())}

    return add_columns(docs, scores, "score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents that the classifier accepts, with the columns they came with."""
    scored = score_documents(pack(docs, "text"), train(docs, labels, **bounds))
    return unpack(scored.where("predicted = 1"), docs.columns)
