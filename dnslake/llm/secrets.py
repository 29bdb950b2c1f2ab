"""Secrets in text: fixed patterns, and a battery of randomness tests for runs that no pattern knows.

The patterns give the kinds ``assign``, ``access`` and ``hex``.  For the kind ``random`` every maximal run of
token characters (20 or more) is taken, its encoding inferred from its alphabet, and three tests are made
against the hypothesis that its symbols are drawn at random: chi-squared uniformity over classes of the
alphabet, the number of runs above and below the median, and serial correlation at lag one.  Fisher's method
joins them to one p.

Ordinary words fail such tests, but short runs give the tests little power.  So the cut is set per encoding and length
class from the whole input: a first pass counts p of the distinct runs in bins (a run that is copied is one test), Storey's estimate says how many of them are truly
random, and the smallest cut is taken at which at most ``alpha`` of the runs kept are expected to be ordinary.
Only those counts (a few hundred numbers, whatever the input) reach the driver.

Positions are code points, ends are exclusive.  Defined cases: a null text is the empty text and has no
spans; repeated rows are searched one by one; a run that a fixed pattern already covers is still tested, and
both spans stay; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dnslake.llm import textops
from dnslake.llm.frames import add_columns, pack, unpack

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run fails whole, so the limit can stand in the pattern
WORDS_OF_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
BINS = 50
MIN_RUN = 20
ALPHA = 0.05
#: Encodings in the order in which they are tried, with their alphabets in order of value.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {"decimal": _DIGITS, "hex_lower": _DIGITS + "abcdef", "hex_upper": _DIGITS + "ABCDEF",
             "base32": _UPPER + "234567", "alnum": _DIGITS + _UPPER + _LOWER,
             "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
             "mixed": _UPPER + _LOWER + _DIGITS + "+/-_"}
_NAMES = list(ENCODINGS)


def _class_of(symbol: str) -> int:
    return 0 if symbol in _LOWER else 1 if symbol in _UPPER else 2 if symbol in _DIGITS else 3


class _Encoding:
    def __init__(self, alphabet: str):
        self.value = np.full(128, -1, np.int64)
        self.group = np.zeros(128, np.int64)
        quarters = len(alphabet) <= 32  # a small alphabet in four equal parts, a large one by kind of symbol
        for i, symbol in enumerate(alphabet):
            self.value[ord(symbol)] = i
            self.group[ord(symbol)] = i * 4 // len(alphabet) if quarters else _class_of(symbol)
        share = np.bincount([self.group[ord(s)] for s in alphabet], minlength=4) / len(alphabet)
        self.share, self.size = share, len(alphabet)


_TABLES = [_Encoding(a) for a in ENCODINGS.values()]
_IN_RUN = np.zeros(256, bool)
_IN_RUN[[ord(s) for s in ENCODINGS["mixed"]]] = True
_IN_HEX = np.zeros(256, bool)
_IN_HEX[[ord(s) for s in ENCODINGS["hex_lower"]]] = True


def infer(run: np.ndarray) -> int:
    """Number of the narrowest encoding whose alphabet has all bytes of the run."""
    for k, table in enumerate(_TABLES):
        if (table.value[run] >= 0).all():
            return k
    raise ValueError("not a run of token characters")


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared for 1, 2, 3 or an even number of degrees of freedom."""
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df == 3:
        return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    term, total = 1.0, 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def battery(run: np.ndarray, encoding: int) -> tuple[float, float, float]:
    """p of uniformity, of the number of runs and of serial correlation for a run of bytes."""
    table, n = _TABLES[encoding], len(run)
    seen = np.bincount(table.group[run], minlength=4)
    real = table.share > 0
    expected = n * table.share[real]
    uniform = _chi_tail(float(((seen[real] - expected) ** 2 / expected).sum()), int(real.sum()) - 1)
    value = table.value[run]
    high = value * 2 >= table.size
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        mean = 1 + 2 * ups * downs / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        by_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * max(spread, 1e-9)))
    else:
        by_runs = 2.0 ** (1 - n)
    centred = value - value.mean()
    power = float((centred ** 2).sum())
    serial = math.erfc(abs(float((centred[1:] * centred[:-1]).sum()) / power) * math.sqrt(n / 2)) if power else 0.0
    return uniform, by_runs, serial


def p_random(run: np.ndarray, encoding: int) -> float:
    """Fisher's combination of the battery."""
    tests = [max(p, 1e-300) for p in battery(run, encoding)]
    return _chi_tail(-2 * sum(map(math.log, tests)), 2 * len(tests))


def length_class(n: int) -> int:
    return 0 if n < 24 else 1 if n < 32 else 2 if n < 48 else 3 if n < 96 else 4


def cuts(counts: dict[tuple[int, int], np.ndarray], alpha: float = ALPHA) -> dict[tuple[int, int], float]:
    """Smallest p that is kept per (encoding, length class); 2 where nothing is."""
    out = {}
    for key, bins in counts.items():
        total = int(bins.sum())
        half = BINS // 2
        random = min(total, 2 * int(bins[half:].sum()))
        out[key] = 2.0
        for k in range(BINS):
            kept = int(bins[k:].sum())
            if kept and kept - random * (1 - k / BINS) <= alpha * kept:
                out[key] = k / BINS
                break
    return out


def token_runs(data: np.ndarray, offs: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs of allowed bytes inside rows, ``least`` long or longer."""
    inside = np.concatenate([[False], allowed[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    borders = offs[1:-1]
    if len(borders) and len(start):  # a run over a row border is two
        split = np.unique(borders[inside[borders] & inside[np.minimum(borders + 1, len(data))]])
        start, end = np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
    long = end - start >= least
    return start[long], end[long]


def _tested(data: np.ndarray, offs: np.ndarray):
    start, end = token_runs(data, offs, _IN_RUN, MIN_RUN)
    row = np.searchsorted(offs, start, side="right") - 1
    for a, b, r in zip(start.tolist(), end.tolist(), row.tolist()):
        run = data[a:b]
        encoding = infer(run)
        yield a, b, r, (encoding, length_class(b - a)), p_random(run, encoding)


def count_p(docs: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """How many distinct runs of each encoding and length class have p in each bin, over all documents."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                data, offs = textops.flat(part.column("text"))
                start, end = token_runs(data, offs, _IN_RUN, MIN_RUN)
                if len(start):
                    runs = {data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())}
                    marks = [hashlib.blake2b(r, digest_size=16).digest() for r in runs]
                    places = []
                    for r in runs:
                        run = np.frombuffer(r, np.uint8)
                        encoding = infer(run)
                        places.append((encoding, length_class(len(run)), min(BINS - 1, int(p_random(run, encoding) * BINS))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(marks, pa.binary()), *(pa.array(x, pa.int32()) for x in zip(*places))], ["run", "encoding", "size", "bin"])

    # Repeats of a run are dropped before the shuffle and after it: the groups are the distinct runs.
    rows = (docs.select("text").mapInArrow(step, "run binary, encoding int, size int, bin int").distinct()
            .groupBy("encoding", "size", "bin").agg(F.count("*").alias("n")).collect())  # encodings x lengths x bins
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        out.setdefault((r.encoding, r["size"]), np.zeros(BINS, np.int64))[r["bin"]] += r.n
    return out


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


def _rows_with_patterns(data: np.ndarray, offs: np.ndarray) -> list[int]:
    """Rows that may hold a fixed pattern."""
    raw = data.tobytes()
    lower = raw.lower()
    places = token_runs(data, offs, _IN_HEX, 32)[0].tolist()
    for body, word in [(raw, b"AKIA"), *((lower, w) for w in WORDS_OF_ASSIGN)]:
        at = body.find(word)
        while at >= 0:
            places.append(at)
            at = body.find(word, at + 1)
    return np.unique(np.searchsorted(offs, np.array(places, np.int64), side="right") - 1).tolist()


SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """All columns of ``docs`` and spans: array of (kind, start, end), by start and then kind."""
    counts = count_p(docs)
    # A p that not even one of all distinct runs would have by chance is no random run, however few such runs there are.
    least = {key: max(cut, alpha / int(counts[key].sum())) for key, cut in cuts(counts, alpha).items()}

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in textops.slices(batch, "text"):
                data, offs = textops.flat(part.column("text"))
                spans: list[list[tuple[int, int, str]]] = [[] for _ in range(part.num_rows)]
                for row in _rows_with_patterns(data, offs):
                    spans[row] = pattern_spans(data[offs[row]: offs[row + 1]].tobytes().decode())
                found = [(a, b, r) for a, b, r, key, p in _tested(data, offs) if p >= least.get(key, 2.0)]
                if found:
                    a, b, r = (np.array(x, np.int64) for x in zip(*found))
                    start, end = (textops.code_point_offsets(data, offs, x, r) for x in (a, b))
                    for s, e, row in zip(start.tolist(), end.tolist(), r.tolist()):
                        spans[row].append((s, e, "random"))
                        spans[row].sort(key=lambda x: (x[0], KINDS.index(x[2])))
                yield part, {"spans": pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in row]
                                                for row in spans], _SPAN)}

    return add_columns(docs, step, f"spans {SPAN_SQL}")


def joined(spans: str = "spans", kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of the kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, spans: str = "spans"):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "<secret>", alpha: float = ALPHA) -> DataFrame:
    """The documents with the columns they came with; spans that overlap or touch become one mark."""
    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            texts = batch.column("text").to_pylist()
            for i, found in enumerate(spans):
                if not found or texts[i] is None:
                    continue
                text, pieces, done = texts[i], [], 0
                merged: list[list[int]] = []
                for s in found:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                for start, end in merged:
                    pieces += [text[done:start], mark]
                    done = end
                texts[i] = "".join(pieces) + text[done:]
            yield batch, {"text": pa.array(texts, pa.string())}

    done = add_columns(find_secrets(pack(docs, "text"), alpha), step, "text string")
    changed = {}
    if "n_chars" in docs.columns:
        before = F.col("__row").getField("n_chars")
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(before)
    return unpack(done, docs.columns, **changed)
