"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``htmlblocks``).  A block is a vector of hashed parts of its tag path, hashed
words and a few shares; a bidirectional LSTM reads the sequence in both directions, so each label depends on
the whole page.  Blocks with a probability of a half or more are the main text, joined in page order.

The network (numpy, trained on the driver with Adam) learns from at most ``sample`` pages.  Their labels come from
their own markup where it is plain (article, main, nav, ads and the like), and from pages that are built anew from
their blocks in many layouts: other container names, sidebars, notices, forms and reader comments, with names
left out now and then, so that words, lengths, links and neighbours have to speak too.

Defined cases: a null, empty or text-free page has the empty text; a page is judged whole, whatever its length;
repeated pages are judged one by one; without pages to learn from, only the built layouts with stock words teach;
other columns pass through.
"""

from __future__ import annotations

import html
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dnslake.llm import textops
from dnslake.llm.frames import add_columns
from dnslake.llm.htmlblocks import Block, blocks

SAMPLE = 300
BUILT = 900
SAMPLE_CHARS = 60_000
#: Base of the hash that gives a word its bin.
_BIN_BASE = 0x9E3779B97F4A7C15
PATH_BINS, WORD_BINS, SHARES = 1024, 256, 5
INPUT, HIDDEN = 24, 16
EPOCHS = 10
WORDS = textops.lut_alnum_lower()

#: Names that containers of each kind bear, as the markup of public pages has them.
MAIN = ["article", "main", "div content", "div main", "div post", "div entry", "div article", "section article", "div story",
        "div body text", "section content", "div page content", "article post", "main content", "div"]
LINKS = ["nav", "nav menu", "div menu", "ul menu", "div navbar", "div nav", "div breadcrumb", "ul breadcrumbs", "div topbar",
         "div pagination", "div tags", "div categories", "header", "div toc links"]
PROSE = ["div ad", "div ads", "div advert", "div advertisement", "aside ad", "div banner", "div sponsored", "div promo", "aside",
         "div sidebar", "aside sidebar", "div widget", "div related", "section related", "div recommended", "div notice",
         "div cookie", "div cookie notice", "div consent", "div alert", "div newsletter", "div subscribe", "div popup",
         "div modal", "div teaser", "header", "div header", "header site", "div share", "div social", "div author bio"]
TALK = ["div comments", "section comments", "div comment", "ol commentlist", "div replies", "div discussion", "ul comments"]
ENDS = ["footer", "div footer", "footer site", "div copyright", "div legal", "div bottom"]
NOT_MAIN = {"nav", "aside", "footer", "form", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sidebar", "menu",
            "comment", "comments", "cookie", "consent", "newsletter", "related", "share", "social", "notice", "popup", "header"}
STOCK = ("the of and to in is that it was for on are with as his they be at one have this from or had by").split()


# -- features ---------------------------------------------------------------------------------------

def _bin(text: str, bins: int) -> int:
    return zlib.crc32(text.encode()) % bins


class _Paths:
    """Bins of a tag path, remembered."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, ...], list[int]] = {}

    def __call__(self, path: tuple[str, ...]) -> list[int]:
        got = self.seen.get(path)
        if got is None:
            names, parts = [e.split(" ") for e in path], set()
            for k, element in enumerate(names):
                parts.update(f"in {w}" if i else f"tag {w}" for i, w in enumerate(element))
                if k:
                    parts.add(f"{names[k - 1][0]}>{element[0]}")
            if names:
                parts.update([f"last {names[-1][0]}", f"depth {len(names)}"])
            got = sorted({_bin(p, PATH_BINS) for p in parts})
            if len(self.seen) < 20_000:
                self.seen[path] = got
        return got


_PATHS = _Paths()


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages."""
    every = [b for page in pages for b in page]
    x = np.zeros((len(every), PATH_BINS + WORD_BINS + SHARES), np.float32)
    if not every:
        return x
    for i, block in enumerate(every):
        bins = _PATHS(block.path)
        x[i, bins] = 1 / np.sqrt(max(1, len(bins)))
    words = textops.Words(*textops.flat(pa.array([b.text for b in every], pa.large_string())), WORDS)
    code = textops.range_hashes(WORDS[words.data], words.starts, words.ends, _BIN_BASE)
    place = words.row * WORD_BINS + (code % np.uint64(WORD_BINS)).astype(np.int64)
    counts = np.bincount(place, minlength=len(every) * WORD_BINS).reshape(len(every), WORD_BINS)
    x[:, PATH_BINS: PATH_BINS + WORD_BINS] = counts / np.sqrt(np.maximum(1, (counts * counts).sum(1)))[:, None]
    size = np.array([len(b.text) for b in every])
    ordinal = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages])
    ends = np.array([b.text[-1] in ".!?:;\"')" for b in every])
    x[:, -SHARES:] = np.c_[np.log1p(size) / 6, [b.links for b in every], ends, ordinal, np.log1p(words.counts) / 4]
    return x


# -- network ----------------------------------------------------------------------------------------

def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = PATH_BINS + WORD_BINS + SHARES
    p = {"in": rng.standard_normal((d, INPUT)) * 0.3, "in0": np.zeros(INPUT),
         "out": rng.standard_normal(2 * HIDDEN) * 0.3, "out0": np.zeros(1)}
    for side in "fb":
        p[f"x{side}"] = rng.standard_normal((INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)
        p[f"h{side}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
        p[f"c{side}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gates begin open
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(z: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, keep: bool):
    """One direction over (pages, steps, 4 * HIDDEN) inputs; masked steps leave the state as it is."""
    n, steps, _ = z.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        a = z[:, t] + h @ recurrent
        f, i, o = (_sigmoid(a[:, k * HIDDEN: (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN:])
        m = mask[:, t, None]
        new = f * c + i * g
        if keep:
            tape.append((f, i, o, g, c, new, h))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[:, t] = h
    return out, tape


def _back(d_out, mask, recurrent, tape):
    """Gradients of the step inputs and of the recurrent weights."""
    n, steps, _ = d_out.shape
    dz = np.zeros((n, steps, 4 * HIDDEN), np.float32)
    dh, dc, dr = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros_like(recurrent)
    for t in range(steps - 1, -1, -1):
        f, i, o, g, c, new, h = tape[t]
        m = mask[:, t, None]
        dh = dh + d_out[:, t]
        squashed = np.tanh(new)
        dnew = np.where(m, dc + dh * o * (1 - squashed * squashed), 0)
        da = np.concatenate([dnew * c * f * (1 - f), dnew * g * i * (1 - i), np.where(m, dh * squashed, 0) * o * (1 - o),
                             dnew * i * (1 - g * g)], axis=1)
        dz[:, t] = da
        dr += h.T @ da
        dc = np.where(m, dnew * f, dc)
        dh = np.where(m, da @ recurrent.T, dh)
    return dz, dr


def _padded(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place of each block in a padded batch, mask)."""
    steps = max(sizes)
    mask = np.arange(steps)[None, :] < np.array(sizes)[:, None]
    return np.flatnonzero(mask), mask


def _spread(values: np.ndarray, place: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.zeros((mask.size, values.shape[1]), np.float32)
    out[place] = values
    return out.reshape(*mask.shape, -1)


def _flip(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse order; the padding stays behind."""
    size = mask.sum(1)[:, None]
    at = np.arange(mask.shape[1])[None, :]
    index = np.where(at < size, size - 1 - at, at)
    return np.take_along_axis(x, index[..., None], 1)


def _forward(p, x, sizes, keep=False):
    place, mask = _padded(sizes)
    u = np.tanh(x @ p["in"] + p["in0"])
    seq = _spread(u, place, mask)
    hf, tf = _run(seq @ p["xf"] + p["cf"], mask, p["hf"], keep)
    back = _flip(seq, mask)
    hb, tb = _run(back @ p["xb"] + p["cb"], mask, p["hb"], keep)
    both = np.concatenate([hf, _flip(hb, mask)], axis=2).reshape(mask.size, -1)[place]
    prob = _sigmoid(both @ p["out"] + p["out0"])
    return prob, (place, mask, u, seq, back, tf, tb, both)


def _gradients(p, x, y, sizes):
    prob, (place, mask, u, seq, back, tf, tb, both) = _forward(p, x, sizes, keep=True)
    d = ((prob - y) / len(y)).astype(np.float32)
    g = {"out": both.T @ d, "out0": d.sum(keepdims=True)}
    d_both = _spread(d[:, None] * p["out"], place, mask)
    d_seq = np.zeros_like(seq)
    for side, d_h, source, tape in (("f", d_both[..., :HIDDEN], seq, tf), ("b", _flip(d_both[..., HIDDEN:], mask), back, tb)):
        dz, g[f"h{side}"] = _back(d_h, mask, p[f"h{side}"], tape)
        g[f"x{side}"] = np.einsum("nti,ntj->ij", source, dz)
        g[f"c{side}"] = dz.sum((0, 1))
        d_in = dz @ p[f"x{side}"].T
        d_seq += d_in if side == "f" else _flip(d_in, mask)
    d_u = d_seq.reshape(mask.size, -1)[place] * (1 - u * u)
    g["in"], g["in0"] = x.T @ d_u, d_u.sum(0)
    loss = -np.mean(np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)))
    return loss, g


def fit(pages: list[list[Block]], seed: int = 0, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights learned from blocks whose ``keep`` is the label."""
    rng = np.random.default_rng(seed)
    p = _initial(rng)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    ready = [(features([page]), np.array([b.keep for b in page], np.float32)) for page in pages if page]
    ready.sort(key=lambda r: len(r[1]))
    batches = [ready[k: k + 24] for k in range(0, len(ready), 24)]
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x = np.concatenate([r[0] for r in batches[k]])
            y = np.concatenate([r[1] for r in batches[k]])
            _, g = _gradients(p, x, y, [len(r[1]) for r in batches[k]])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for name, value in g.items():
                value = np.clip(value, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * value
                second[name] = 0.99 * second[name] + 0.01 * value * value
                p[name] -= (rate * first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return p


# -- what to learn from -----------------------------------------------------------------------------

def plain_label(block: Block) -> bool | None:
    """What the markup itself says of a block: main text, not main text, or nothing."""
    names = {w for e in block.path for w in e.split(" ")}
    if names & NOT_MAIN:
        return False
    if names & {"article", "main"}:
        return True
    return None


def labelled(page: str) -> list[Block] | None:
    """The blocks of a page with labels from its markup; None where that has no article."""
    found = blocks(page)
    if not any(plain_label(b) for b in found):
        return None
    for b in found:
        b.keep = bool(plain_label(b))
    return found


def _open(name: str, rng: random.Random, blank: float) -> tuple[str, str]:
    tag, *words = name.split(" ")
    attribute = ""
    if words and rng.random() >= blank:
        form = rng.choice(["-", " ", "_"]).join(words)
        attribute = rng.choice([f' class="{form}"', f' id="{form}"', f' class="{form} x{rng.randrange(9)}"'])
    return f"<{tag}{attribute}>", f"</{tag}>"


def built_page(prose: list[str], rng: random.Random) -> str:
    """A page in a random layout; its main blocks bear ``data-keep``."""
    blank = rng.choice([0.0, 0.0, 0.1, 0.3])
    text = lambda: html.escape(rng.choice(prose))
    few = lambda n: html.escape(" ".join(rng.choice(prose).split()[:n]) or "x")

    def links(name: str) -> str:
        a, b = _open(name, rng, blank)
        items = [f'<a href="/">{few(rng.randint(1, 4))}</a>' for _ in range(rng.randint(2, 9))]
        body = "".join(f"<li>{i}</li>" for i in items)
        return a + (body if name.startswith("ul") else f"<ul>{body}</ul>" if rng.random() < 0.7 else " | ".join(items)) + b

    def aside(name: str) -> str:
        a, b = _open(name, rng, blank)
        parts = [few(rng.randint(3, 25)) if rng.random() < 0.5 else text() for _ in range(rng.choice([1, 1, 1, 2, 3]))]
        body = parts[0] if len(parts) == 1 and rng.random() < 0.7 else "".join(
            (f"<h3>{few(3)}</h3>" if rng.random() < 0.3 else "") + f"<p>{t}</p>" for t in parts)
        return a + body + b

    def talk(name: str) -> str:
        a, b = _open(name, rng, 0.0)
        one = [f'<div class="comment"><b>{few(1)}</b> <p>{text()}</p></div>' if rng.random() < 0.6 else f"<li><p>{text()}</p></li>"
               for _ in range(rng.randint(1, 6))]
        return a + (f"<h3>{few(2)}</h3>" if rng.random() < 0.5 else "") + "".join(one) + b

    def form() -> str:
        return f'<form><label>{few(2)}</label><input name="a"><button>{few(1)}</button>{f"<p>{few(12)}</p>" if rng.random() < 0.5 else ""}</form>'

    def article() -> str:
        name = rng.choice(MAIN)
        a, b = _open(name, rng, blank)
        out = [a]
        if rng.random() < 0.85:
            out.append(f"<h1 data-keep=1>{few(rng.randint(2, 12))}</h1>")
        for k in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.08:
                out.append(f"<h2 data-keep=1>{few(rng.randint(1, 7))}</h2>")
            elif kind < 0.13:
                out.append("<ul>" + "".join(f"<li data-keep=1>{few(rng.randint(2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.17:
                out.append(f"<blockquote data-keep=1>{text()}</blockquote>")
            elif kind < 0.20:
                out.append(f"<table><tr><td data-keep=1>{few(2)}</td><td data-keep=1>{few(3)}</td></tr></table>")
            elif kind < 0.22:
                out.append(f"<pre data-keep=1>{few(9)}</pre>")
            body = text() if rng.random() < 0.8 else few(rng.randint(1, 14))
            out.append(f"<p data-keep=1>{'<b>' if rng.random() < 0.15 else ''}{body}" + rng.choice(["</p>", "</p>", "<br>"]))
            if rng.random() < 0.06:
                out.append(rng.choice([aside, aside, talk])(rng.choice(["div ad", "aside related", "div share", "div newsletter"])))
        if rng.random() < 0.2:
            out.append(talk(rng.choice(TALK)))
        return "".join(out) + b

    before = [links(rng.choice(LINKS)) for _ in range(rng.randint(0, 2))] + [aside(rng.choice(PROSE)) for _ in range(rng.randint(0, 2))]
    after = [aside(rng.choice(PROSE)) for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.4:
        after.append(talk(rng.choice(TALK)))
    for parts in (before, after):
        if rng.random() < 0.25:
            parts.append(form())
        rng.shuffle(parts)
    if rng.random() < 0.8:
        a, b = _open(rng.choice(ENDS), rng, blank)
        after.append(f"{a}&copy; {few(rng.randint(1, 20))}{b}")
    wrap = rng.choice([("", ""), ("", ""), ("<div class=wrapper>", "</div>"), ("<div id=page><div>", "</div></div>")])
    return f"<body>{wrap[0]}{''.join(before)}{article()}{''.join(after)}{wrap[1]}</body>"


def train(pages: DataFrame, sample: int = SAMPLE, built: int = BUILT, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights from at most ``sample`` pages (by a hash of their id) and ``built`` layouts of their blocks."""
    fit_for = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS)).select(
        "html", F.xxhash64("html", F.lit(seed)).alias("deal"))
    # Only hashes meet on the driver first; then the chosen pages come, one of equal ones.
    last = [r.deal for r in fit_for.select("deal").distinct().orderBy("deal").limit(sample).collect()][-1:]
    rows = sorted(fit_for.where(F.col("deal") <= (last[0] if last else 0)).groupBy("deal").agg(
        F.first("html").alias("html")).collect(), key=lambda r: r.deal) if last else []
    plain = [p for p in (labelled(r.html) for r in rows) if p]
    prose = [b.text for p in plain for b in p if 1 <= len(b.text) <= 3000] or [
        " ".join(STOCK[i % 7: i % 7 + n]) + "." for i, n in enumerate(range(2, 22))]
    rng = random.Random(seed)
    return fit(plain + [blocks(built_page(prose, rng)) for _ in range(built)], seed)


def _probabilities(weights, pages: list[list[Block]]) -> list[np.ndarray]:
    """Per page, the probability of each block; pages of like size run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    start = 0
    while start < len(order):
        stop, total = start, 0
        while stop < len(order) and (stop == start or total + len(pages[order[stop]]) <= 4096):
            total += len(pages[order[stop]])
            stop += 1
        chosen = order[start:stop]
        sizes = [len(pages[k]) for k in chosen]
        prob, _ = _forward(weights, features([pages[k] for k in chosen]), sizes)
        for k, part in zip(chosen, np.split(prob, np.cumsum(sizes)[:-1])):
            out[k] = part
        start = stop
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``pages``, text (main blocks, one per line) and n_chars (its code points)."""
    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in textops.slices(batch, "html"):
                found = [blocks(page) for page in textops.as_strings(part.column("html")).to_pylist()]
                texts = ["\n".join(b.text for b, p in zip(page, prob) if p >= 0.5)
                         for page, prob in zip(found, _probabilities(weights, found))]
                yield part, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return add_columns(pages, step, "text string, n_chars long", text="html")
