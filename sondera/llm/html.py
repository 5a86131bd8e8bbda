"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags, each
with the path of open tags above it.  A block's vector has the tags of its path and its words, both
hashed, and a few counts.  A bidirectional LSTM in numpy reads the whole sequence and labels each block
as content or not, so that a block is judged in the context of its document.

It is trained here on a bounded sample of pages whose landmark elements (article, main; nav,
footer, aside, advertisements) tell what a block is.  Every page is shown twice, once with those
landmarks taken out of the paths, so that the network also learns from words, shapes and
surroundings and works on pages without landmarks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, picked
from .textvec import token_hashes

#: Bound of the sample of pages on which the network is trained.
MOST_PAGES = 400
TAGS, WORDS, COUNTS, HIDDEN = 48, 64, 6, 16
WIDTH = TAGS + WORDS + COUNTS
PADDED = 20_000  # blocks, with padding, that are run together

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)/?>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+)|<",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("div article section main body ul ol dl table tbody td th nav aside footer header form blockquote".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_GOOD = frozenset(("article", "main", ".article", ".main", ".content"))
_BAD = frozenset(("nav", "footer", "aside", "header", ".ad", ".ads", ".nav", ".menu", ".footer", ".sidebar", ".promo", ".banner", ".breadcrumb", ".comments"))


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters within links


def blocks(page: str) -> tuple[list[Block], str]:
    """The blocks of a page in order, and its title.  Any text will do: what isn't understood is text or is skipped."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # name, with its classes
    text: list[str] = []
    linked, title = 0, ""

    def flush() -> None:
        nonlocal linked, title
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if whole:
                names = [n for n, _ in stack]
                if "title" in names:
                    title = title or whole
                elif "head" not in names:
                    out.append(Block(tuple(p for n, p in stack if n not in _INLINE), whole, min(linked, len(whole))))
        linked = 0

    for m in _TOKEN.finditer(page):
        words = m[8]
        if words is not None:
            text.append(words)
            if any(n == "a" for n, _ in stack):
                linked += len(words)
            continue
        name = m[3] or m[6]
        if name is None:
            if m[0] == "<":
                text.append("<")
            continue
        name, closing = name.lower(), m[2] or m[5]
        if name == "br":
            flush()
            continue
        if name not in _INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _VOID:
            continue
        ends = _SELF_CLOSING.get(name, frozenset())
        if name in _ENDS_P:
            ends = ends | {"p"}
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _HOLDS:
                    break
        if name == "body":
            stack = [s for s in stack if s[0] != "head"]
        more = m[4] or m[7] or ""
        named = "".join(f" .{c}" for x in _CLASS.findall(more) for c in "".join(x).lower().split()) if "=" in more else ""
        stack.append((name, name + named))
    flush()
    return out, title


def landmark(path: tuple[str, ...]) -> int:
    """1 in content, 0 outside it, -1 where no element tells."""
    for step in reversed(path):
        parts = step.split()
        if any(p in _BAD for p in parts):
            return 0
        if any(p in _GOOD for p in parts):
            return 1
    return -1


def masked(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without landmarks and without classes."""
    return tuple(p.split()[0] for p in path if p.split()[0] not in _GOOD and p.split()[0] not in _BAD)


_slots: dict[str, int] = {}


def _slot(name: str) -> int:
    """A hash of a tag or class in [0, TAGS); the same in every process."""
    if name not in _slots:
        if len(_slots) > 100_000:
            _slots.clear()
        h = 2166136261
        for c in name.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        _slots[name] = (h ^ h >> 15) % TAGS
    return _slots[name]


def vectors(sequence: list[Block], paths: list[tuple[str, ...]] | None = None) -> np.ndarray:
    """One row for each block of one page or of several joined."""
    n = len(sequence)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    for k, path in enumerate(paths or [b.path for b in sequence]):
        for depth, step in enumerate(reversed(path)):
            for part in step.split():
                out[k, _slot(part)] += 1 / (1 + depth)
    texts = pa.array([b.text for b in sequence], pa.large_string())
    for lo, hi, hashes, offsets, _ in token_hashes(texts):
        slot = (hashes >> np.uint64(58)).astype(np.int64)
        row = np.repeat(np.arange(lo, hi), np.diff(offsets))
        bag = np.bincount((row - lo) * WORDS + slot, minlength=(hi - lo) * WORDS).reshape(hi - lo, WORDS)
        size = np.diff(offsets)
        out[lo:hi, TAGS : TAGS + WORDS] = np.log1p(bag) / np.maximum(np.sqrt(size), 1)[:, None]
        out[lo:hi, TAGS + WORDS] = np.log1p(size) / 4
    for k, b in enumerate(sequence):
        size = len(b.text)
        out[k, TAGS + WORDS + 1 :] = (np.log1p(size) / 6, b.linked / size, sum(map(b.text.count, ".,;:!?")) / size * 10, b.text[-1] in ".!?:", b.text[0].isupper())
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator):
        self.p = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)]
        self.p[2][HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: steps x pages x WIDTH.  All steps of a padded sequence are run; padding comes last, so it changes nothing before it."""
        wx, wh, b = self.p
        drive = x @ wx + b
        steps, pages = x.shape[:2]
        h, c = np.zeros((pages, HIDDEN), drive.dtype), np.zeros((pages, HIDDEN), drive.dtype)
        out, saved = np.zeros((steps, pages, HIDDEN), drive.dtype), []
        for t in range(steps):
            a = drive[t] + h @ wh
            s = _sigmoid(a[:, : 3 * HIDDEN])
            g = np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                saved.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out, saved

    def backward(self, x: np.ndarray, saved: list, dout: np.ndarray) -> list[np.ndarray]:
        wh = self.p[1]
        da_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        dwh = np.zeros_like(wh)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, g, tc = saved[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            da_all[t] = da
            dwh += h.T @ da
            dh, dc = da @ wh.T, dc * f
        flat = da_all.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, WIDTH).T @ flat, dwh, flat.sum(axis=0)]


def batches(order: np.ndarray, pages: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Runs of ``order`` of up to ``most`` pages that don't pad to over ``PADDED`` blocks, unless one page alone does."""
    own: list[int] = []
    longest = 0
    for k in order:
        longest = max(longest, len(pages[k]))
        if own and (len(own) == most or longest * (len(own) + 1) > PADDED):
            yield own
            own, longest = [], len(pages[k])
        own.append(int(k))
    if own:
        yield own


class Labeller:
    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.w, self.b = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
        self.trained = False

    @staticmethod
    def pad(pages: list[np.ndarray], backwards: bool) -> np.ndarray:
        out = np.zeros((max(len(p) for p in pages), len(pages), WIDTH), np.float32)
        for k, p in enumerate(pages):
            out[: len(p), k] = p[::-1] if backwards else p
        return out

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of content, for each block of each page; 1 for all as long as nothing was learnt."""
        if not self.trained:
            return [np.ones(len(p)) for p in pages]
        ahead, _ = self.ahead.forward(self.pad(pages, False))
        back, _ = self.back.forward(self.pad(pages, True))
        return [_sigmoid(np.concatenate([ahead[: len(p), k], back[: len(p), k][::-1]], axis=1) @ self.w + self.b[0]) for k, p in enumerate(pages)]

    def train(self, pages: list[np.ndarray], marks: list[np.ndarray], epochs: int = 8, rate: float = 0.01, batch: int = 32, seed: int = 17) -> Labeller:
        """Adam on the cross entropy of the blocks whose mark isn't negative; there must be both marks, else nothing is learnt."""
        usable = [k for k, m in enumerate(marks) if (m >= 0).any()]
        if not any((marks[k] == 0).any() for k in usable) or not any((marks[k] == 1).any() for k in usable):
            return self
        self.trained = True
        params = [*self.ahead.p, *self.back.p, self.w, self.b]
        m, v, step, rng = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, np.random.default_rng(seed)
        for _ in range(epochs):
            for some in batches(rng.permutation(usable), pages, batch):
                own = [pages[k] for k in some]
                xa, xb = self.pad(own, False), self.pad(own, True)
                ha, sa = self.ahead.forward(xa, True)
                hb, sb = self.back.forward(xb, True)
                da, db = np.zeros_like(ha), np.zeros_like(hb)
                gw, gb, total = np.zeros_like(self.w), np.zeros(1), sum(int((marks[k] >= 0).sum()) for k in some)
                for j, k in enumerate(some):
                    n, y = len(own[j]), marks[k]
                    h = np.concatenate([ha[:n, j], hb[:n, j][::-1]], axis=1)
                    e = np.where(y >= 0, _sigmoid(h @ self.w + self.b[0]) - y, 0) / total
                    gw += h.T @ e
                    gb += e.sum()
                    d = e[:, None] * self.w
                    da[:n, j], db[:n, j] = d[:, :HIDDEN], d[::-1, HIDDEN:]
                grads = [*self.ahead.backward(xa, sa, da), *self.back.backward(xb, sb, db), gw, gb]
                step += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_pages: int = MOST_PAGES) -> Labeller:
    """Trains on the ``most_pages`` pages whose ids have the least hashes; without landmarks of both kinds in them, every block counts as content."""
    rows = picked(pages, id=id_col, html=html_col).where("html is not null")
    chosen = bounded_sample(rows.select("id").distinct(), "id", most_pages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for page in b.column(0).to_pylist():
                sequence, _ = blocks(page)
                if sequence:
                    mark = np.array([landmark(x.path) for x in sequence], np.int8).tobytes()
                    found += [(vectors(sequence, p).astype(np.float32).tobytes(), mark) for p in (None, [masked(x.path) for x in sequence])]
            cols = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["x", "y"])

    own = rows.join(F.broadcast(chosen), rows["id"].eqNullSafe(chosen["id"])).select("html")  # at most most_pages ids
    found = own.mapInArrow(run, "x binary, y binary").orderBy("x", "y").toArrow()
    x = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in found.column("x").to_pylist()]
    y = [np.frombuffer(b, np.int8).astype(float) for b in found.column("y").to_pylist()]
    return Labeller().train(x, y) if x else Labeller()


def label(model: Labeller, pages: list[str | None]) -> Iterator[tuple[list[Block], np.ndarray, str]]:
    """Blocks, their probabilities and the title of each page; pages of like length are run together."""
    parsed = [blocks(p or "") for p in pages]
    sizes = np.array([len(s) for s, _ in parsed])
    flat = vectors([b for s, _ in parsed for b in s])
    cut = np.append(0, np.cumsum(sizes))
    probability: list[np.ndarray] = [np.zeros(0)] * len(pages)
    rows = [flat[cut[k] : cut[k + 1]] for k in range(len(pages))]
    order = np.argsort(sizes, kind="stable")
    for own in batches(order[sizes[order] > 0], rows, len(pages)):
        for k, p in zip(own, model.probabilities([rows[k] for k in own]), strict=True):
            probability[k] = p
    for (sequence, title), p in zip(parsed, probability, strict=True):
        yield sequence, p, title


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", model: Labeller | None = None, threshold: float = 0.5, most_pages: int = MOST_PAGES) -> DataFrame:
    """(page_id, title, text, n_blocks, n_content, labels) for every row.

    ``text`` has the content blocks, one a line; ``labels`` the probability of every block in order.  A null
    page has null text, an empty one or one without text has "" and no blocks; a null id stays null; rows that
    are repeated are extracted each; whole pages are read, however long; an empty table gives an empty result;
    other columns, whatever their names, aren't read.  Where the pages trained on have no landmarks, or of one
    kind only, every block is content.
    """
    model = model or train(pages, id_col, html_col, most_pages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                source = part.column(1).to_pylist()
                title, text, n, kept, labels = [], [], [], [], []
                for page, (sequence, p, name) in zip(source, label(model, source), strict=True):
                    good = p >= threshold
                    title.append(None if page is None else name)
                    text.append(None if page is None else "\n".join(x.text for x, g in zip(sequence, good, strict=True) if g))
                    n.append(len(sequence))
                    kept.append(int(good.sum()))
                    labels.append(np.round(p, 4).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32()), pa.array(labels, pa.list_(pa.float32()))], names=["page_id", "title", "text", "n_blocks", "n_content", "labels"])

    rows = picked(pages, page_id=id_col, html=html_col)
    return rows.mapInArrow(run, rows.select("page_id").schema.add("title", T.StringType()).add("text", T.StringType()).add("n_blocks", T.IntegerType()).add("n_content", T.IntegerType()).add("labels", T.ArrayType(T.FloatType())))
