"""Embedders turn a text column into a column of unit vectors."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import alphanumeric, slices, text_bytes
from ..functions.tokenizer import SEQUENCE, Vocabulary

class Embedder(Protocol):
    name: str
    dim: int
    threshold: float
    strict_threshold: float

    def embed(self, text: Column) -> Column:
        """ARRAY<FLOAT> of length ``dim`` and norm 1, or null for a text without a vector."""

    def embed_one(self, text: str) -> list[float] | None:
        """The same of one text, on the driver."""


_WORD = re.compile(r"[A-Za-z0-9]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_vectors(texts: list[str | None], dim: int, known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts and which of them have one."""
    owner, bucket, sign = [], [], []
    for k, text in enumerate(texts):
        for w in _WORD.findall(text.translate(_LOW)) if text else ():
            found = known.get(w)
            if found is None:
                h = hashlib.md5(w.encode()).hexdigest()
                if len(known) > 500_000:
                    known.clear()
                found = known[w] = (int(h[:8], 16) % dim, 1 if int(h[8], 16) % 2 == 0 else -1)
            owner.append(k)
            bucket.append(found[0])
            sign.append(found[1])
    n = len(texts)
    flat = np.bincount(np.array(owner, np.int64) * dim + np.array(bucket, np.int64), np.array(sign, float), n * dim) if owner else np.zeros(n * dim)
    out = flat.reshape(n, dim)
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None], norm > 0


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def hash_column(texts: pa.Array, dim: int, known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """``hash_vectors`` of an Arrow column: words are cut out of its buffer, and only distinct ones are looked up."""
    data, offsets = text_bytes(texts)
    at = np.flatnonzero(alphanumeric(data))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (np.diff(at) > 1) | begins[at[1:]] if len(at) else []
    bounds = np.flatnonzero(new) if len(at) else np.zeros(1, int)
    words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(_LOWER[data[at]])).dictionary_encode()
    codes = np.zeros((len(words.dictionary), 2), np.int64)
    for k, w in enumerate(words.dictionary.to_pylist()):
        found = known.get(w)
        if found is None:
            h = hashlib.md5(w.encode()).hexdigest()
            if len(known) > 500_000:
                known.clear()
            found = known[w] = (int(h[:8], 16) % dim, 1 if int(h[8], 16) % 2 == 0 else -1)
        codes[k] = found
    own = codes[words.indices.to_numpy(zero_copy_only=False)]
    owner = np.searchsorted(offsets, at[bounds[:-1]], "right") - 1
    out = np.bincount(owner * dim + own[:, 0], own[:, 1].astype(float), len(texts) * dim).astype(float).reshape(len(texts), dim)
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None], norm > 0


class HashingEmbedder:
    """Signed feature hashing of words: lexical, not semantic, and the same in every engine.

    Words are runs of ASCII letters and digits in lower case.  The first 32 bits of a word's MD5
    choose its component, the parity of the next hexadecimal digit its sign (even: plus).
    """

    def __init__(self, dim: int = 256, threshold: float = 0.36, strict_threshold: float = 0.46):
        self.name, self.dim, self.threshold, self.strict_threshold = f"hash-{dim}", dim, threshold, strict_threshold

    def embed(self, text: Column) -> Column:
        dim = self.dim
        known: dict[str, tuple[int, int]] = {}  # in each worker, from batch to batch

        @F.arrow_udf("array<float>")
        def vectors(column: pa.Array) -> pa.Array:
            parts = []
            for whole, until in slices(column):
                for at in range(whole, until, 2048):
                    out, good = hash_column(column.slice(at, min(2048, until - at)), dim, known)
                    n = len(good)
                    parts.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(out.astype(np.float32).ravel()), mask=pa.array(~good)))
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

        return vectors(text)

    def embed_one(self, text: str) -> list[float] | None:
        out, good = hash_vectors([text], self.dim, {})
        return out[0].astype(np.float32).tolist() if good[0] else None


class ModelEmbedder:
    """Plug-in for a real model: ``load()`` gives a function from texts to a matrix, once in each Python worker.

    Rows are made unit vectors here; an empty text, or a row of zeros or NaN, has no vector.  A text that
    occurs more than once in a batch goes to the model once.
    """

    def __init__(self, name: str, dim: int, threshold: float, strict_threshold: float, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.name, self.dim, self.threshold, self.strict_threshold, self.load = name, dim, threshold, strict_threshold, load

    def _run(self, model: Callable[[list[str]], np.ndarray], texts: list[str | None]) -> list[list[float] | None]:
        some = list(dict.fromkeys(t for t in texts if t))
        vectors: dict[str | None, list[float]] = {}
        if some:
            x = np.asarray(model(some), float)
            for t, row, n in zip(some, x, np.linalg.norm(x, axis=1), strict=True):
                if np.isfinite(n) and n > 0:
                    vectors[t] = (row / n).astype(np.float32).tolist()
        return [vectors.get(t) for t in texts]

    def embed(self, text: Column) -> Column:
        cached: list = []

        @F.arrow_udf("array<float>")
        def vectors(column: pa.Array) -> pa.Array:
            if not cached:
                cached.append(self.load())
            return pa.array(self._run(cached[0], column.to_pylist()), pa.list_(pa.float32()))

        return vectors(text)

    def embed_one(self, text: str) -> list[float] | None:
        return self._run(self.load(), [text])[0]


class TokenEmbedder(ModelEmbedder):
    """From text to vector through a transformer: WordPiece ids, cut to ``length`` and padded, the model, the mean over real tokens.

    ``load()`` gives, once in each Python worker, a function from ids and mask (texts x length) to one
    vector for each token (texts x length x dim).  ``at_once`` texts are run together.
    """

    def __init__(self, name: str, dim: int, threshold: float, strict_threshold: float, vocabulary: Vocabulary, load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], length: int = SEQUENCE, at_once: int = 64):
        self.vocabulary = vocabulary

        def loaded() -> Callable[[list[str]], np.ndarray]:
            model, known = load(), {}

            def pooled(texts: list[str]) -> np.ndarray:
                ids, mask = np.zeros((len(texts), length), np.int64), np.zeros((len(texts), length), np.int64)
                for k, t in enumerate(texts):
                    own = vocabulary.encode(t.encode(), length, known)
                    ids[k, : len(own)], mask[k, : len(own)] = own, 1
                tokens = np.asarray(model(ids, mask), float)
                return (tokens * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)

            return lambda texts: np.concatenate([pooled(texts[at : at + at_once]) for at in range(0, len(texts), at_once)])

        super().__init__(name, dim, threshold, strict_threshold, loaded)

    def embed_one(self, text: str) -> list[float] | None:
        if text and not (_WORD.fullmatch(text[0]) and _WORD.fullmatch(text[-1])):
            logging.getLogger(__name__).warning("a text with punctuation at its ends is embedded: %r", text)
        return super().embed_one(text)
