"""WordPiece tokenizer with a vocabulary file in JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

MOST_BYTES = 100
SEQUENCE = 128
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASIC = re.compile(rb"[a-z0-9]+|[^a-z0-9\s]")


def basic_tokens(s: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, and every other byte but white space by itself, inside the JVM.

    A character of more than one byte gives as many tokens, which all are that character (each is unknown to any vocabulary).
    """
    tokens = F.regexp_extract_all(ascii_lower(s), F.lit("[a-z0-9]+|[^a-z0-9 \\t\\n\\r\\x0B\\f]"), F.lit(0))
    return F.flatten(F.transform(tokens, lambda t: F.when(F.octet_length(t) > F.length(t), F.array_repeat(t, F.octet_length(t))).otherwise(F.array(t))))


@dataclass
class Vocabulary:
    ids: dict[bytes, int]
    cls: int = 101
    sep: int = 102

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        """``model.vocab``; the special ids from ``post_processor``, else the vocabulary, else 101 and 102."""
        data = json.loads(text)
        ids = {k.encode(): int(v) for k, v in data["model"]["vocab"].items()}
        post = data.get("post_processor") or {}

        def special(key: str, token: bytes, default: int) -> int:
            pair = post.get(key)
            return int(pair[1]) if isinstance(pair, list) and len(pair) > 1 else ids.get(token, default)

        return cls(ids, special("cls", b"[CLS]", 101), special("sep", b"[SEP]", 102))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @property
    def unknown(self) -> int:
        return self.ids.get(b"[UNK]", 100)

    def pieces(self, word: bytes) -> list[int]:
        """Greedy longest matches, continued with ``##``; one unknown id if any part fails or the word is long."""
        if len(word) > MOST_BYTES:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                found = self.ids.get((b"##" if at else b"") + word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def encode(self, text: bytes, most: int | None = None, known: dict[bytes, list[int]] | None = None) -> list[int]:
        """All ids, or the first ``most``, for which no more of the text is read; ``known`` keeps the pieces of words from one call to the next."""
        out = [self.cls]
        for m in _BASIC.finditer(text.translate(_LOW)):
            if most is not None and len(out) >= most:
                return out[:most]
            found = None if known is None else known.get(m[0])
            if found is None:
                found = self.pieces(m[0])
                if known is not None:
                    if len(known) > 200_000:
                        known.clear()
                    known[m[0]] = found
            out += found
        return [*out, self.sep][:most]


def wordpiece(s: Column, vocabulary: Vocabulary) -> Column:
    """Ids with the special ones at both ends, not truncated; null for a null text."""

    @F.arrow_udf("array<int>")
    def tokenize(column: pa.Array) -> pa.Array:
        known: dict[bytes, list[int]] = {}
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

        def ids(text: bytes) -> Iterable[int]:
            yield vocabulary.cls
            for w in _BASIC.findall(text.translate(low)):
                if w not in known:
                    known[w] = vocabulary.pieces(w)
                yield from known[w]
            yield vocabulary.sep

        texts = (v.as_py() for v in column.cast(pa.large_binary()))
        return pa.array([None if t is None else list(ids(t)) for t in texts], pa.list_(pa.int32()))

    return tokenize(s)


def padded(ids: Column, length: int = SEQUENCE) -> Column:
    """Struct of ids, truncated or filled with 0 to ``length``, and the mask of real tokens."""
    kept = F.slice(ids, 1, length)
    missing = F.lit(length) - F.size(kept)
    zeros = F.array_repeat(F.lit(0), missing)
    return F.when(ids.isNotNull(), F.struct(F.concat(kept, zeros).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size(kept)), zeros).alias("mask")))
