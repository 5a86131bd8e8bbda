"""Vectorised tokenising and hashing of Arrow string columns with numpy.

Everything works on the UTF-8 buffer itself, in pieces of about ``CHUNK`` bytes, so the memory of a
Python worker is bounded by that and not by the size of a batch.  A text longer than a piece is cut
between tokens and put together again; whole texts are always read.

A token is a run of letters, digits and marks; in scripts that are written without spaces (Chinese,
Japanese kana, Thai, Lao, Khmer, Myanmar) every character is one, so that successive tokens are runs of
characters.  Punctuation and symbols separate whatever their width, in ``RUNS`` they are tokens too.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, and 5 of 8, so its powers repeat after 2 ** 62 only
_POW = np.cumprod(np.full(4096, _BASE, dtype=np.uint64))

_BYTES = np.arange(256)
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Byte classes: 0 separates, 1 is a word byte, 2 is punctuation (only kept by ``RUNS``), 3 is of a character that is a token.
WORDS = _WORD.astype(np.uint8)
RUNS = np.where(_WORD, 1, np.where(_BYTES > 32, 2, 0)).astype(np.uint8)
_SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FE), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))


def _plane() -> np.ndarray:
    """The class of each character of the basic plane."""
    kinds = {"L": 1, "M": 1, "N": 1, "C": 1, "P": 2, "S": 2, "Z": 0}
    out = np.array([kinds[unicodedata.category(chr(c))[0]] for c in range(1 << 16)], np.uint8)
    for lo, hi in _SINGLE:
        own = out[lo : hi + 1]
        own[own == 1] = 3
    out[[*range(0x80, 0xA0), 0x200B, 0x2060, 0xFEFF]] = 0
    return out


_PLANE = _plane()
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8).tobytes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[at : at + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def kinds(body: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every byte, that of its character, and where characters of class 3 begin; bytes that aren't UTF-8 are word bytes."""
    kind = np.frombuffer(body.tobytes().translate(classes.tobytes()), np.uint8)
    lead = np.flatnonzero(body >= 0xC2)
    if not len(lead):
        return kind, lead
    kind, begins = kind.copy(), []
    first = body[lead]
    for size, most in ((2, 0xE0), (3, 0xF0), (4, 0xF5)):
        own = lead[(first < most) & (first >= (0, 0, 0xC2, 0xE0, 0xF0)[size])]
        own = own[own + size <= len(body)]
        code = (body[own] & (0x7F >> size)).astype(np.int32)
        for k in range(1, size):
            code = code << 6 | (body[own + k] & 0x3F)
        what = _PLANE[code] if size < 4 else np.where((code >= 0x20000) & (code < 0x40000), 3, np.where((code >= 0x1F000) & (code < 0x1FC00), 2, 1)).astype(np.uint8)
        if not classes[33]:  # punctuation isn't kept
            what = np.where(what == 2, 0, what)
        other = what != 1
        own, what = own[other], what[other]
        for k in range(size):
            kind[own + k] = what
        begins.append(own[what == 3])
    return kind, np.concatenate(begins)


def _powers(place: np.ndarray) -> np.ndarray:
    """Powers of the base for places in a token, of any length."""
    most = int(place.max()) >> 12
    low = _POW[place & 4095]
    if not most:
        return low
    return low * np.cumprod(np.append(np.uint64(1), np.full(most, _POW[-1], np.uint64)))[place >> 12]


def _hash(body: np.ndarray, cuts: np.ndarray, classes: np.ndarray, fold: bool, prefixes: tuple[int, ...]):
    """Token hashes of ``body``, where no token crosses one of ``cuts``: (hashes, start bytes, one array per prefix)."""
    kind, single = kinds(body, classes)
    kept = np.flatnonzero(kind)
    if len(kept) == 0:
        e = np.zeros(0, np.uint64)
        return e, np.zeros(0, np.int64), [e for _ in prefixes]
    kind = kind[kept]
    first = np.empty(len(kept), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[1:] |= kept[1:] != kept[:-1] + 1
    if len(single):
        first[np.searchsorted(kept, single)] = True
    inside = np.searchsorted(kept, cuts)
    first[inside[inside < len(kept)]] = True
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, size)
    letters = np.frombuffer(body.tobytes().translate(_LOWER), np.uint8) if fold else body
    value = (letters[kept].astype(np.uint64) + np.uint64(1)) * _powers(place)
    whole = mix(np.add.reduceat(value, begin))
    heads = []
    for k in prefixes:
        heads.append(mix(np.add.reduceat(np.where(place < k, value, np.uint64(0)), begin) + np.uint64(k)))
    return whole, kept[begin], heads


def token_hashes(column: pa.Array, classes: np.ndarray = WORDS, fold: bool = True, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Yields (first row, end row, hashes, offsets by row, prefix hashes) for whole rows, some rows at a time."""
    body, offsets = raw(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        part = body[offsets[lo] : offsets[hi]]
        cuts = offsets[lo : hi + 1] - offsets[lo]
        if len(part) <= 2 * CHUNK:
            hashes, starts, heads = _hash(part, cuts, classes, fold, prefixes)
            yield lo, hi, hashes, np.searchsorted(starts, cuts), heads
        else:  # one long text: pieces that end between tokens
            found, at = [], 0
            while at < len(part):
                end = min(len(part), at + CHUNK)
                step = 65536
                while end < len(part):  # on to the next character that separates or is a token by itself
                    while end < len(part) and part[end] & 0xC0 == 0x80:
                        end += 1
                    kind, single = kinds(part[end : end + step], classes)
                    gaps = np.append(np.flatnonzero(kind == 0), single)
                    if len(gaps):
                        end += int(gaps.min())
                        break
                    end = min(len(part), end + step)
                found.append(_hash(part[at:end], np.zeros(0, np.int64), classes, fold, prefixes))
                at = end
            hashes = np.concatenate([f[0] for f in found])
            yield lo, hi, hashes, np.array([0, len(hashes)]), [np.concatenate([f[2][k] for f in found]) for k in range(len(prefixes))]
        lo = hi


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` successive tokens by row; a row with fewer tokens (but one at least) has one shingle of all of them."""
    size = np.diff(offsets)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    total = int(out[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out
    at = np.arange(total) - np.repeat(out[:-1], count) + np.repeat(offsets[:-1], count)
    end = np.repeat(offsets[1:], count)
    value = np.zeros(total, np.uint64)
    for j in range(k):
        here = at + j
        ok = here < end
        value = value * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, mix(hashes[np.minimum(here, len(hashes) - 1)] + np.uint64(j)), np.uint64(0))
    return mix(value), out
