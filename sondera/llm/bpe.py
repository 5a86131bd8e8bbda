"""Byte-level BPE with tiktoken and a local rank file.

A text is cut where a token can't cross: before white space that follows something else, and in
stretches of over ``LONG`` bytes without such a place also after a run of ASCII letters or digits.
The pattern's matches never span those places and never look behind, so the pieces' encodings
joined are the encoding of the whole text; each distinct piece of a batch is encoded once.  Ids
are decoded to raw bytes through a table, so a token that ends within a character is no trouble.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .textvec import raw

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE, LONG = 16 << 20, 1 << 16

_BYTES = np.arange(256)
_SPACE = (((_BYTES >= 9) & (_BYTES <= 13)) | (_BYTES == 32)).astype(np.uint8).tobytes()
#: 1 an ASCII letter, 2 an ASCII digit, 3 other ASCII, 0 a byte of a longer character.
_KIND = np.select([_BYTES >= 128, ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122), (_BYTES >= 48) & (_BYTES <= 57)], [0, 1, 2], 3).astype(np.uint8)
_loaded: dict[str, Tokenizer] = {}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the concatenation of the ranges [start, start + size)."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def safe_cuts(body: np.ndarray) -> np.ndarray:
    """Positions before which ``body`` may be cut without a change of its tokens."""
    if len(body) < 2:
        return np.zeros(0, np.int64)
    space = np.frombuffer(body.tobytes().translate(_SPACE), np.uint8)
    cuts = np.flatnonzero(space[1:] > space[:-1]) + 1
    before, two, three = body[cuts - 1], body[np.maximum(cuts - 2, 0)], body[np.maximum(cuts - 3, 0)]
    # the character before may be white space of two or three bytes: such places are left alone
    wide = (before >= 128) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & (two >= 128)))
    cuts = cuts[~wide]
    ends = np.append(cuts, len(body))
    begins = np.append(0, cuts)
    more = []
    for k in np.flatnonzero(ends - begins > LONG):
        kind = _KIND[body[begins[k] : ends[k]]]
        run = (kind[:-1] != kind[1:]) & ((kind[:-1] == 1) | (kind[:-1] == 2)) & (kind[1:] != 0)
        more.append(begins[k] + 1 + np.flatnonzero(run))
    return np.sort(np.concatenate([cuts, *more])) if more else cuts


class Tokenizer:
    def __init__(self, rank_file: str, pattern: str = PATTERN):
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, k in self.ranks.items():
            self.bytes[k] = token
        self.lengths = np.array([len(t) for t in self.bytes])

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all of some distinct pieces, where each piece's begin, and how many they are.

        They are encoded as one text; those pieces next to a place that isn't safe there are encoded by themselves.
        """
        body, offsets = np.frombuffer(parts.buffers()[2], np.uint8), np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]
        text = body[: offsets[-1]].tobytes()
        try:
            tokens = np.array(self.encoding.encode_ordinary(text.decode()), np.int32)
        except UnicodeDecodeError:
            tokens = np.zeros(0, np.int32)
        ends = np.append(0, np.cumsum(self.lengths[tokens]))
        safe = np.zeros(len(text) + 1, bool)
        safe[safe_cuts(body[: offsets[-1]])] = True
        safe[[0, len(text)]] = True
        if ends[-1] != len(text):
            safe[:] = False
        good = safe[offsets[:-1]] & safe[offsets[1:]]
        first = np.searchsorted(ends, offsets)
        sizes = np.where(good, np.diff(first), 0)
        alone = np.flatnonzero(~good)
        found = [self.encoding.encode_ordinary(parts[int(k)].as_py().decode("utf-8", "replace")) for k in alone]
        sizes[alone] = [len(f) for f in found]
        starts = np.where(good, first[:-1], 0)
        starts[alone] = len(tokens) + np.cumsum(sizes[alone]) - sizes[alone]
        return np.concatenate([tokens, np.array([t for f in found for t in f], np.int32)]), starts, sizes

    def _piece(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.zeros(len(body) + 1, bool)
        begins[offsets] = True
        begins[safe_cuts(body)] = True
        cuts = np.flatnonzero(begins)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        flat, starts, sizes = self._distinct(parts.dictionary)
        at = parts.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[at]))
        return flat[spread(starts[at], sizes[at])], ends[np.searchsorted(cuts, offsets)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin and end; a null has none."""
        body, offsets = raw(column)
        tokens, ends, lo, n = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
            if offsets[hi] > offsets[lo]:
                some, cut = self._piece(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                tokens.append(some)
            else:
                cut = np.zeros(hi - lo + 1, np.int64)
            ends.append(cut[1:] + ends[-1][-1])
            lo = hi
        return np.concatenate(tokens), np.concatenate(ends)

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw bytes of all rows from the table of tokens, and where each row's bytes begin and end."""
        known = self.bytes
        ends = np.append(0, np.cumsum(self.lengths[tokens]))
        step = 1 << 20
        out = b"".join([b"".join([known[t] for t in tokens[k : k + step].tolist()]) for k in range(0, len(tokens), step)])
        return np.frombuffer(out, np.uint8), ends[offsets]


def tokenizer(rank_file: str = RANK_FILE) -> Tokenizer:
    """Loaded once in each Python process."""
    if rank_file not in _loaded:
        _loaded[rank_file] = Tokenizer(rank_file)
    return _loaded[rank_file]


def _lists(column: pa.Array, tokens: np.ndarray, ends: np.ndarray) -> pa.Array:
    null = column.is_null()
    out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens, pa.int32()))
    return out if column.null_count == 0 else pa.compute.if_else(null, pa.scalar(None, out.type), out)


def _encode(rank_file: str, check: bool):
    import pyarrow.compute  # noqa: F401

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(rank_file)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                text = part.column(1)
                tokens, ends = t.encode(text)
                columns = [part.column(0), pa.array(np.diff(ends), pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False)), _lists(text, tokens, ends)]
                if check:
                    body, offsets = raw(text)
                    decoded, cut = t.decode(tokens, ends)
                    if np.array_equal(cut, offsets) and np.array_equal(decoded, body):
                        same = np.ones(len(text), bool)
                    else:
                        same = np.array([np.array_equal(decoded[cut[k] : cut[k + 1]], body[offsets[k] : offsets[k + 1]]) for k in range(len(text))])
                    columns.append(pa.array(same, mask=text.is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "token_ids", "round_trip"][: len(columns)])

    return run


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) for every row; ``round_trip``: decoding gave the text's bytes again.

    A null text has nulls, an empty one no ids; a text of any length is encoded whole; a null id stays null,
    repeated rows are encoded each; an empty table gives an empty result.  Bytes that aren't UTF-8 are
    encoded as U+FFFD, and ``round_trip`` is then false.  Without ``check`` the ids aren't decoded and that
    column is left out.  Ids must be integers; other columns, whatever their names, aren't read.
    """
    rows = rows_of(df, id_col, text=text_col).withColumnRenamed("id", "doc_id")
    return rows.mapInArrow(_encode(rank_file, check), "doc_id long, n_tokens long, token_ids array<int>" + ", round_trip boolean" * check)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", rank_file: str = RANK_FILE) -> DataFrame:
    """(doc_id, bytes) of every row's ids; null ids give null, none give no bytes; an id that the ranks don't have gives no bytes.

    A null doc_id stays null, repeated rows are decoded each, an empty table gives an empty result; other columns aren't read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(rank_file)
        for b in batches:
            ids = b.column(1)
            flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (flat >= 0) & (flat < t.size)
            sizes = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            kept = np.append(0, np.cumsum(known))
            body, cut = t.decode(flat[known], kept[sizes])
            out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(body)])
            out = pa.compute.if_else(ids.is_null(), pa.scalar(None, out.type), out).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "bytes"])

    import pyarrow.compute  # noqa: F401

    return rows_of(df, id_col, ids=ids_col).select("id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def bpe_text(df: DataFrame, **columns) -> DataFrame:
    """``bpe_decode`` as text; bytes that aren't UTF-8 become U+FFFD."""
    return bpe_decode(df, **columns).select("doc_id", F.decode("bytes", "UTF-8").alias("text"))
