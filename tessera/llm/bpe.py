"""Encoding a corpus with a public byte-level BPE vocabulary, exactly and in linear time.

A pre-token's bytes are mapped to Latin-1, so one Aho-Corasick pass over the resulting
string finds, for every start, the longest vocabulary entry that begins there.  The
encoding is then the unique sequence of tokens whose neighbours are pairwise compatible,
where two tokens are compatible when merging their concatenation would stop at exactly
that boundary.  Walking from the longest match and falling back to ever shorter prefixes
finds it; positions that proved to be dead ends are never entered twice, which bounds
the work linearly in the length of the pre-token.  Compatibility is memoised per pair.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The published pre-token pattern of the vocabulary (fixed value).
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file of ``base64(token) rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Exact encoder for one vocabulary; pre-tokens seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = GPT_PATTERN, cache_limit: int = 400_000):
        import ahocorasick
        import regex

        self._split_text = regex.compile(pattern).findall
        self._limit = cache_limit
        self._cache: dict[str, tuple[int, ...]] = {}
        by_id = sorted((rank, token.decode("latin-1")) for token, rank in ranks.items())
        self._size = [0] * (by_id[-1][0] + 1)
        self._id = {}
        self._auto = ahocorasick.Automaton()
        for rank, text in by_id:
            self._size[rank], self._id[text] = len(text), rank
            self._auto.add_word(text, (rank, len(text)))
        self._auto.make_automaton()
        self._merge: dict[tuple[int, int], int] = {}
        self._left = list(range(len(self._size)))
        self._right = list(range(len(self._size)))
        self._fits: dict[tuple[int, int], bool] = {}
        self._prefix = [-1] * len(self._size)
        for rank, text in by_id:
            self._prefix[rank] = next((self._id[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self._id), -1)
            for n in range(1, len(text)):
                a, b = self._id.get(text[:n], _NEVER), self._id.get(text[n:], _NEVER)
                if a < rank and b < rank and self._compatible(a, b):
                    self._merge[a, b], self._left[rank], self._right[rank] = rank, a, b
                    break
        self._fits.clear()  # verdicts before all merges were known hold only for construction

    def _compatible(self, a: int, b: int) -> bool:
        """Would byte-pair merging of ``a + b`` leave the boundary between them standing?

        Undo the merges of both sides from the latest to the earliest; the boundary falls
        if at any of these moments the two tokens touching it could merge with a rank
        earlier than the merge that was undone last on that side.
        """
        limit = _NEVER
        while True:
            if self._merge.get((a, b), _NEVER) < limit:
                return False
            if a > b:
                limit, a = a, self._right[a]
                if a == limit:
                    limit, b = b + 1, self._left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self._left[b]
                if b + 1 == limit:
                    limit, a = a, self._right[a]
                    if a == limit:
                        return True

    def _pair(self, a: int, b: int) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            got = self._fits[a, b] = self._compatible(a, b)
        return got

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        text = piece.encode("utf-8").decode("latin-1")
        whole = self._id.get(text)
        if whole is not None:
            return (whole,)
        n = len(text)
        longest = [-1] * n
        for end, (rank, size) in self._auto.iter(text):
            longest[end - size + 1] = rank  # ends come in rising order: the last one is longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + self._size[token]
            if not dead[end] and (not out or self._pair(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self._prefix[token]
            while token < 0:  # nothing shorter begins here: this position is a dead end
                dead[at] = 1
                last = out.pop()
                at -= self._size[last]
                token = self._prefix[last]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; empty and null texts have none."""
        if not text:
            return []
        cache, out = self._cache, []
        for piece in self._split_text(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(cache) >= self._limit:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}  # per Python worker, which Spark reuses over tasks


def encode_corpus(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = GPT_PATTERN) -> DataFrame:
    """``(id, ids array<int>)`` of every row of ``df``, in one pass without a shuffle.

    ``vocabulary`` is the path of a rank file; the driver reads it and broadcasts it (its
    size is that of the vocabulary, not of the data).  A null or empty text gets an empty
    list, a null id stays null, repeated rows each get a row, other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    id_field = df.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, pattern)
        encoder = _ENCODERS.get(key)
        for batch in batches:
            if encoder is None:
                encoder = _ENCODERS[key] = Encoder(shared.value, pattern)
            texts, ids = batch.column(1), batch.column(0)
            for start in range(0, len(texts), 512):
                lists = [np.asarray(encoder.encode(t), dtype=np.int32) for t in texts.slice(start, 512).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(start, 512), values], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)
