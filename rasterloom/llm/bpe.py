"""Byte-level BPE as a monoid: halves are encoded apart and joined at their border.

A sequence of tokens is the encoding of its bytes if every two neighbours are (merging the bytes of
the two alone gives the two back): a merge across a border would be the lowest-ranked one at
some step, and would be so for the two tokens alone as well.  So a join re-encodes a window round the
border, and the window grows until its ends are stable against the tokens outside.  The empty
sequence is the identity; decoding concatenates up the same tree.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import split_at_spaces

LEAF = 6  # bytes that are merged directly
MEMO = 200_000  # entries of each of two generations of remembered words, pairs and halves
REMEMBERED = 12  # bytes up to which an encoded half is remembered
DECODE_LEAF = 1 << 16


class ByteBpe:
    """Encoder and decoder over ``ranks`` (bytes to id); ``pattern`` splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs, self.halves, self.units, self.older = {}, {}, {}, {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteBpe":
        import base64

        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Direct merging, lowest rank first and leftmost among equals."""
        ranks = self.ranks
        if len(data) > 4 * LEAF:
            return self._merge_long(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            low, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same by a heap of candidate merges over a linked list of parts."""
        import heapq

        n, ranks = len(data), self.ranks
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = ranks.get(data[i:end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return tuple(out)

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay as they are when they stand side by side."""
        key = (a << 32) | b
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encodings' bytes put together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        reach, of, m, n = 1, self.bytes_of, len(left), len(right)
        while True:
            i, j = max(0, m - reach), min(n, reach)
            data = b"".join([of[t] for t in left[i:] + right[:j]])
            window = self.halves.get(data) or self.merge(data)
            if len(data) <= REMEMBERED:
                self.halves[data] = window
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == n or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tree reduction over halves."""
        known = self.halves.get(data)
        if known is not None:
            return known
        n = len(data)
        if data in self.ranks:
            known = (self.ranks[data],)
        elif n <= LEAF:
            known = self.merge(data)
        else:
            known = self.join(self.encode_bytes(data[:n // 2]), self.encode_bytes(data[n // 2:]))
        if n <= REMEMBERED:
            self.halves[data] = known
        return known

    def _unit(self, text: str) -> bytes:
        ids = array("I")
        for piece in self.find(text):
            ids.extend(self.encode_bytes(piece.encode("utf-8", "surrogatepass")))
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word behind a space; letters with one full stop or comma behind them are two pieces."""
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            stem = self.units.get(word[:-1]) or self.older.get(word[:-1])
            if stem is None:
                stem = self.units[word[:-1]] = self._unit(" " + word[:-1])
            return stem + self._unit(word[-1])
        return self._unit(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit words.

        Pieces of the pattern never cross a space that stands between two visible characters, so what
        lies between such spaces is encoded once and remembered.
        """
        if not text:
            return b""
        for memo in (self.pairs, self.halves):
            if len(memo) > 2 * MEMO:
                memo.clear()
        if len(self.units) > MEMO:
            self.older, self.units = self.units, {}
        first, *rest = split_at_spaces(text)
        units, older = self.units, self.older
        out = [self._unit(first)]
        for word in rest:
            ids = units.get(word)
            if ids is None:
                ids = units[word] = older.get(word) or self._word(word)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> bytes:
        """Bytes of ``ids``, halves first."""
        if len(ids) <= DECODE_LEAF:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe.load(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts give no ids.

    Rows are independent: repeated rows, null ids and ties need no rule, and other columns are not read.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = _codec(path, pattern)
        for batch in batches:
            coded = [codec.encode(x) if x else b"" for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", F.col(text)).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` with decoded, the bytes the ids stand for."""
    def run(batches):
        import pyarrow as pa

        codec = _codec(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            decoded = pa.array([codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=["doc_id", "ids", "decoded"])

    fields = [tokens.schema["doc_id"], tokens.schema["ids"], T.StructField("decoded", T.BinaryType())]
    return tokens.select("doc_id", "ids").mapInArrow(run, T.StructType(fields))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    The ids are encoded and decoded by one worker, which holds the vocabulary once; neither ids nor texts go back.
    """
    def run(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        codec = _codec(path, pattern)
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in batch.column(1):
                ids = np.frombuffer(codec.encode(text.as_py() or ""), "<i4").tolist()
                n.append(len(ids))
                coded.append(sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded.append(sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_tokens bigint, ids_sha256 string, decoded_sha256 string").fields])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
