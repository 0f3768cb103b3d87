"""Token ids in a binary format of Simple-8b words.

A word has four bits of selector and 60 bits of ids: as many as fit at one width.  Two selectors are
escapes: a run of one id, and a word that announces a raw 64-bit value.  Ids are packed in blocks of
``BLOCK``; a segment holds whole documents in order, their lengths, the words, and the offset of every
block, so blocks decode apart and each selector's words decode in one vectorised step.  Segments are rows
of Parquet files, so any file system that Spark writes will do and a lost executor's files are
written again.
"""

from __future__ import annotations

import string
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import cut_at_spaces

BLOCK = 1 << 15  # ids
SEGMENT = 1 << 17  # ids at which a segment ends; a longer document is a segment
MEMO = 400_000  # words of each of two generations that a worker remembers
GROUP = 500  # new words that the library encodes as one text
TOGETHER = 16 << 20  # bytes of text whose words become one dictionary
STEP = 1 << 16  # words whose ids are put together at once
CUT = "\0"  # stands for a space between words
GLUE = "\1"  # begins a word that follows no space; a text that holds either goes to the library whole
MARKS = string.punctuation
SPACE = "\u0120"  # stands for a space in a byte-level vocabulary
RAW, RUN = 0, 1  # escape selectors
LAYOUTS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))  # (ids, bits) of selectors 2, 3, ...
LEVEL_IDS = np.array([1, *[held for held, _ in LAYOUTS]])  # by the number of layouts that fit; none: a raw value
LEVEL_SELECTOR = np.array([RAW, *range(2, 2 + len(LAYOUTS))])
RUN_LIMIT = (1 << 28) - 1


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of one block of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return ids
    width = np.maximum(np.frexp(ids.astype(float))[1], 1).astype(np.uint8)  # bits; from 2^53 on maybe one more
    tops = {1: np.concatenate([width, np.full(64, 99, np.uint8)])}  # widest id among the next 1, 2, 4, ... ids
    for p in (2, 4, 8, 16, 32):
        half = tops[p // 2]
        tops[p] = np.maximum(half, np.concatenate([half[p // 2:], np.full(p // 2, 99, np.uint8)]))
    level = np.zeros(n, np.uint8)  # layouts of more ids fit only where those of fewer do
    for held, bits in LAYOUTS:
        p = 1 << (held.bit_length() - 1)
        level += np.maximum(tops[p][:n], tops[p][held - p:held - p + n]) <= bits
    count, kind = LEVEL_IDS[level], LEVEL_SELECTOR[level]
    ends = np.nonzero(np.concatenate([ids[1:] != ids[:-1], [True]]))[0]
    lengths = np.diff(ends, prepend=-1)
    if lengths.max() > 3:
        run = np.minimum(np.repeat(ends + 1, lengths) - np.arange(n), RUN_LIMIT)
        runs = (run > count) & (width <= 32)
        count[runs], kind[runs] = run[runs], RUN
    at = chain(np.append(np.minimum(np.arange(n) + count, n), n))
    chosen = kind[at]
    place = np.cumsum(1 + (chosen == RAW)) - 1 - (chosen == RAW)
    words = np.zeros(int(place[-1]) + 1 + int(chosen[-1] == RAW), np.uint64)
    for selector in np.unique(chosen).tolist():
        of = chosen == selector
        first, to = at[of], place[of]
        if selector == RAW:
            words[to + 1] = ids[first]
        elif selector == RUN:
            words[to] = np.uint64(RUN) << np.uint64(60) | run[first].astype(np.uint64) << np.uint64(32) | ids[first]
        else:
            held, bits = LAYOUTS[selector - 2]
            parts = ids[first[:, None] + np.arange(held)] << (np.arange(held) * bits).astype(np.uint64)
            words[to] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(selector) << np.uint64(60)
    return words


def chain(follows: np.ndarray) -> np.ndarray:
    """The places 0, follows[0], follows[follows[0]], ... before the last one, which follows itself, found by doubling."""
    end, jumps = len(follows) - 1, [follows]
    while jumps[-1][0] < end:
        jumps.append(jumps[-1][jumps[-1]])
    at = np.zeros(1, np.int64)
    for jump in reversed(jumps):
        at = np.concatenate([at, jump[at]])
        at = at[at < end]
    return np.sort(at)


def unpack(words: np.ndarray) -> np.ndarray:
    """Ids of one block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    at = np.arange(len(words))
    if (selectors == RAW).any():
        heads, i = [], 0
        while i < len(words):
            heads.append(i)
            i += 2 if selectors[i] == RAW else 1
        at = np.array(heads, np.int64)
    kind, body = selectors[at], words[at]
    count = np.array([1, 0, *[held for held, _ in LAYOUTS]])[kind]
    runs = kind == RUN
    count[runs] = ((body[runs] >> np.uint64(32)) & np.uint64(RUN_LIMIT)).astype(np.int64)
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for selector in np.unique(kind).tolist():
        of = kind == selector
        if selector == RAW:
            out[start[of]] = words[at[of] + 1]
        elif selector == RUN:
            n = count[of]
            to = np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[to] = np.repeat(body[of] & np.uint64(0xFFFFFFFF), n)
        else:
            held, bits = LAYOUTS[selector - 2]
            mask = np.uint64((1 << bits) - 1)
            out[start[of][:, None] + np.arange(held)] = body[of][:, None] >> (np.arange(held) * bits).astype(np.uint64) & mask
    return out


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Words of all blocks of ``ids``, and where each block's words begin."""
    blocks = [pack(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    sizes = [len(b) for b in blocks]
    return (np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)), (np.cumsum([0, *sizes])[:-1]).tolist() if blocks else []


def unpack_blocks(words: np.ndarray, offsets: list[int]) -> np.ndarray:
    ends = [*offsets[1:], len(words)]
    return np.concatenate([unpack(words[a:b]) for a, b in zip(offsets, ends)]) if offsets else np.zeros(0, np.uint64)


class Tokens:
    """The tokenizers library with a memory of words.

    The vocabulary's pattern always starts a new piece at a space that stands between two visible characters and at both
    sides of such a single line feed, and letters with ASCII punctuation behind them are two pieces.  So a text is cut there, a batch's
    cuttings become a dictionary, punctuation is split from its entries, and only what is left is looked up; what was
    not met before goes to the library many at a time.  Ids are then taken part by part in one step.  A text with the
    string of an added token goes to the library whole, since such a string is one id wherever it stands.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the one it has
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        opens = {i for piece, i in self.library.get_vocab().items() if piece.startswith(SPACE)}
        self.opens = np.zeros(self.library.get_vocab_size(), bool)  # ids that begin with a space
        self.opens[list(opens)] = True
        self.marks: dict[str, bytes] = {}  # punctuation behind letters
        self.words: dict[str, bytes] = {}  # what follows a space, without it; behind ``GLUE``, what follows no space
        self.older: dict[str, bytes] = {}  # the generation of words before

    def _each(self, memo: dict[str, bytes], names: list[str], units: list[str]) -> None:
        for name, made in zip(names, self.library.encode_batch_fast(units, add_special_tokens=False)):
            memo[name] = array("I", made.ids).tobytes()

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct words; of those not held, many are encoded as one text, a word's ids running from one id with a space to the next."""
        words = self.words
        made = list(map(words.get, units))
        new = [i for i, held in enumerate(made) if held is None]
        if self.older:
            for i, held in zip(new, list(map(self.older.get, [units[i] for i in new]))):
                if held is not None:
                    made[i] = words[units[i]] = held
            new = [i for i in new if made[i] is None]
        unknown = [units[i] for i in new]
        glued = [u for u in unknown if u[:1] == GLUE]
        self._each(words, glued, [u[1:] for u in glued])
        apart = [u for u in unknown if u[:1] != GLUE and (not u or " " in u or u[0].isspace() or u[-1].isspace())]
        plain = [u for u in unknown if u[:1] != GLUE]
        plain = list(set(plain).difference(apart)) if apart else plain
        groups = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)]
        for group, found in zip(groups, self.library.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(group) and starts[0] == 0:
                data, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), 4 * len(ids)]
                words.update(zip(group, [data[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                apart += group
        self._each(words, apart, [" " + u for u in apart])
        for i in new:
            made[i] = words[units[i]]
        return made

    def _whole(self, text: str) -> bool:
        return CUT in text or GLUE in text or any(a in text for a in self.added)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and how many each text has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > MEMO:
            self.older, self.words = self.words, {}
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        apart = set(whole)
        cut = pc.split_pattern(pa.array([GLUE if i in apart else GLUE + cut_at_spaces(t, CUT, GLUE) for i, t in enumerate(texts)], pa.large_string()), CUT)
        offsets, coded = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        entries, code = coded.dictionary, coded.indices.to_numpy()
        base = pc.utf8_rtrim(entries, MARKS)
        size = pc.binary_length(base)
        two = pc.and_(pc.less(size, pc.binary_length(entries)), pc.utf8_is_alpha(pc.utf8_ltrim(base, GLUE))).to_numpy(zero_copy_only=False)
        # the words that are looked up, and the punctuation behind them
        words = pc.if_else(pa.array(two), base, entries).dictionary_encode()
        cut_off = [e[n:] for e, n in zip(entries.filter(pa.array(two)).to_pylist(), pc.utf8_length(base).filter(pa.array(two)).to_pylist())]
        new = list(set(cut_off).difference(self.marks))
        self._each(self.marks, new, new)
        parts = self._ids_of(words.dictionary.to_pylist())
        n_words, marks = len(parts), {m: i for i, m in enumerate(dict.fromkeys(cut_off))}
        parts += [self.marks[m] for m in marks]
        first_of, mark_of = words.indices.to_numpy().astype(np.int64), np.full(len(entries), -1)
        mark_of[two] = [n_words + marks[m] for m in cut_off]
        end = len(parts)
        parts.append(np.array([end_id], "<u4").tobytes())
        parts += [array("I", made.ids).tobytes() for made in self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)]
        pool, size = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin, whole = np.cumsum(size) - size, np.array(whole, np.int64)
        made, counts, i = [], [], 0
        while i < len(texts):  # a few texts at a time, since the arrays below take several times a text's size
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
            own = code[offsets[i]:offsets[j]]
            # parts in order: a word, the punctuation behind it, and the end behind a text's last
            mark, ends = mark_of[own], offsets[i:j + 1].astype(np.int64) - offsets[i]
            last, taken = ends[1:] - 1, np.flatnonzero((whole >= i) & (whole < j))
            k = 1 + (mark >= 0)
            k[last] += 1
            at = np.cumsum(k) - k
            order = np.empty(int(k.sum()), np.int64)
            order[at] = first_of[own]
            order[at[mark >= 0] + 1] = mark[mark >= 0]
            stop = at[last] + k[last] - 1
            order[stop] = end
            order[at[ends[:-1][whole[taken] - i]]] = end + 1 + taken
            n = size[order]
            total = np.cumsum(n)
            made.append(pool[np.repeat(begin[order] - (total - n), n) + np.arange(total[-1])])
            counts.append(np.diff(total[stop], prepend=0))
            i = j
        return np.concatenate(made), np.concatenate(counts)


_LOADED: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def gathered(batches):
    """(ids, texts) of several Arrow batches at once, up to about ``TOGETHER`` characters."""
    import pyarrow as pa

    ids, texts, size = [], [], 0
    for batch in batches:
        ids.append(batch.column(0))
        texts += batch.column(1).to_pylist()
        size += batch.column(1).nbytes
        if size >= TOGETHER:
            yield pa.concat_arrays(ids), texts
            ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``, in ascending doc_id order.

    A null text is an empty one: its ids are ``end_id`` alone.  Rows with equal ids are ordered by a hash
    of their text; a null id comes first.  Files are shards in order: (shard, segment, first id of the shard's
    that it holds, doc_ids, lengths, block offsets, words).  Only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, shard = _tokens(tokenizer), TaskContext.get().partitionId()
        held_ids, held_n, held, size, first, segment = [], [], [], 0, 0, 0
        id_type = None

        def close():
            words, offsets = pack_blocks(np.concatenate(held))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
                pa.array([held_ids], pa.list_(id_type)), pa.array([held_n], pa.list_(pa.int32())),
                pa.array([offsets], pa.list_(pa.int32())), pa.array([words.astype("<u8").tobytes()], pa.binary())],
                names=["shard", "segment", "first", "n_ids", "doc_ids", "lengths", "offsets", "words"])

        for doc_ids, texts in gathered(batches):
            id_type = doc_ids.type
            ids, lengths = coder.encode(texts, end_id)
            at = 0
            for doc_id, n in zip(doc_ids.to_pylist(), lengths.tolist()):
                held_ids.append(doc_id)
                held_n.append(n)
                held.append(ids[at:at + n])
                at, size = at + n, size + n
                if size >= SEGMENT:
                    yield close()
                    first, segment = first + size, segment + 1
                    held_ids, held_n, held, size = [], [], [], 0
        if held:
            yield close()

    schema = T.StructType([
        *T.StructType.fromDDL("shard int, segment int, first bigint, n_ids bigint").fields, T.StructField("doc_ids", T.ArrayType(kind)),
        *T.StructType.fromDDL("lengths array<int>, offsets array<int>, words binary").fields])
    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(out)


def _read(spark: SparkSession, path: str, field: T.StructField, make) -> DataFrame:
    """(doc_id, start, n_tokens, field): ``make`` turns a segment's ids and its documents' ends into the field's column."""
    stored = spark.read.parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("held"))  # a row per file
    before = totals.select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("before"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, first, doc_ids, lengths, offsets, words in zip(*[batch.column(i) for i in range(6)]):
                ids = unpack_blocks(np.frombuffer(words.as_py(), "<u8"), offsets.as_py())
                n = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), shard.as_py(), np.int32)), doc_ids.values, pa.array(ends - n + first.as_py()), pa.array(n), make(ids, ends)],
                    names=["shard", "doc_id", "at", "n_tokens", field.name])

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", stored.schema["doc_ids"].dataType.elementType),
                           *T.StructType.fromDDL("at bigint, n_tokens bigint").fields, field])
    docs = stored.select("shard", "first", "doc_ids", "lengths", "offsets", "words").mapInArrow(run, schema)
    # One small row per file, so the ids themselves need no exchange.
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", field.name)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document in the files; start counts all ids before it."""
    def listed(ids, ends):
        import pyarrow as pa

        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _read(spark, path, T.StructField("ids", T.ArrayType(T.IntegerType())), listed)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as ``read_tokens``, with the unsigned crc32 of the ids as little-endian 32-bit integers."""
    def summed(ids, ends):
        import pyarrow as pa

        data, stops = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip([0, *stops], stops)], pa.int64())

    return _read(spark, path, T.StructField("ids_crc32", T.LongType()), summed)
