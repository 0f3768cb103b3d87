"""SimHash near-copies by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits.  The perfect binary Golay code
puts every 23-bit word within three bits of just one codeword, so a segment has a home index
(12 bits) and up to six indices that it decodes to when one bit is wrong.  Of at most three wrong bits
either each segment has one, or the two best segments share at most one; so a pair meets
under a key of two segments' indices, one side at home and the other within one bit of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import connected
from rasterloom.session import materialize

SHINGLE = 3
SEED = 42
NEAR = 3
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
GENERATOR = 0b101011100011  # of the [23, 12] code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECK = 23, 11
CHUNK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None) -> int:
    """Fingerprint as a signed 64-bit number; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp) of every whole text; version is a hash of the text, fp a signed 64-bit number."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = pa.array([fingerprint(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "version", "fp"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("version", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, schema)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator."""
    left = words.copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CHECK), 0)
    return left


def error_table() -> np.ndarray:
    """Error pattern of at most three bits for each syndrome; every syndrome has exactly one."""
    bits = [1 << i for i in range(LENGTH)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table = np.full(1 << CHECK, -1, np.int64)
    table[_syndromes(np.array(patterns, np.int64))] = patterns
    return table


_ERRORS: list[np.ndarray] = []


def index_of(words: np.ndarray) -> np.ndarray:
    """Index (upper 12 bits) of the codeword nearest to each 23-bit word."""
    if not _ERRORS:
        _ERRORS.append(error_table())
    return (words ^ _ERRORS[0][_syndromes(words)]) >> CHECK


def _near_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of each word and of the words one bit away, six at most, and which of the six count."""
    flipped = words[:, None] ^ np.array([0, *[1 << i for i in range(bits)]], np.int64)
    near = np.sort(index_of(flipped.ravel()).reshape(flipped.shape), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(near, order, 1), np.take_along_axis(new, order, 1)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Home keys (n, 3) and probe keys as (row, key) pairs of unsigned fingerprints."""
    parts = [(fps >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    home = [index_of(p) for p in parts]
    near = [_near_indices(p, bits) for p, (_, bits) in zip(parts, SEGMENTS)]
    tag = lambda pair, a, b: (pair << 24) | (a << 12) | b
    homes = np.stack([tag(0, home[0], home[1]), tag(1, home[0], home[2]), tag(2, home[1], home[2])], axis=1)
    rows, keys = [], []

    def add(key: np.ndarray, real: np.ndarray) -> None:
        flat = real.reshape(len(fps), -1)
        rows.append(np.nonzero(flat)[0])
        keys.append(np.broadcast_to(key, real.shape).reshape(len(fps), -1)[flat])

    (a, in_a), (b, in_b), (c, in_c) = near
    add(tag(0, a[:, :, None], b[:, None, :]), in_a[:, :, None] & in_b[:, None, :])
    for pair, (x, in_x), hx in ((1, near[0], home[0]), (2, near[1], home[1])):
        add(tag(pair, x, home[2][:, None]), in_x)
        add(tag(pair, hx[:, None], c), in_c & (c != home[2][:, None]))
    return homes, np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    def emit(probing):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                own = batch.column(0).to_numpy()
                homes, rows, keys = keys_of(own.view(np.uint64))
                rows, keys = (rows, keys) if probing else (np.repeat(np.arange(len(own)), 3), homes.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(own[rows], pa.int64()), pa.array(keys, pa.int64())], names=["fp", "key"])
        return run

    return fps.mapInArrow(emit(False), "fp bigint, key bigint"), fps.mapInArrow(emit(True), "fp bigint, key bigint")


def links(fps: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of different fingerprints with at most ``NEAR`` differing bits."""
    home, probe = _keyed(fps.select("fp"))
    met = probe.join(home.select(F.col("fp").alias("other"), "key").hint("shuffle_hash"), "key")
    met = met.filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= NEAR))
    return met.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v")).distinct()


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp, root, component_id) of every row; root is a component's own name, component_id is the smallest doc_id reachable by links.

    Rows with equal fingerprints are one node, so groups of exact copies cost one row.  Texts that are
    null or have no words have fingerprint 0 and are linked like any other.  Null ids are passed over for
    component_id, which is null only where all ids of a component are.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(links(nodes))
    named = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def with_links(found: DataFrame, more: DataFrame) -> DataFrame:
    """(doc_id, version, root) of every row of ``found``, components that share a text in ``more`` being one.

    Both give (doc_id, version, root), and rows of one version have one root in each.  A component is a node, so the graph
    that is contracted has a row for each pair of components that share a text.
    """
    found = materialize(found.select("doc_id", "version", "root"), "found")
    other = more.select("version", F.concat(F.lit("more:"), F.col("root").cast("string")).alias("v")).distinct()
    met = found.select("version", F.concat(F.lit("found:"), F.col("root").cast("string")).alias("u")).distinct().join(other, "version")
    named = connected(met.select("u", "v"))
    whole = found.withColumn("node", F.concat(F.lit("found:"), F.col("root").cast("string"))).join(named.withColumnRenamed("root", "_all"), "node", "left")
    return whole.select("doc_id", "version", F.coalesce("_all", "node").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id)."""
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One document of each component, that of the smallest id, with its own columns.

    ``found`` gives the components as (doc_id, version, root); by default they are those of the fingerprints.
    Of several rows with the smallest id, that of the smallest text hash stays; of identical ones, one.
    """
    found = materialize(components(docs) if found is None else found, "components")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")
    best = found.groupBy("root").agg(F.min(place).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_kept_id"), F.col("best.version").alias("_kept_version"))
    copies = found.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("_rows"))
    best = materialize(best.join(copies, F.col("_kept_id").eqNullSafe(F.col("doc_id")) & (F.col("_kept_version") == F.col("version")))
                       .select("_kept_id", "_kept_version", "_rows"), "kept")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", F.xxhash64("text").alias("version"))
    kept = keyed.join(best, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("version") == F.col("_kept_version")))
    several = kept.filter("_rows > 1").groupBy("doc_id", "version").agg(F.first("_doc").alias("_doc"))
    return kept.filter("_rows = 1").select("_doc.*").union(several.select("_doc.*"))
