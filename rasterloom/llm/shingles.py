"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of few differing bits do not reach that far, so candidates meet under banded MinHash keys:
two texts at similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8.  Under a key every
text first meets two centres, which a hash chooses anew for each key, so that most of a group is joined by work that
grows with its size.  Then all texts of a key that are still in different components meet in blocks, so no two
texts that share a key and are alike stay apart.  What meets is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import connected
from rasterloom.session import by_key_stream, materialize

SHINGLE = 5
SIMILAR = 0.8
BANDS = 20
ROWS = 5  # minima in a band's key
SEED = 42
CHUNK = 1 << 12  # shingles that are permuted at once
BLOCK = 256  # texts of a block
BLOCK_SHINGLES = 1 << 20  # and their shingles, about


def shingle_set(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``length`` words; a shorter text is one run, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:max(1, len(words) - length + 1)].tolist(), ends[min(length, len(words)) - 1:].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), "<u8", len(first)))


def node_of(held: np.ndarray) -> str:
    """Name of a set of shingles; texts with equal sets are one node."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(held.tobytes(), SEED)


def keys_of(held: np.ndarray) -> np.ndarray:
    """One signed 64-bit key a band; none for no shingles."""
    import xxhash

    if not len(held):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(SEED)
    times, plus = (rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    times |= np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), CHUNK):
        least = np.minimum(least, (held[at:at + CHUNK, None] * times + plus).min(0))
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))], "<u8").view("<i8")


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, version, node, n: shingles, keys) of every row; version is a hash of the text."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(2).to_pylist():
                held = shingle_set(text)
                nodes.append(node_of(held))
                sizes.append(len(held))
                keys.append(keys_of(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "version", "node", "n", "keys"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("version bigint, node string, n bigint, keys array<bigint>").fields])
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """(node, keys, held: its shingles) of ``texts`` (node, keys, text)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held = [np.sort(shingle_set(x).view("<i8")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.int64()))], names=["node", "keys", "held"])

    return texts.select("node", "keys", "text").mapInArrow(run, "node string, keys array<bigint>, held array<bigint>").dropDuplicates(["node"])


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _verified(sent: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the roots of texts that were sent to one place and are alike.

    ``sent`` holds (place, key, side, node, root); a set travels once to each place.  Texts of different
    sides meet, those of side 2 meet each other too; roots that a place has linked already are not compared again.  With a
    ``key``, a pair is compared under the first key it shares only.
    """
    def meet(pdf):
        import pandas as pd

        out = []
        for _, group in pdf.groupby("place", sort=False):
            side, roots, held = group["side"].to_numpy(), group["root"].tolist(), group["held"].tolist()
            key = group["key"].iloc[0]
            keys = None if pd.isna(key) else np.stack(group["keys"].tolist())
            up = {r: r for r in roots}

            def top(r):
                while up[r] != r:
                    up[r] = up[up[r]]
                    r = up[r]
                return r

            for i in range(len(roots)):
                others = np.nonzero((side[:i] != side[i]) | (side[i] == 2))[0]
                if keys is not None and len(others):
                    shared = keys[others] == keys[i]
                    others = others[keys[i][shared.argmax(1)] == int(key)]
                for j in others.tolist():
                    u, v = top(roots[i]), top(roots[j])
                    if u != v and _alike(held[i], held[j]):
                        up[max(u, v)] = min(u, v)
                        out.append((max(roots[i], roots[j]), min(roots[i], roots[j])))
        return pd.DataFrame(out, columns=["u", "v"])

    full = sent.join(sets, "node").select("place", F.col("key").cast("string").alias("key"), "side", "root", "keys", "held")
    return by_key_stream(full, ["place"], meet, "u string, v string")


def _centred(keyed: DataFrame) -> DataFrame:
    """Every text to the two centres of its keys, a centre's texts in blocks; (place, key, side, node, root)."""
    salt = F.xxhash64("key", "node")
    whom = F.struct("node", "n")
    centres = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min_by(whom, salt).alias("low"), F.max_by(whom, salt).alias("high")).filter("rows > 1")
    met = keyed.join(centres, "key").select("node", "n", F.explode(F.array("low", "high")).alias("c"))
    met = met.filter((F.col("node") != F.col("c.node")) & (F.least("n", "c.n") >= SIMILAR * F.greatest("n", "c.n")))
    met = materialize(met.select("node", "n", F.col("c.node").alias("centre")).distinct(), "met")
    units = F.count(F.lit(1)) / BLOCK + F.sum("n") / BLOCK_SHINGLES
    blocks = met.groupBy("centre").agg(F.ceil(units).alias("blocks"))
    place = lambda i: F.concat_ws(":", "centre", i.cast("string"))
    none = F.lit(None).cast("bigint").alias("key")
    own = blocks.select("centre", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("i"))
    own = own.select(place(F.col("i")).alias("place"), none, F.lit(0).alias("side"), F.col("centre").alias("node"), F.col("centre").alias("root"))
    theirs = met.join(blocks, "centre").select(place(F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("place"), none, F.lit(1).alias("side"), "node", F.col("node").alias("root"))
    return own.union(theirs)


def _apart(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """Texts that share a key and are in different components, in pairs of blocks; (place, key, side, node, root).

    A component with many texts under a key has blocks of its own, which never meet each other; the small ones share blocks.
    """
    rooted = keyed.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    by_root = rooted.groupBy("key", "root").agg((F.count(F.lit(1)) / BLOCK + F.sum("n") / BLOCK_SHINGLES).alias("units"))
    by_root = by_root.withColumn("own", F.col("units") >= 0.5)
    shared = F.sum(F.when(~F.col("own"), F.col("units")).otherwise(0.0))
    several = by_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.greatest(F.lit(1), F.ceil(shared)).alias("pool")).filter("roots > 1")
    named = by_root.join(several, "key").select("key", "root", "own", F.when(F.col("own"), F.ceil("units")).otherwise(F.col("pool")).alias("blocks"))
    owner = F.when(F.col("own"), F.col("root")).otherwise("")
    number = F.pmod(F.when(F.col("own"), F.xxhash64("node")).otherwise(F.xxhash64("root")), F.col("blocks"))
    members = materialize(rooted.join(named, ["key", "root"]).select("key", "node", "root", owner.alias("owner"), F.concat_ws(":", owner, number.cast("string")).alias("block")), "apart")
    blocks = members.select("key", "owner", "block").distinct()
    a, b = (blocks.select("key", F.col("owner").alias(f"{s}_owner"), F.col("block").alias(s)) for s in "ab")
    meets = a.join(b, "key").filter("a <= b AND (a_owner <> b_owner OR a_owner = '')").select(
        F.col("key").alias("_key"), "a", "b", F.concat_ws("|", F.col("key").cast("string"), "a", "b").alias("place"))
    first = members.join(meets, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("a"))).select(
        "place", "key", F.when(F.col("a") == F.col("b"), 2).otherwise(0).alias("side"), "node", "root")
    second = members.join(meets.filter("a <> b"), (F.col("key") == F.col("_key")) & (F.col("block") == F.col("b"))).select(
        "place", "key", F.lit(1).alias("side"), "node", "root")
    return first.union(second)


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, version, root) of every row; rows of one root are near copies or linked by such.

    Rows with equal sets of shingles are one node, so groups of exact copies cost one row; texts that are null
    or have no words are one node too, and nothing else links to it.  Null ids are ids like others, texts of any length are
    taken whole, an empty table gives no rows; only doc_id and text are read.
    """
    marked = materialize(_marked(docs), "shingled")
    place = F.struct("doc_id", "version")
    nodes = materialize(marked.groupBy("node").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    keyed = materialize(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "key").select("key", "node", "n"), "keyed")
    wanted = keyed.select("node").distinct().join(nodes, "node")
    wanted = wanted.select("node", "keys", F.col("place.doc_id").alias("_id"), F.col("place.version").alias("_version"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")))
    sets = materialize(_sets(texts), "sets")
    roots = connected(_verified(_centred(keyed), sets))
    left = materialize(_verified(_apart(keyed, roots), sets), "left")
    found = marked.join(roots, "node", "left").select("doc_id", "version", F.coalesce("root", "node").alias("root"))
    if left.isEmpty():
        return found
    last = connected(left).select(F.col("node").alias("root"), F.col("root").alias("_last"))
    return found.join(last, "root", "left").select("doc_id", "version", F.coalesce("_last", "root").alias("root"))
