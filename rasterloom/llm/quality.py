"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), linear in the
number of features that a text has.  The model is fitted on a bounded, hash-chosen sample of labelled
rows (``PER_CLASS`` rows a label) and the intercept is set back to the labels' true shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import add_columns, fold, sampled

WORD_BITS = 16
BINS = 16
STATISTICS = ("bytes", "words", "word_length", "upper", "letters", "digits", "symbols", "distinct", "top_word", "lines",
              "line_length", "repeated_lines", "bytes_per_char", "n_chars")
WIDTH = (1 << WORD_BITS) + BINS * len(STATISTICS)
RANK = 8
PER_CLASS = 1500  # expected rows of each label in the fit
EPOCHS = 6
RATE = 0.1
WORD_WEIGHT = 0.25  # length of the vector of all words, against 1 for each statistic
DECAY = 1e-4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SYMBOLS = frozenset(range(33, 127)) - frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:?'\"()-")


def _shares(of, whole) -> int:
    """Bin of a share: finer near 0, where most texts lie."""
    return min(BINS - 1, int((of / whole) ** 0.5 * BINS)) if whole else 0


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text; a null text is an empty one, a null length is bin 0."""
    from collections import Counter
    from zlib import crc32

    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    upper, lower, digits, high = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum()), int(seen[128:].sum())
    symbols = int(seen[list(SYMBOLS)].sum())
    visible = len(data) - int(seen[32]) - int(seen[9:14].sum())
    words = Counter(text.split())
    total = words.total()
    lines = text.split("\n")
    log = lambda n: min(BINS - 1, int(n or 0).bit_length())
    bins = (log(len(data)), log(total), min(BINS - 1, visible // total) if total else 0, _shares(upper, upper + lower), _shares(upper + lower + high, visible),
            _shares(digits, visible), _shares(symbols, visible), _shares(len(words), total), _shares(max(words.values(), default=0), total),
            log(len(lines)), log(len(text) // len(lines)), _shares(len(lines) - len(set(lines)), len(lines)),
            min(BINS - 1, int(8 * (len(data) / len(text) - 1))) if text else 0, log(n_chars))
    hashed = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) & ((1 << WORD_BITS) - 1)
    index = np.concatenate([np.unique(hashed), (1 << WORD_BITS) + BINS * np.arange(len(bins)) + np.array(bins, np.int64)])
    value = np.ones(len(index))
    value[:-len(bins)] = WORD_WEIGHT / np.sqrt(max(1, len(index) - len(bins)))
    return index, value


@dataclass
class FactorMachine:
    w0: float
    w: np.ndarray  # (WIDTH,)
    v: np.ndarray  # (WIDTH, RANK)

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.v[index]
        s = x @ v
        return self.w0 + float(self.w[index] @ x) + 0.5 * float(s @ s - (x * x) @ (v * v).sum(1))

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, x), -30, 30))))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float) -> FactorMachine:
    """AdaGrad on logistic loss, rows in a seeded order.  ``prior`` is the share of label 1 to score for.

    Without rows of both labels the model knows the prior only (0.5 if there are no labels).
    """
    rng = np.random.default_rng(7)
    model = FactorMachine(0.0, np.zeros(WIDTH), rng.normal(0, 0.01, (WIDTH, RANK)))
    ones = sum(y for *_, y in rows)
    odds = lambda p: float(np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1 - 1e-6)))
    if not 0 < ones < len(rows):
        model.v[:] = 0
        model.w0 = odds(prior)
        return model
    g0, gw, gv = 1e-6, np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6)
    for _ in range(EPOCHS):
        for at in rng.permutation(len(rows)):
            index, x, y = rows[at]
            slope = model.score(index, x) - y
            v = model.v[index]
            dw = slope * x + DECAY * model.w[index]
            dv = slope * (np.outer(x, x @ v) - (x * x)[:, None] * v) + DECAY * v
            g0 += slope * slope
            gw[index] += dw * dw
            gv[index] += dv * dv
            model.w0 -= RATE * slope / np.sqrt(g0)
            model.w[index] -= RATE * dw / np.sqrt(gw[index])
            model.v[index] = v - RATE * dv / np.sqrt(gv[index])
    model.w0 += odds(prior) - odds(ones / len(rows))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorMachine:
    """Learns from labelled rows outside the held-out fold; labels other than 0 and 1 are ignored.

    Repeated labels count once, an id with both labels counts for both, and of several texts of one id that of the
    smallest hash is learned from.  Without labels the model scores 0.5.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}  # two rows at most
    chosen = sampled(known, "quality", per_class).select(F.col("doc_id").alias("_chosen"), "quality")
    # The chosen labels are about 2 * per_class rows, whatever the size of the tables.
    texts = docs.select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars") if "n_chars" in docs.columns else F.lit(None).cast("bigint").alias("n_chars"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_chosen"))
    one = F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars"))
    rows = rows.groupBy("doc_id", "quality").agg(one.alias("_one")).select("doc_id", "_one.text", "_one.n_chars", "quality")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(3), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()),
                 pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())], names=["doc_id", "quality", "i", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, quality int, i binary, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["i"])))
    data = [(np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float), r["quality"]) for r in got]
    total = sum(counts.values())
    return fit_rows(data, counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: FactorMachine) -> DataFrame:
    """``docs`` with columns score and predicted; columns of these names are replaced.

    A null or empty text is scored by its statistics, which are all at their lowest.  Rows are independent, so repeated
    rows and ties get equal scores; texts of any length are read whole, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH * (RANK + 1) numbers
    meta = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    packed = docs.select(F.struct(*rest).alias("_row"), F.struct(F.col("text"), meta.alias("n")).alias("_in"))

    def run(cells):
        import pyarrow as pa

        got = [shared.value.score(*features(c["text"], c["n"])) for c in cells]
        return [pa.array(got, pa.float64())]

    scored = add_columns(packed, "_in", run, [T.StructField("score", T.DoubleType())])
    return scored.select("_row.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: FactorMachine) -> DataFrame:
    """The documents predicted 1, with their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "text", *[c for c in ("n_chars",) if c in docs.columns])
    return score(packed, model).filter("predicted = 1").select("_doc.*")
