"""Language identification in two steps: the family, then one-versus-one linear machines inside it.

Features are hashed letter 1- to 3-grams of the whole text, as square roots of their shares (so every
text has unit length).  The family comes from one linear support vector machine per family against
the rest; inside it, every pair of languages has a machine of its own and the pairs vote.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import add_columns, fold, sampled

WIDTH = 1 << 12
SLICE = 1 << 20  # characters hashed at once
PER_LANGUAGE = 400  # expected rows of each language in the fit
FOLDS, HELD_OUT = 3, 1
MARGIN_COST = 10.0
EPOCHS = 25
UNKNOWN = "und"
#: Families of common language codes; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ur", "ne"),
}


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of n-gram shares; None for a text without letters.  Runs of other characters are one blank."""
    if not text:
        return None
    letters, counts, carry = _is_letter(), np.zeros(WIDTH, np.int64), np.zeros(1, np.uint32)
    found = False
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at:at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        real = letters[codes]
        found = found or bool(real.any())
        codes = np.where(real, codes, 0)
        codes = np.concatenate([carry, codes[real | np.concatenate([[True], real[:-1]])]]).astype(np.uint32)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        one, two = codes[1:] * np.uint32(2654435761), codes[:-1] * np.uint32(40503) + codes[1:] * np.uint32(2246822519)
        three = a * np.uint32(3266489917) + b * np.uint32(668265263) + c * np.uint32(374761393)
        for grams in (one[codes[1:] > 0], two, three):
            counts += np.bincount((grams ^ grams >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(20), minlength=WIDTH)
        carry = codes[-2:] if len(codes) > 1 else codes
    return np.sqrt(counts / counts.sum()) if found else None


def svm(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Linear machine (squared hinge, L2) by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / MARGIN_COST
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / MARGIN_COST
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    of_family: dict[str, np.ndarray] = field(default_factory=dict)
    of_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score in 0 to 1; ``und`` and 0 for texts without letters, or if nothing was learned."""
        x = features(text)
        if x is None or not self.families:
            return UNKNOWN, 0.0
        sure = lambda w: float(1 / (1 + np.exp(-4 * (w[:-1] @ x + w[-1]))))
        family, score = max(((f, sure(w)) for f, w in self.of_family.items()), key=lambda p: p[1], default=(next(iter(self.families)), 1.0))
        members = self.families[family]
        votes = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            p = sure(self.of_pair[a, b])
            votes[a] += p
            votes[b] += 1 - p
        best = max(members, key=lambda m: votes[m])
        return best, score * (votes[best] / (len(members) - 1) if len(members) > 1 else 1.0)


def fit_rows(x: np.ndarray, languages: list[str]) -> LanguageModel:
    model, lang = LanguageModel(), np.array(languages, dtype=object)
    for name in sorted(set(languages)):
        model.families.setdefault(family_of(name), []).append(name)
    kin = np.array([family_of(name) for name in languages], dtype=object)
    if len(model.families) > 1:
        for k, name in enumerate(model.families):
            model.of_family[name] = svm(x, np.where(kin == name, 1.0, -1.0), k)
    for members in model.families.values():
        for a, b in combinations(members, 2):
            own = (lang == a) | (lang == b)
            model.of_pair[a, b] = svm(x[own], np.where(lang[own] == a, 1.0, -1.0), 0)
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from about ``per_language`` texts of each non-null language outside the held-out fold.

    Repeated rows count once; texts without letters teach nothing, and an empty table gives a model that knows no language.
    """
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.withColumn("version", F.xxhash64("text"))
    keys = sampled(known.select("doc_id", "lang", "version"), "lang", per_language)
    # About per_language rows for each language, whatever the size of the table.
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("version").alias("_version"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("version") == F.col("_version"))
    rows = known.join(F.broadcast(keys), same).groupBy("doc_id", "lang", "version").agg(F.first("text").alias("text")).select("doc_id", "lang", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([None if m is None else m.astype("<f4").tobytes() for m in made], pa.binary())],
                                             names=["doc_id", "lang", "x"])

    got = [r for r in rows.mapInArrow(run, "doc_id bigint, lang string, x binary").collect() if r["x"] is not None]
    got.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"])))
    if not got:
        return LanguageModel()
    return fit_rows(np.stack([np.frombuffer(r["x"], "<f4") for r in got]).astype(float), [r["lang"] for r in got])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; held_out is the fold the fit leaves out.

    Null texts and texts without letters are ``und``, as is all if nothing was learned.  Ties go to the first family and
    language by name.  Every row is judged by itself, repeated ones alike; texts of any length are read whole, in parts.
    An empty table gives no rows.  Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers per family and per pair of languages

    def run(texts):
        import pyarrow as pa

        got = [shared.value.predict(t) for t in texts]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    named = add_columns(docs.select("doc_id", "text"), "text", run, T.StructType.fromDDL("lang_pred string, score double").fields)
    return named.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
