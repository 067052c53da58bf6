"""Language identification in two steps: family first, then the language within it.

A text becomes the frequencies of its hashed letter 1- to 3-grams (square roots,
so that every text has length one). Linear support vector machines, one
against the rest, tell the families apart; within a family one-versus-one machines
vote between each two languages. All are fitted on the driver from the features of a
bounded sample of labelled rows: about ROWS_PER_LANGUAGE of each language,
chosen by a hash of identifier and text. Texts are read whole.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if no row is labelled. Ties go to the first name in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm import codepoints
from loanloom.llm.common import fresh, held_out
from loanloom.session import materialize

FEATURES = 4096
ROWS_PER_LANGUAGE = 1000
PIECE = 1 << 20  # code points looked at together
TOGETHER = 256  # texts whose features are held together
UNKNOWN = "und"

# fixed values: languages by family; a language that is not listed is its own family
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


# -------------------------------------------------------------------- features


def _gram_counts(points: np.ndarray) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of lower-case letters and word ends."""
    letter = codepoints.classes()[points] == codepoints.LETTER
    letters = np.where(letter, codepoints.lower()[points], 32).astype(np.uint32)
    keep = letter | np.concatenate(([True], letter[:-1]))  # one gap between words
    x = np.concatenate(([32], letters[keep], [32])).astype(np.uint32)
    a = x * np.uint32(2654435761)
    two = (a[:-1] ^ (x[1:] * np.uint32(40503))) * np.uint32(2246822519)
    three = (two[:-1] ^ (x[2:] * np.uint32(69069))) * np.uint32(3266489917)
    counts = np.zeros(FEATURES)
    for codes in (a[x != 32], two, three):
        counts += np.bincount(codes >> np.uint32(20), minlength=FEATURES)
    return counts


def lettered(text: str | None) -> np.ndarray | None:
    """Code points of a text, None without a letter."""
    points = codepoints.array_of(text) if text else None
    return points if text and (codepoints.classes()[points] == codepoints.LETTER).any() else None


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text's gram frequencies, None without a letter."""
    points = lettered(text)
    if points is None:
        return None
    counts = sum(_gram_counts(points[at : at + PIECE]) for at in range(0, len(points), PIECE))
    return np.sqrt(counts / counts.sum()).astype(np.float32)


# ----------------------------------------------------------------------- model


def fit_machine(x: np.ndarray, positive: np.ndarray, rounds: int = 120, cost: float = 20.0) -> np.ndarray:
    """Weights of an L2 support vector machine with squared hinge loss; ``x`` holds the intercept's ones."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    weight = (2 * cost * share).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, step = w, 1.0 / (1.0 + 2.0 * float(weight @ np.einsum("ij,ij->i", x, x)))
    for k in range(rounds):  # accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead - x.T @ (weight * slack * y))
        ahead, w = new + (k / (k + 3)) * (new - w), new
    return w


@dataclass
class LanguageModel:
    """Fitted machines: one per family, one per pair of languages of a family."""

    members: dict[str, list[str]] = field(default_factory=dict)
    family: dict[str, np.ndarray] = field(default_factory=dict)
    pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of features."""
        families = sorted(self.members)
        if not families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        x = np.hstack((x, np.ones((len(x), 1), np.float32)))
        if len(families) > 1:
            margins = np.stack([x @ self.family[f] for f in families], axis=1)
            chosen = margins.argmax(axis=1)
            score = 1 / (1 + np.exp(-2 * margins.max(axis=1)))
        else:
            chosen, score = np.zeros(len(x), int), np.ones(len(x))
        names = np.array([""] * len(x), dtype=object)
        for k, f in enumerate(families):
            rows = np.flatnonzero(chosen == k)
            languages = self.members[f]
            votes, margin = np.zeros((len(rows), len(languages))), np.full((len(rows), len(languages)), np.inf)
            for i, j in combinations(range(len(languages)), 2):
                m = x[rows] @ self.pair[languages[i], languages[j]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                margin[:, i], margin[:, j] = np.minimum(margin[:, i], m), np.minimum(margin[:, j], -m)
            best = votes.argmax(axis=1)
            names[rows] = np.array(languages, dtype=object)[best]
            score[rows] *= 1 / (1 + np.exp(-2 * margin[np.arange(len(rows)), best]))
        return names.tolist(), score


def sample(docs: DataFrame, training: Column, doc_id: str, text: str, lang: str) -> DataFrame:
    """About ROWS_PER_LANGUAGE labelled training rows of each language: name, text, taken.

    Rows that agree in language, identifier and text are one point, which is taken as often
    as its copies' share of the sample says, a fraction being settled by the point's hash.
    """
    labelled = docs.where(training & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("name"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("place"),
    )
    points = materialize(
        labelled.groupBy("name", "place").agg(F.count(F.lit(1)).alias("copies")), "language-points"
    )
    totals = points.groupBy("name").agg(F.sum("copies").alias("total"))  # one row per language
    spread = 1 << 30
    share = F.least(F.lit(1.0), F.lit(float(ROWS_PER_LANGUAGE)) / F.col("total"))
    chance = F.pmod("place", F.lit(spread)) / F.lit(float(spread))
    chosen = (
        points.join(F.broadcast(totals), "name")
        .select("name", "place", F.floor(F.col("copies") * share + chance).alias("taken"))
        .where("taken > 0")
    )
    # the chosen points are about ROWS_PER_LANGUAGE per language, whatever the identifiers are
    found = labelled.join(F.broadcast(chosen), ["name", "place"])
    return found.groupBy("name", "place").agg(F.min("text").alias("text"), F.first("taken").alias("taken")).drop("place")


def fit(
    docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> LanguageModel:
    """Fit on a bounded sample of the rows where ``training`` holds."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            rows = [
                (n, v.astype(np.float16).tobytes(), k)
                for n, v, k in zip(batch["name"], found, batch["taken"]) if v is not None
            ]
            yield pd.DataFrame(rows, columns=["name", "vector", "taken"])

    chosen = sample(docs, training, doc_id, text, lang)
    points = chosen.mapInPandas(vectors, "name string, vector binary, taken long").collect()  # a bounded sample
    rows = [r for r in points for _ in range(r["taken"])]
    model = LanguageModel()
    if not rows:
        return model
    rows.sort(key=lambda r: (r["name"], bytes(r["vector"])))
    x = np.ones((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, :-1] = np.frombuffer(r["vector"], np.float16)
    names = np.array([r["name"] for r in rows])
    groups = np.array([family_of(n) for n in names])
    for f in sorted(set(groups)):
        model.members[f] = sorted(set(names[groups == f]))
    for f in model.members:
        if len(model.members) > 1:
            model.family[f] = fit_machine(x, groups == f)
        for a, b in combinations(model.members[f], 2):
            rows_ab = (names == a) | (names == b)
            model.pair[a, b] = fit_machine(x[rows_ab], names[rows_ab] == a)
    return model


# ------------------------------------------------------------------- operators


def _predictor(model: LanguageModel):
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), TOGETHER):
            found = [features(t) for t in texts[at : at + TOGETHER]]
            known = [i for i, v in enumerate(found) if v is not None]
            if known:
                some, values = model.predict(np.stack([found[i] for i in known]))
                for i, name, value in zip(known, some, values):
                    names[at + i], scores[at + i] = name, float(value)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def identify(
    docs: DataFrame, folds: int = 3, fold: int = 1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learning from the rows that are not held out."""
    out = held_out(doc_id, folds, fold)
    predict = _predictor(fit(docs, ~out, doc_id, text, lang))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), out.alias("held_out"), predict(F.col(text).cast("string")).alias("p")
    )
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(
    docs: DataFrame,
    least_score: float = 0.0,
    folds: int = 3,
    fold: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text has a language; ``und`` and lower scores go.

    With the least score of 0 only texts without a letter are ``und``. Where nothing was
    learned there are no scores, and every text with a letter stays.
    """
    model = fit(docs, ~held_out(doc_id, folds, fold), doc_id, text, lang)
    if not model.members:

        @F.pandas_udf("boolean")
        def has_letter(texts: pd.Series) -> pd.Series:
            return pd.Series([lettered(t) is not None for t in texts], dtype=bool)

        return docs.where(has_letter(F.col(text).cast("string")))
    predict = _predictor(model)
    (found,) = fresh(docs, "language_found")
    marked = docs.withColumn(found, predict(F.col(text).cast("string")))
    kept = marked.where((F.col(found)["lang_pred"] != UNKNOWN) & (F.col(found)["score"] >= least_score))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
