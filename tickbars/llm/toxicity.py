"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

Words, and the stems that open them, get log-odds of standing in a toxic document. Their
Dirichlet priors are centred one level up: a word's on its stem, a stem's on all documents. A
word that says nothing weighs a little against toxicity, as it does by the odds of such
words. One linear scan of a text finds all maximal segments; the score of a segment that
stands out in clean text follows an extreme-value law whose two constants are fitted on clean
documents, and the segments of a document are joined to one p-value by the law of their sums.
A logistic curve over its logarithm gives the score.

Texts are scanned where they lie. Labels are taken from at most SAMPLE documents, chosen by a
hash of the id; the driver holds their ids and the words that tell, at most VOCABULARY.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.llm.common import scratch

#: Labelled documents to learn from at most, and entries that tell at most.
SAMPLE = 200_000
VOCABULARY = 50_000

#: Letters of a stem, and weights of the priors in documents.
STEM = 5
WORD_PRIOR = 5.0
STEM_PRIOR = 8.0

#: A stem or word tells if its log-odds are at least this.
TELLING = 2.0

#: Fixed value: words are runs of letters.
_LETTERS = re.compile(r"[^\W\d_]+")
_SPLIT = r"[^\p{L}]+"


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text has remainder 0 by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Labels (id, toxic) outside the held-out fold, at most ``sample``, chosen by a hash of the id.

    An id labelled both ways is toxic; null ids and labels are left out.
    """
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).dropna()
    rows = scratch(rows.filter(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rate = min(1.0, sample / max(1, rows.count()))
    while True:
        picked = rows.filter(place < int(rate * (1 << 30)))
        if picked.count() <= sample:
            return picked
        rate *= 0.98


class ToxicityModel:
    """Weights of telling words and stems, the drift of all others, and the calibration."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], drift: float):
        self.words, self.stems, self.drift = words, stems, drift
        self.rate, self.scale = 1.0, 1e-4
        self.slope, self.level = 1.0, -3.0

    @classmethod
    def fit(
        cls,
        docs: DataFrame,
        labels: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        label_col: str = "toxic",
        sample: int = SAMPLE,
    ) -> ToxicityModel:
        """Learn from documents whose ids are labelled and not held out. Without any, nothing is toxic."""
        picked = F.broadcast(training_labels(labels, id_col, label_col, sample))
        text = F.coalesce(docs[text_col], F.lit(""))
        known = docs.select(docs[id_col].alias("id"), text.alias("text")).join(picked, "id").select("text", "toxic")
        known = scratch(known, "labelled")
        model = cls._weigh(known)
        model._calibrate(known)
        return model

    @classmethod
    def _weigh(cls, known: DataFrame) -> ToxicityModel:
        """Document counts of words and stems by label, then log-odds with priors."""
        sides = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, clean = sides.get(1, 0), sides.get(0, 0)
        share = (toxic + 0.5) / (toxic + clean + 1.0)
        own = known.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), _SPLIT))).alias("word")).filter("word != ''")
        words = own.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
        words = scratch(words.withColumn("stem", F.substring("word", 1, STEM)), "words")
        logit = lambda t, n: F.log(t / (n - t)) - math.log(share / (1 - share))
        stems = words.groupBy("stem").agg(F.sum("t").alias("st"), F.sum("n").alias("sn")).withColumns({
            "p": (F.col("st") + STEM_PRIOR * share) / (F.col("sn") + STEM_PRIOR),
            "stem_odds": logit(F.col("st") + STEM_PRIOR * share, F.col("sn") + STEM_PRIOR),
        })
        odds = logit(F.col("t") + WORD_PRIOR * F.col("p"), F.col("n") + WORD_PRIOR)
        told = words.join(stems, "stem").withColumn("odds", odds).filter((F.col("odds") >= TELLING) | (F.col("stem_odds") >= TELLING))
        told = scratch(told, "telling-words")
        top = lambda df, key, by: df.orderBy(F.desc(by), key).limit(VOCABULARY).toPandas()
        stem_rows = top(told.filter(F.col("stem_odds") >= TELLING).select("stem", "stem_odds", "st").distinct(), "stem", "st")
        word_rows = top(told.select("word", "odds", "n"), "word", "n")
        model = cls(dict(zip(word_rows["word"], word_rows["odds"], strict=True)), dict(zip(stem_rows["stem"], stem_rows["stem_odds"], strict=True)), 0.05)
        model.drift = model._drift(known)
        return model

    def _drift(self, known: DataFrame) -> float:
        """What a word that doesn't tell weighs against toxicity: its odds by label, over all words of the sample."""
        count = F.pandas_udf(lambda texts: _counted(self, texts), "all long, told long")
        sums = known.withColumn("c", count("text")).groupBy("toxic").agg(F.sum("c.all").alias("a"), F.sum("c.told").alias("b")).collect()
        rest = {r["toxic"]: (r["a"] - r["b"] + 1) / (r["a"] + 1) for r in sums}
        return max(0.01, math.log(rest.get(0, 1.0) / rest.get(1, 1.0)))

    def _calibrate(self, known: DataFrame) -> None:
        """Fit the extreme-value law on clean documents, then the logistic curve on all, both over counts by bins."""
        found = scratch(known.select("toxic", self._stats(F.col("text")).alias("s")).select("toxic", "s.*"), "segments")
        clean = found.filter("toxic = 0")
        floor = TELLING
        sums = clean.select("tokens", F.explode_outer("scores").alias("x")).agg(
            F.count_if(F.col("x") >= floor), F.sum(F.when(F.col("x") >= floor, F.col("x") - floor))
        ).first()
        length = clean.agg(F.sum("tokens")).first()[0] or 0
        n, above = sums[0] or 0, sums[1] or 0.0
        # the tail of log-odds falls at rate 1; one segment and its excess of 1 stand for that
        self.rate = (n + 1) / (above + 1)
        self.scale = (n + 0.5) / (length + 1) * math.exp(self.rate * floor)
        evidence = F.pandas_udf(lambda t, s: pd.Series([self.evidence(a, b) for a, b in zip(t, s, strict=True)], dtype=float), "double")
        binned = found.select("toxic", F.round(evidence("tokens", "scores") * 4).cast("int").alias("bin"))
        bins = binned.groupBy("bin").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).toPandas()
        if len(bins):
            self.slope, self.level = _logistic(bins["bin"].to_numpy() / 4, bins["t"].to_numpy(float), bins["n"].to_numpy(float))

    def evidence(self, tokens: int, scores: list[float]) -> float:
        """Minus the logarithm of the least p-value over the best r segments, at most 60."""
        if tokens == 0 or len(scores) == 0:
            return 0.0
        size = math.log(self.scale * tokens + 1e-12)
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            total += self.rate * score - size
            if total <= r:
                continue
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            best = max(best, -log_p)
            if best >= 60:
                return 60.0
        return best

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.level))))

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        return found if found is not None else self.stems.get(word[:STEM], -self.drift)

    def _stats(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("tokens int, scores array<double>")
        def stats(texts: pd.Series) -> pd.DataFrame:
            rows = [_scanned(model, t) for t in texts]
            return pd.DataFrame({"tokens": [n for n, _ in rows], "scores": [[s[2] for s in found] for _, found in rows]})

        return stats(text)

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic; empty and null texts get what a text without evidence gets."""
        model = self

        @F.pandas_udf("double")
        def scores(texts: pd.Series) -> pd.Series:
            return pd.Series([model._score(t) for t in texts], dtype=float)

        return scores(F.coalesce(text, F.lit("")))

    def _score(self, text: str) -> float:
        tokens, found = _scanned(self, text)
        return self.probability(self.evidence(tokens, [s for _, _, s in found]))

    def passages(self, text: Column, significance: float = 0.01) -> Column:
        """The toxic passages of a text with an expected number by chance below ``significance``.

        An array of start and end (characters), score and expected (e-value).
        """
        model = self

        @F.pandas_udf("array<struct<start:int,end:int,score:double,expected:double>>")
        def found(texts: pd.Series) -> pd.Series:
            out = []
            for text in texts:
                tokens, segments = _scanned(model, text)
                places = [m.span() for m in _LETTERS.finditer(text.lower())] if segments else []
                told = [
                    {"start": places[a][0], "end": places[b][1], "score": s, "expected": model.scale * tokens * math.exp(-model.rate * s)}
                    for a, b, s in segments
                ]
                out.append([t for t in told if t["expected"] <= significance])
            return pd.Series(out, dtype=object)

        return found(F.coalesce(text, F.lit("")))


def _counted(model: ToxicityModel, texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words = _LETTERS.findall(text.lower())
        rows.append((len(words), sum(1 for w in words if model.weight(w) > 0)))
    return pd.DataFrame(rows, columns=["all", "told"])


def _scanned(model: ToxicityModel, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and all maximal segments as first and last word and score."""
    words = _LETTERS.findall(text.lower())
    known, stems, get = model.words, model.stems, model.weight
    hits = [(i, get(word)) for i, word in enumerate(words) if word in known or word[:STEM] in stems]
    return len(words), maximal_segments(hits, model.drift) if hits else []


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence in linear time.

    ``hits`` are the positions with a weight of their own; all others weigh minus ``drift``. A
    segment is kept with the sums before and after it. A new one looks back for the last kept
    one that starts lower; it stands alone if that one ends at least as high, else both are joined,
    and the joined one looks back again.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, -1
    for place, weight in hits:
        total -= drift * (place - at - 1)
        at = place
        before, total = total, total + weight
        if weight <= 0:
            continue
        first, last, low, high = place, place, before, total
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, last, low, high, j))
                break
            first, low, link = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = link
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _logistic(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton's method, with half a document of either label at both ends."""
    x = np.concatenate([x, [0.0, 0.0, 60.0, 60.0]])
    toxic = np.concatenate([toxic, [0.0, 0.5, 0.5, 0.5]])
    n = np.concatenate([n, [0.5, 0.5, 0.5, 0.5]])
    w = np.array([0.1, math.log((toxic.sum()) / (n.sum() - toxic.sum() + 0.5))])
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (toxic - n * p) - np.array([0.01, 0.0]) * w
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-6])
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])
