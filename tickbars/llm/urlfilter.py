"""URL filter: rules by host and path, else naive Bayes over segmented words.

Names in hosts are often words run together. A unigram model splits them at the most probable
places (Viterbi); multinomial naive Bayes then scores the words of host and path. Examples to
block are the urls that hold a seed word, a parameter; all others are examples to allow. Word
counts cover all urls; the two models keep their most frequent entries, a fixed number that the
driver holds and sends to the workers. Nothing is shuffled but counts.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.llm.common import scratch

#: Entries of the lexicon and of the Bayes model at most.
LEXICON = 100_000
VOCABULARY = 100_000

#: Longest word that a name is split into.
LONGEST = 24

#: Words that mark an example to block.
SEEDS = (
    "ads", "adult", "bet", "bets", "casino", "cheap", "dating", "escort", "farm", "free", "gamble", "gambling", "jackpot",
    "lottery", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx",
)

#: Seeds that are common words by themselves count only beside another one.
_WEAK = ("cheap", "farm", "free", "track", "win")

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, a struct of rule (its host and path) and verdict; null if none does.

    A rule (verdict, host, path start) fits its host and all subdomains. Of rules as long, block wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class UrlModel:
    """Both models, fitted on a table of hosts, paths and titles; ``score`` is the log-odds to block."""

    def __init__(self, words: dict[str, float], unknown: float, odds: dict[str, float], prior: float):
        self.words, self.unknown, self.odds, self.prior = words, unknown, odds, prior

    @classmethod
    def fit(cls, urls: DataFrame, seeds: tuple[str, ...] = SEEDS, lexicon: int = LEXICON, vocabulary: int = VOCABULARY) -> UrlModel:
        """From rows of host, path and title. Without rows every url is as likely as the prior says: allow."""
        pieces = lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))
        names = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
        words = F.concat(pieces(F.array_join(names, " ")), pieces(F.col("path")), pieces(F.col("title")))
        counts = urls.select(F.explode(words).alias("word")).filter(F.length("word") <= LONGEST).groupBy("word").count()
        top = counts.orderBy(F.desc("count"), "word").limit(lexicon).collect()
        total = sum(r["count"] for r in top) + 10 * len(seeds) or 1
        known = {r["word"]: r["count"] for r in top}
        for seed in seeds:
            known[seed] = known.get(seed, 0) + 10
        model = cls({w: math.log(n / total) for w, n in known.items()}, math.log(10 / total), {}, 0.0)

        marked = urls.select(model.tokens(F.col("host"), F.col("path")).alias("tokens"))
        strong = F.array(*[F.lit(s) for s in seeds if s not in _WEAK])
        weak = F.array(*[F.lit(s) for s in seeds if s in _WEAK])
        block = F.arrays_overlap("tokens", strong) | (F.size(F.array_intersect("tokens", weak)) > 1)
        marked = scratch(marked.select("tokens", F.coalesce(block, F.lit(False)).alias("block")), "url-tokens")
        sides = {r["block"]: r["n"] for r in marked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        each = marked.select("block", F.explode("tokens").alias("token")).groupBy("token").agg(
            F.count_if("block").alias("bad"), F.count_if(~F.col("block")).alias("good")
        )
        sums = each.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
        bad, good, distinct = (sums[0] or 0), (sums[1] or 0), sums[2]
        rows = each.orderBy(F.desc(F.col("bad") + F.col("good")), "token").limit(vocabulary).collect()
        base = math.log((good + distinct + 1) / (bad + distinct + 1))
        model.odds = {r["token"]: math.log((r["bad"] + 1) / (r["good"] + 1)) + base for r in rows}
        model.prior = math.log((sides.get(True, 0) + 1) / (sides.get(False, 0) + 1))
        return model

    def segment(self, name: str) -> list[str]:
        """The most probable words of a name; an unknown word costs ten times as much with each letter."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(
                max(
                    (best[start][0] + self.words.get(name[start:end], self.unknown - (end - start) * math.log(10)), start)
                    for start in range(max(0, end - LONGEST), end)
                )
            )
        out, end = [], len(name)
        while end:
            start = best[end][1]
            out.append(name[start:end])
            end = start
        return out[::-1]

    def tokens(self, host: Column, path: Column) -> Column:
        """Words of the host, and words and kinds of numbers of the path, in an array."""
        model = self

        @F.pandas_udf("array<string>")
        def split(hosts: pd.Series, paths: pd.Series) -> pd.Series:
            of = _memory(model)
            return pd.Series([of(h) + _path_tokens(p) for h, p in zip(hosts, paths, strict=True)], dtype=object)

        return split(F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")))

    def score(self, host: Column, path: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def odds(hosts: pd.Series, paths: pd.Series) -> pd.Series:
            of = _memory(model)
            return pd.Series(
                [model.prior + sum(model.odds.get(t, 0.0) for t in of(h) + _path_tokens(p)) for h, p in zip(hosts, paths, strict=True)],
                dtype=float,
            )

        return odds(F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")))


def _memory(model: UrlModel):
    @lru_cache(maxsize=100_000)
    def words(host: str) -> list[str]:
        return [w for name in re.findall(r"[a-z]+", host) for w in model.segment(name)]

    return words


def _path_tokens(path: str) -> list[str]:
    return [f"/{w}" if w.isalpha() else f"/{'0' * min(len(w), 8)}" for w in re.findall(r"[a-z]+|[0-9]+", path.lower())]


def judge(urls: DataFrame, rules: list[Rule], url_col: str = "url", title: Column | None = None, **options) -> DataFrame:
    """The rows with host, path, rule and verdict (and score, the log-odds to block).

    A url that is null or has no ``://`` has an empty host and path; the model judges it by its
    prior. Columns of these names in the input are replaced.
    """
    shown = urls.withColumns({"host": url_host(urls[url_col]), "path": url_path(urls[url_col])})
    fitted = UrlModel.fit(shown.select("host", "path", F.coalesce(title if title is not None else F.lit(""), F.lit("")).alias("title")), **options)
    ruled = shown.withColumns({"_rule": matching_rule(F.col("host"), F.col("path"), rules), "score": fitted.score(F.col("host"), F.col("path"))})
    own = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", own)}).drop("_rule")
