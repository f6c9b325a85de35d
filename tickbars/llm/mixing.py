"""Mixing sources to target weights by a splitting tree over exact block quotas.

A source is cut into blocks of whole documents, dealt by hash. Its target says how many words
the mix takes: some full passes over its blocks and a part of one more, in a permuted order. The
number of block draws is the source's quota. A tree of multivariate-hypergeometric draws splits
the quotas exactly among the output shards, so that each shard is what a shuffle of all draws
would have given it. A shard then owns a range of each source's draws, disjoint from all others,
and its rows are put in random order within the shard alone.

Everything random is a hash of the seed, so reruns agree. Prefix sums run over blocks, and over
spans of blocks before that; no task holds a source. A task of the tree holds one number for
each source and shard below it, up to FAN shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickbars.llm.common import n_words, scratch, text_keys

SEED = 20_240_501
BLOCK_WORDS = 4096
SPAN = 1024
SHARD_WORDS = 2_000_000
FAN = 256
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0

#: A prime above any number of blocks, so that it shares no factor with it.
_STEP = 2_147_483_629

#: numpy draws exact hypergeometric numbers below this population.
_EXACT = 1_000_000_000


def source_key(source: Column) -> Column:
    """A key that is never null; its order is the code point order of the sources, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Targets of sources (skey, source_size): shares by weight, none above ``most`` times its size.

    Weights repeat along the sources in the order of their keys. What a full source leaves over
    goes to the rest by weight, until none is above. Each round is one aggregate over the
    sources, of which two sums come back. A source of size 0 gets 0.
    """
    at = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = _numbered(sizes).select("skey", "source_size", at.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("most"))
    ranked = scratch(ranked, "sources")
    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        taken, free = ranked.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        higher = (wanted - taken) / free if free else level
        if higher <= level:
            break
        level = higher
    return ranked.select("skey", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """Number sources from 0 in the order of their keys: ranges first, then within each range."""
    ranges = scratch(sizes.repartitionByRange("skey").withColumn("_part", F.spark_partition_id()), "source-ranges")
    before = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = before.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("skey"))
    return ranges.join(before, "_part").withColumn("n", rank - 1 + F.col("_before")).drop("_part", "_before")


def plan_mix(rows: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, **weighting) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of rows (skey, size, key and others).

    ``key`` is a hash that tells rows apart; rows that share it also share their block. The
    first result has each row with source_size, target, blocks, place (of its block in the
    permuted order), passes (times it is taken whole) and part (words taken once more, size if
    all). The second has skey and quota, the number of draws of the source.
    """
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, **weighting)
    targets = targets.withColumns({
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"),
        "_want": F.round("target").cast("long"),
    })
    targets = targets.withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("_want") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("_rest", F.col("_want") - F.col("passes") * F.col("source_size"))
    targets = scratch(targets, "targets")

    block = F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks"))
    shift = F.pmod(F.xxhash64(F.lit(seed), "skey"), F.col("blocks"))
    place = F.pmod(F.pmod(F.lit(_STEP), F.col("blocks")) * block + shift, F.col("blocks"))
    placed = scratch(rows.join(targets, "skey").withColumn("place", place), "placed")

    words = placed.groupBy("skey", "place", "_rest").agg(F.sum("size").alias("_words"))
    words = words.withColumn("_span", F.floor(F.col("place") / SPAN))
    spans = words.groupBy("skey", "_span").agg(F.sum("_words").alias("_words"))
    ahead = F.sum("_words").over(Window.partitionBy("skey").orderBy("_span")) - F.col("_words")
    inner = F.sum("_words").over(Window.partitionBy("skey", "_span").orderBy("place")) - F.col("_words")
    blocks = words.join(spans.select("skey", "_span", ahead.alias("_ahead")), ["skey", "_span"]).select(
        "skey", "place", "_rest", "_words", (F.col("_ahead") + inner).alias("_before")
    )
    blocks = scratch(blocks.filter(F.col("_before") < F.col("_rest")), "blocks")

    left = F.col("_left")
    cut = blocks.withColumn("_left", F.col("_rest") - F.col("_before"))
    drawn = placed.drop("_rest", "_want").join(cut.select("skey", "place", "_left", "_words"), ["skey", "place"], "left")
    whole = left.isNull() | (left >= F.col("_words"))
    in_order = Window.partitionBy("skey", "place").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(in_order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - ahead)).cast("long")
    taken = drawn.filter(whole).withColumn(
        "part", F.when(left.isNull(), F.lit(0)).otherwise(F.col("size")).cast("long")
    ).unionByName(drawn.filter(~whole).withColumn("part", part))

    last = blocks.groupBy("skey").agg((F.max("place") + 1).alias("_last"))
    quota = targets.join(last, "skey", "left").select(
        "skey", (F.col("passes") * F.col("blocks") + F.coalesce("_last", F.lit(0))).alias("quota")
    )
    return taken.drop("_left", "_words"), quota


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Split each source's quota (skey, quota) among shards: skey, shard, lo, hi.

    Every node of the tree halves its shards and draws what the left half gets of each source.
    FAN shards are reached in one round; each round below works on all its nodes at once.
    """
    nodes = quotas.filter("quota > 0").withColumns({"lo": F.lit(0), "hi": F.lit(shards)})

    def below(key: tuple, node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("skey")
        parts = _halved(node["quota"].to_numpy(np.int64), int(key[0]), int(key[1]), seed, FAN)
        return pd.concat([pd.DataFrame({"skey": node["skey"], "quota": q, "lo": lo, "hi": hi}) for lo, hi, q in parts])

    reach = 1
    while True:
        nodes = nodes.groupBy("lo", "hi").applyInPandas(below, "skey string, quota long, lo int, hi int")
        reach *= FAN
        if reach >= shards:
            break
    upto = F.sum("quota").over(Window.partitionBy("skey").orderBy("lo"))
    return nodes.filter("quota > 0").select("skey", F.col("lo").alias("shard"), (upto - F.col("quota")).alias("lo"), upto.alias("hi"))


def _halved(quota: np.ndarray, lo: int, hi: int, seed: int, fan: int) -> list[tuple[int, int, np.ndarray]]:
    if hi - lo == 1 or fan == 1:
        return [(lo, hi, quota)]
    mid, total = (lo + hi) // 2, int(quota.sum())
    rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
    left, rest, want = np.zeros_like(quota), total, total * (mid - lo) // (hi - lo)
    for i, q in enumerate(quota.tolist()):
        rest -= q
        left[i] = _hypergeometric(rng, q, rest, want)
        want -= int(left[i])
    return _halved(left, lo, mid, seed, fan // 2) + _halved(quota - left, mid, hi, seed, fan // 2)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn. Above the population numpy allows, the normal with its mean and variance."""
    if not good or not n:
        return 0
    if not bad:
        return n
    if good + bad < _EXACT:
        return int(rng.hypergeometric(good, bad, n))
    share = good / (good + bad)
    spread = (n * share * (1 - share) * (good + bad - n) / (good + bad - 1)) ** 0.5
    return int(min(good, n, max(0, n - bad, round(rng.normal(n * share, spread)))))


def mix(
    rows: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, **weighting
) -> tuple[DataFrame, DataFrame]:
    """Mix rows (row, skey, size, key); ``row`` must be unique.

    The first result is the rows with their source_size and target. The second is the mix: a
    row for each time that some of a row is taken, with words (all, or so many from its start),
    draw, shard and order, the random place within the shard. Words add up to the rounded
    target of each source, and a row is taken twice at most (``most`` of the weighting). Rows
    without words are never taken; null sources are a source of their own. No rows give no mix.
    """
    taken, quota = plan_mix(rows, seed, block_words, **weighting)
    taken, quota = scratch(taken, "taken"), scratch(quota, "quotas")
    words = quota.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-words * block_words // shard_words))
    ranges = split_quotas(quota, shards, seed).join(quota, "skey")

    page = F.greatest(F.lit(1), F.floor(F.col("quota") / shards))
    pages = ranges.withColumn("_page", F.explode(F.sequence(F.floor(F.col("lo") / page), F.floor((F.col("hi") - 1) / page))))
    pages = pages.select("skey", "_page", "shard", "lo", "hi")
    passes = F.transform(
        F.sequence(F.lit(0), F.col("passes").cast("int")),
        lambda p: F.struct(
            (p * F.col("blocks") + F.col("place")).alias("draw"),
            F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"),
        ),
    )
    draws = taken.select("row", "skey", "key", F.explode(F.filter(passes, lambda d: d["words"] > 0)).alias("d"))
    draws = draws.select("row", "skey", "key", "d.*").join(quota, "skey").withColumn("_page", F.floor(F.col("draw") / page))
    drawn = draws.join(pages, ["skey", "_page"]).filter("lo <= draw and draw < hi")
    order = F.xxhash64(F.lit(seed), "shard", "draw", "key")
    return taken, drawn.select("row", "skey", "words", "draw", "shard", order.alias("order"))


def numbered_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that ``mix`` takes, stored, each with a number of its own, and what tells their texts apart."""
    keys = text_keys(docs[id_col], docs[text_col])
    return scratch(
        docs.select(
            docs[id_col].cast("long").alias("id"),
            source_key(docs[source_col]).alias("skey"),
            n_words(docs[text_col]).alias("size"),
            F.xxhash64(docs[id_col], docs[text_col]).alias("key"),
            F.monotonically_increasing_id().alias("row"),
            *[k.alias(name) for name, k in keys.items()],
        ),
        "mix-rows",
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str | None = "n_chars", **options
) -> DataFrame:
    """The mix as documents with the columns of ``docs``, and shard: a row for each time one is taken.

    Rows come in shards, each shuffled within itself. A text of which only a part is taken, one
    document of a source at most, is cut behind its last word taken, and ``n_chars_col`` follows.
    Rows that repeat in id, text and source stand for each other.
    """
    names = docs.columns
    keys = text_keys(docs[id_col], docs[text_col]) | {"skey": source_key(docs[source_col])}
    rows = numbered_rows(docs, id_col, text_col, source_col)
    _, drawn = mix(rows, **options)
    drawn = scratch(drawn.drop("skey").join(rows.select("row", "size", *keys), "row"), "draws")
    pieces = F.regexp_extract_all(F.col("d")[text_col], F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    whole = F.col("words") == F.col("size")
    text = F.when(whole, F.col("d")[text_col]).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""))
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("d"), *[k.alias(name) for name, k in keys.items()])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("key_id"))
    one = packed.withColumn("nth", first).filter("nth = 1")
    taken = one.join(drawn.hint("merge"), list(keys)).select("d", "words", "size", "shard", "order", text.alias("text"))
    out = taken.repartition("shard").sortWithinPartitions("shard", "order")

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("text").alias(name)
        if name == n_chars_col:
            return F.when(whole, F.col("d")[name]).otherwise(F.char_length("text")).alias(name)
        return F.col("d")[name].alias(name)

    return out.select(*[column(c) for c in names], F.col("shard"))
