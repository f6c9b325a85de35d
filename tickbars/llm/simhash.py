"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that vary together are put into the same partition of the fingerprint, as they say little
about each other's neighbours. Two fingerprints within t bits agree within T[i] bits on some
partition i, whenever the thresholds T[i] add up to t - m + 1 over m partitions; -1 leaves a
partition out. The thresholds are dealt by dynamic programming so that the estimated number of
candidates is least: how often values near a given one occur, from counts over all fingerprints.
All values are indexed by partition, each fingerprint probes the values within its thresholds,
and candidates are verified on all bits. Equal fingerprints are one before any of this, so that
copies are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickbars.llm.common import HEAVY_SHARE, join_to_unique, one_of_each, scratch, text_keys
from tickbars.llm.components import components

BITS = 64
NEAR = 3
SHINGLE = 3
SEED = 42

#: Partitions that the planner may choose among.
PARTITIONS = (2, 3)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a text as a long: A-Z lower-cased, words between ASCII white space, word shingles.

    A bit is 1 if it is set in more than half of the shingles' XXH64 (seed 42), repeats included.
    Fewer words than a shingle are one shingle; no words, and null, give 0.
    """

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([_simhash(t, shingle) for t in texts], dtype="int64")

    return fingerprints(F.coalesce(text, F.lit("")))


def _simhash(text: str, shingle: int) -> int:
    import xxhash

    # bytes.lower and bytes.split know ASCII only, which is what is asked for
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, take = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - take + 1].tolist(), ends[take - 1 :].tolist(), strict=True)
    digest, ones, total, held = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []
    for start, end in spans:
        held.append(digest(joined[start:end], SEED))
        if len(held) == 1 << 16:
            ones, total, held = ones + _ones(held), total + len(held), []
    ones, total = ones + _ones(held), total + len(held)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def _ones(hashes: list[int]) -> np.ndarray:
    bits = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)


class Plan:
    """Partitions of the bits and their thresholds."""

    def __init__(self, groups: list[list[int]], thresholds: list[int]):
        self.groups, self.thresholds = groups, thresholds

    def values(self, fp: Column) -> Column:
        """The value of each partition, an array: its bits of a fingerprint, a long or an array of them, packed."""
        groups = self.groups

        @F.pandas_udf("array<long>")
        def packed(fps: pd.Series) -> pd.Series:
            if not len(fps):
                return pd.Series([], dtype=object)
            words = np.stack([np.atleast_1d(x) for x in fps]).astype(np.int64)
            out = np.zeros((len(fps), len(groups)), np.int64)
            for g, bits in enumerate(groups):
                for at, bit in enumerate(bits):
                    out[:, g] |= (words[:, bit // BITS] >> (bit % BITS) & 1) << at
            return pd.Series(list(out), dtype=object)

        return packed(fp)

    def probes(self, values: str) -> Column:
        """Structs of g, v and own for each value within the thresholds of its partition; own if it is the value itself."""

        def around(g: int) -> Column:
            flips = F.array(*[F.lit(flip).cast("long") for flip in self.flips(g)])
            value = F.element_at(values, g + 1)
            return F.transform(flips, lambda x: F.struct(F.lit(g).alias("g"), value.bitwiseXOR(x).alias("v"), (x == 0).alias("own")))

        near = [around(g) for g, radius in enumerate(self.thresholds) if radius >= 0]
        return F.flatten(F.array(*near))

    def flips(self, group: int) -> list[int]:
        """What to xor a value with, to have all values within the partition's threshold."""
        width, radius = len(self.groups[group]), self.thresholds[group]
        return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def bit_likeness(fps: DataFrame, bits: int = BITS) -> np.ndarray:
    """Absolute correlation of the bits over all fingerprints (fp): one aggregate, of a sum per pair of bits."""
    joint = np.zeros((bits, bits))
    counts = fps.select("fp").mapInPandas(_joint_bits(bits), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    whole = counts["i"] < 0
    n, pairs = int(counts["n"][whole].sum()), counts[~whole]
    joint[pairs["i"], pairs["j"]] = joint[pairs["j"], pairs["i"]] = pairs["n"]
    share = joint.diagonal() / max(n, 1)
    cov = joint / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
    return np.abs(cov / np.outer(spread, spread))


def correlated_groups(like: np.ndarray, m: int) -> list[list[int]]:
    """Partition the bits: a group starts with the two most alike and takes the bit most like its own."""
    sizes = [len(like) // m + (i < len(like) % m) for i in range(m)]
    free, groups = set(range(len(like))), []
    for size in sizes:
        rest = sorted(free)
        if size == len(rest):
            groups.append(rest)
            break
        within = like[np.ix_(rest, rest)].copy()
        np.fill_diagonal(within, -1)
        a, b = np.unravel_index(within.argmax(), within.shape)
        group = [rest[a], rest[b]]
        while len(group) < size:
            open_bits = [x for x in rest if x not in group]
            group.append(max(open_bits, key=lambda x: (like[x, group].mean(), -x)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def _joint_bits(bits: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joint, n = np.zeros((bits, bits)), 0
        for batch in batches:
            if not len(batch):
                continue
            words = batch["fp"].to_numpy(np.int64) if bits == BITS else np.stack(batch["fp"].to_list()).astype(np.int64)
            for part in np.array_split(words.reshape(len(batch), -1), len(batch) // 4096 + 1):
                ones = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little").astype(np.float64)
                joint += ones.T @ ones
            n += len(batch)
        i, j = np.triu_indices(bits)
        yield pd.DataFrame({"i": [-1, *i], "j": [-1, *j], "n": [n, *joint[i, j].astype(np.int64)]})

    return count


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) that add up to ``total`` at the least cost, by dynamic programming.

    ``costs[i][k]`` is what threshold k - 1 costs in partition i.
    """
    best = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                s, c = spent + k - 1, cost + more
                if s not in after or c < after[s][0]:
                    after[s] = (c, [*chosen, k - 1])
        best = after
    return best[total]


def make_plan(fps: DataFrame, near: int = NEAR, partitions: tuple[int, ...] = PARTITIONS, bits: int = BITS) -> Plan:
    """Choose the partitions and thresholds from the distinct fingerprints (fp).

    A threshold costs its probes and the candidates they meet: the sum of squared counts of a
    partition's values, over all fingerprints, says how many rows share a value; the balls around
    add the share that values of that many bits would meet by chance.
    """
    n, found, like = fps.count(), [], bit_likeness(fps, bits)
    for m in partitions:
        groups = correlated_groups(like, m)
        free = Plan(groups, [0] * m)
        values = fps.select(F.posexplode(free.values(F.col("fp"))).alias("g", "v"))
        held = values.groupBy("g", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
        met = {r["g"]: r["met"] for r in held.groupBy("g").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("met")).collect()}
        costs = []
        for g, own in enumerate(groups):
            balls = [sum(math.comb(len(own), i) for i in range(k)) for k in range(min(near, 2) + 2)]
            costs.append([n * b + (met.get(g, 0.0) + (b - 1) * n * n / 2.0 ** len(own)) if b else 0.0 for b in balls])
        cost, thresholds = allot(costs, near - m + 1)
        found.append((cost, Plan(groups, thresholds)))
    return min(found, key=lambda x: x[0])[1]


def near_links(fps: DataFrame, plan: Plan, near: int = NEAR) -> DataFrame:
    """All pairs a < b of distinct fingerprints (fp, a long) within ``near`` bits."""
    values = fps.select("fp", plan.values(F.col("fp")).alias("vals"))
    asked = scratch(values.select(F.col("fp").alias("a"), F.inline(plan.probes("vals"))), "probes")
    held = asked.filter("own").select(F.col("a").alias("b"), "g", "v")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= near
    met = asked.select("a", "g", "v").join(held, ["g", "v"]).filter((F.col("a") != F.col("b")) & close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(rows: DataFrame, near: int = NEAR, partitions: tuple[int, ...] = PARTITIONS) -> DataFrame:
    """Component of each fingerprint (rows of fp and id): fp, component, the least id within reach, and n, its rows.

    Null ids are left out when the least is taken; a component with null ids only has null.
    """
    fps = scratch(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    plan = make_plan(fps, near, partitions)
    links = scratch(near_links(fps, plan, near), "near-links")
    roots = components(links)
    linked = roots.join(fps.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    reached = roots.join(least, "root").select(F.col("node").alias("fp"), "component")
    return fps.join(reached, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, shingle: int = SHINGLE) -> DataFrame:
    """Per document: id, fp and component, the least id that links of at most ``near`` bits reach.

    Null and empty texts have fingerprint 0 and are linked like any other. No documents give no rows.
    """
    rows = scratch(docs.select(docs[id_col].cast("long").alias("id"), fingerprint(docs[text_col], shingle).alias("fp")), "simhash")
    groups = scratch(near_groups(rows, near), "near-groups")
    heavy = groups.filter(F.col("n") * HEAVY_SHARE >= rows.count()).filter("n > 1")
    return join_to_unique(rows, groups, "fp", heavy).select("id", "fp", "component")


#: Near copies: words of a shingle, and the Jaccard similarity from which two texts are near copies.
WIDE_SHINGLE = 5
ALIKE = 0.8

#: Bits of the shingles' SimHash that are compared, and of these that a candidate may differ in: at
#: similarity 0.8 about 39 are expected, with a deviation of 6.
SHINGLE_BITS = 256
WIDE_DIFFER = 88

#: Bits that a candidate may differ in of the first 64, which go along with each key: 10 are expected, with a deviation of 3.
WORD_DIFFER = 22

#: Candidates agree on a part of the SimHash. Bits of texts of similarity j differ with a chance of
#: acos(2 * j / (1 + j)) / pi; there are as many parts as it takes for texts at ALIKE to agree on none with a
#: chance of MISS. A part has SPARE more bits than number the texts, NARROW at least.
MISS = 0.001
WIDTH = 20
NARROW = 16
SPARE = 2

#: Fewer shingles than this have no near copy but an equal one. One shingle more may leave as many, and then a sixth of the
#: bits and more differ: such texts share a key of LEAST shingles as well.
LEAST = math.ceil(ALIKE / (1 - ALIKE) - 1e-9)

#: What the bits of a SimHash mix a digest with, an odd factor for each word.
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 512), np.uint64) | np.array([[0], [1]], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Members of a bucket that are paired at once, and of one that is compared in blocks.
FEW = 8
BLOCK = 1024

#: What the SimHash leaves apart meets by its rarest shingles. A shingle that is among those of COMMON texts is common and
#: comes last in the order; tasks are told of LISTED at most, found in so many ROUNDS. The order decides what is compared only.
COMMON = 16
LISTED = 1 << 17
ROUNDS = 2

#: Members of a bucket of a shingle that are joined with each other; larger ones are compared in blocks.
PAIRED = 16

#: Texts that are sought by a broadcast of their keys; more are joined by shuffle.
SOUGHT = 20_000

#: The least share of the shingles of two near copies, counted for each, that they have in common.
SHARED = ALIKE / (1 + ALIKE)


def parts_of(width: int) -> int:
    """Parts of so many bits that it takes to find texts of similarity ALIKE."""
    agree = (1 - math.acos(2 * ALIKE / (1 + ALIKE)) / math.pi) ** width
    return math.ceil(math.log(MISS) / math.log1p(-agree))


def width_for(n: int) -> int:
    """Bits of a part where there are n texts, so that unlike ones seldom agree on it."""
    return max(NARROW, max(1, n - 1).bit_length() + SPARE)


def wide_fingerprints(text: Column, width: int = WIDTH) -> Column:
    """Of a text's distinct five-word shingles: n, a digest of them all, their SimHash and the keys of its parts."""
    wide = wide_simhash(text, width)
    keys = part_keys(wide["n"], wide["shingles"], wide["few"], width)
    return F.struct(wide["n"].alias("n"), wide["digest"].alias("digest"), wide["shingles"].alias("shingles"), keys.alias("bands"))


def wide_simhash(text: Column, width: int = WIDTH) -> Column:
    """Of a text's distinct five-word shingles: n, a digest of them all, their SimHash and, of few shingles, the keys."""
    words = max(SHINGLE_BITS, parts_of(width) * width) // BITS + 1

    @F.pandas_udf("n int, digest binary, shingles array<long>, few array<long>")
    def fingerprints(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_wide(t, words) for t in texts], columns=["n", "digest", "shingles", "few"])

    return fingerprints(F.coalesce(text, F.lit("")))


def _wide(text: str, words: int) -> tuple[int, bytes, np.ndarray, list[int]]:
    from xxhash import xxh3_128_digest as digest

    hashes = _shingle_hashes(_shingles(text))
    return len(hashes), digest(hashes.tobytes()), _wide_bits(hashes, words), _few_keys(hashes)


def part_keys(n: Column, bits: Column, few: Column, width: int = WIDTH) -> Column:
    """A key for each part of a SimHash, from the highest bits of which the part's number can be told; and the keys of few shingles.

    Texts that have no near copy but equal ones have none.
    """
    parts = parts_of(width)

    @F.pandas_udf("array<long>")
    def keys(ns: pd.Series, sketches: pd.Series) -> pd.Series:
        place, out = np.int64(1) << np.arange(width, dtype=np.int64), []
        for n, words in zip(ns, sketches, strict=True):
            if n < LEAST:
                out.append(np.zeros(0, np.int64))
                continue
            held = np.unpackbits(np.ascontiguousarray(words, np.int64).view(np.uint8), bitorder="little")
            values = held[: parts * width].reshape(parts, width) @ place
            out.append(np.arange(parts, dtype=np.int64) << 48 | values)
        return pd.Series(out, dtype=object)

    return F.concat(keys(n, bits), few)


def _few_keys(hashes: np.ndarray) -> list[int]:
    """Keys of all LEAST of a few hashes, negative ones, so that they are none of a part."""
    from xxhash import xxh3_64_intdigest as digest

    if not LEAST <= len(hashes) <= LEAST + 1:
        return []
    return [(digest(np.array(c, np.uint64).tobytes()) >> 1) - (1 << 63) for c in combinations(hashes.tolist(), LEAST)]


def _shingles(text: str) -> set[bytes]:
    words = text.encode().lower().split()
    take = min(WIDE_SHINGLE, len(words))
    return {b" ".join(words[i : i + take]) for i in range(len(words) - take + 1)} if take else set()


def _shingle_hashes(shingles: set[bytes]) -> np.ndarray:
    """The distinct hashes of shingles, sorted."""
    from xxhash import xxh3_64_intdigest as digest

    return np.unique(np.fromiter(map(digest, shingles), np.uint64, len(shingles)))


def _wide_bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of distinct hashes, sorted. Where as many have a bit as have not, the least of them decides."""
    seeds, factors = _MIX[:, :words]
    ones, first = np.zeros(words * BITS, np.int64), np.zeros(words * BITS, np.uint8)
    # sums of up to 255 bits fit a byte
    for at in range(0, len(hashes), 128):
        mixed = (hashes[at : at + 128, None] ^ seeds) * factors
        mixed ^= mixed >> np.uint64(32)
        mixed *= _SPREAD
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint8)
        if not at:
            first = bits[0]
    return np.packbits(ones * 2 + first > len(hashes), bitorder="little").view(np.int64)


def shingle_hashes(text: Column) -> Column:
    """The distinct hashes of a text's five-word shingles, an array."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_hashes(_shingles(t)).view(np.int64) for t in texts], dtype=object)

    return hashes(F.coalesce(text, F.lit("")))


def block_cells(rooted: DataFrame) -> DataFrame:
    """Members (v, node, root and more) of the buckets with several roots, dealt to cells (v, i, j) where any two of different roots meet.

    Most members of a large bucket are connected already, so only the others, the strays, meet all members.
    Members with the bucket's most frequent root are met by blocks of strays and never by each other: their
    rows grow with the members, and with their square only by strays that fill several blocks.
    """
    bucket = Window.partitionBy("v")
    counted = rooted.repartition("v").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("v", "root")))
    counted = counted.withColumns({"_n": F.count(F.lit(1)).over(bucket), "_most": F.max(F.struct("_same", "root")).over(bucket)})
    counted = counted.filter(F.col("_n") > F.col("_most._same"))
    one = F.col("_n") <= BLOCK
    strays = F.when(one, 1).otherwise(F.ceil((F.col("_n") - F.col("_most._same")) / BLOCK)).cast("int")
    mains = F.when(one, 0).otherwise(F.ceil(F.col("_most._same") / BLOCK)).cast("int")
    dealt = counted.withColumns({"_strays": strays, "_mains": mains, "_main": ~one & (F.col("root") == F.col("_most.root"))})
    at = lambda blocks: F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1))).cast("int")
    mine = F.when(F.col("_main"), F.col("_strays") + at(F.col("_mains"))).otherwise(at(F.col("_strays")))
    met = F.when(F.col("_main"), F.col("_strays")).otherwise(F.col("_strays") + F.col("_mains"))
    dealt = dealt.withColumns({"_mine": mine, "_other": F.explode(F.sequence(F.lit(0), met - 1))})
    return dealt.select(*rooted.columns, F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"))


def _sketches(members: pd.DataFrame) -> np.ndarray:
    # bits are counted of unsigned numbers: of others, numpy takes the absolute value
    return np.stack(members["sketch"].to_list()).astype(np.int64).view(np.uint64)


def _block_candidates(members: pd.DataFrame) -> pd.DataFrame:
    """Members of a cell with a candidate among those of another root."""
    sketches, roots, found = _sketches(members), members["root"].to_numpy(), np.zeros(len(members), bool)
    for at in range(0, len(members), 256):
        differ = np.bitwise_count(sketches[at : at + 256, None] ^ sketches).sum(2, dtype=np.int64)
        found[at : at + 256] = ((differ <= WIDE_DIFFER) & (roots[at : at + 256, None] != roots)).any(1)
    return members.loc[found, ["v", "i", "j", "node", "root", "sketch"]]


def _block_links(members: pd.DataFrame) -> pd.DataFrame:
    """Links within a cell, as many as it takes to connect what they connect.

    Members with the same root are connected already.
    """
    members = members.drop_duplicates("node").sort_values("node")
    nodes, tops = members["node"].to_numpy(), members["root"].to_numpy().copy()
    sketches = _sketches(members)
    hashes = [np.asarray(h, np.int64) for h in members["hashes"]]
    links = []
    for i in range(len(nodes) - 1):
        differ = np.bitwise_count(sketches[i + 1 :] ^ sketches[i]).sum(1, dtype=np.int64)
        for j in (np.flatnonzero((differ <= WIDE_DIFFER) & (tops[i + 1 :] != tops[i])) + i + 1).tolist():
            if tops[i] == tops[j]:
                continue
            shared = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
            if shared / (len(hashes[i]) + len(hashes[j]) - shared) >= ALIKE:
                links.append((int(nodes[i]), int(nodes[j])))
                tops[tops == tops[j]] = tops[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _sketch() -> Column:
    """The bits of the SimHash that are compared."""
    return F.slice("shingles", 1, SHINGLE_BITS // BITS)


def _with_b(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs a, b, each once, with what is known of b (a row for each b), which meets all pairs of a member at once.

    A b has few pairs: the members before it in a small bucket for each of its keys, and one star. An a may have very many.
    """
    lists = pairs.groupBy("b").agg(F.collect_set("a").alias("a"))
    return lists.join(known, "b").withColumn("a", F.explode("a"))


def _near_by_simhash(bits: Column, n: Column) -> Column:
    """Whether that many bits of the SimHash may differ, of texts that have n shingles together."""
    return bits <= WIDE_DIFFER


def _near_by_parities(bits, n):
    """Whether that many parities may differ: for each, one of the texts has a shingle at least that the other has not."""
    return bits <= n * (1 - 2 * SHARED) + 1e-6


def _close(pairs: DataFrame, sketched: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Those pairs a, b, each once, that may be alike by size and by the bits of their sketches (node, n, sketch).

    A sketch that is twice as long as the other is folded.
    """
    side = lambda name: sketched.select(F.col("node").alias(name), F.col("sketch").alias(f"s_{name}"), F.col("n").alias(f"n_{name}"))
    differ = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    folded = lambda x, n: F.when(F.size(x) > n, differ(F.slice(x, 1, n), F.slice(x, n + 1, n))).otherwise(F.col(x))
    least = F.least(F.size("s_a"), F.size("s_b"))
    bits = F.aggregate(differ(folded("s_a", least), folded("s_b", least)), F.lit(0), lambda s, x: s + F.bit_count(x))
    of_size = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * ALIKE
    met = _with_b(pairs, side("b")).join(side("a"), "a")
    return met.filter(of_size & near(bits, F.col("n_a") + F.col("n_b"))).select("a", "b")


def _alike(close: DataFrame, hashes: DataFrame) -> DataFrame:
    """Those pairs a, b whose Jaccard similarity is at least ALIKE."""
    whole = lambda name: hashes.select(F.col("node").alias(name), F.col("hashes").alias(f"h_{name}"))
    met = _with_b(close, whole("b").hint("merge")).join(whole("a").hint("merge"), "a")
    shared = F.size(F.array_intersect("h_a", "h_b"))
    return met.filter(shared / (F.size("h_a") + F.size("h_b") - shared) >= ALIKE).select("a", "b")


def wide_links(nodes: DataFrame, hashed: Callable[[DataFrame], DataFrame], rare: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links a, b that connect all near copies, from rows of node, n, shingles and few (wide SimHashes).

    ``hashed`` gives the shingle hashes (node, hashes) of some nodes, ``rare`` holds their rarest shingles (node, n,
    rare, parities). The SimHash finds nearly all links; those it misses are found by the rarest shingles.
    """
    found = scratch(simhash_links(nodes, hashed, width), "wide-links")
    return found.unionByName(missed_links(rare, hashed, components(found)))


def simhash_links(nodes: DataFrame, hashed: Callable[[DataFrame], DataFrame], width: int = WIDTH) -> DataFrame:
    """Links a, b that connect near copies whose SimHashes agree on a part.

    Candidates agree on a part of the SimHash and differ in at most WIDE_DIFFER of the bits compared; all are verified on the
    hashes. Buckets of a few members are paired. Members of larger ones meet the least member of one; those
    that this leaves apart are compared in blocks: by their bits first, and of those with candidates by
    their hashes, which returns no more links than connect the members of a cell.
    """
    keys = part_keys(F.col("n"), F.col("shingles"), F.col("few"), width)
    keyed = nodes.select("node", F.get("shingles", F.lit(0)).alias("word"), F.explode(keys).alias("v"))
    order = Window.partitionBy("v").orderBy("node")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("node", "word")
    sized = keyed.withColumns({
        "n": F.count(F.lit(1)).over(whole),
        "least": F.min(own).over(whole),
        "before": F.array(*[F.lag(own, k).over(order) for k in range(1, FEW)]),
    }).filter("n > 1")
    like = lambda x: F.bit_count(x["word"].bitwiseXOR(F.col("word"))) <= WORD_DIFFER
    met = F.transform(F.filter("before", lambda x: x.isNotNull() & like(x)), lambda x: x["node"])
    sized = scratch(sized.select(
        "v", "node", "n", F.col("least.node").alias("least"), like(F.col("least")).alias("star"), F.when(F.col("n") <= FEW, met).alias("before")
    ), "wide-buckets")
    pairs = sized.select(F.explode("before").alias("a"), F.col("node").alias("b"))
    many = sized.filter(F.col("n") > FEW).select("v", "node", "least", "star")
    # one star a member: what it leaves apart is compared in blocks
    stars = many.filter("star and least < node").groupBy("node").agg(F.min("least").alias("a")).select("a", F.col("node").alias("b"))
    # unlike texts that agree on a part by chance go by their bits, before anything is read of their texts
    sketched = nodes.select("node", "n", _sketch().alias("sketch"))
    close = scratch(_close(pairs.unionByName(stars), sketched, _near_by_simhash), "wide-pairs")
    met = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).unionByName(many.select("node")).distinct()
    hashes = scratch(hashed(met), "wide-hashes")
    paired = scratch(_alike(close, hashes), "wide-alike")

    # what is known of a member is joined once, not for each of its buckets or cells
    members = many.groupBy("node").agg(F.collect_list("v").alias("v")).join(components(paired), "node", "left")
    members = members.join(nodes.select("node", _sketch().alias("sketch")), "node")
    rooted = members.select(F.explode("v").alias("v"), "node", F.coalesce("root", "node").alias("root"), "sketch")
    kept = "v long, i int, j int, node long, root long, sketch array<long>"
    found = block_cells(rooted).groupBy("v", "i", "j").applyInPandas(_block_candidates, kept)
    found = scratch(found, "wide-cells").groupBy("node", "root", "sketch").agg(F.collect_list(F.struct("v", "i", "j")).alias("cells"))
    full = found.join(hashes.hint("merge"), "node").select("node", "root", "sketch", "hashes", F.inline("cells"))
    within = full.groupBy("v", "i", "j").applyInPandas(_block_links, "a long, b long")
    return paired.unionByName(within)


def _rarest(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of sorted distinct hashes the first in the order of all texts, of which near copies share one: common ones come last.

    A near copy has a share of ALIKE of the text's shingles at least. The first ones are as many as leave
    fewer than that, so those that are shared can't all lie behind them.
    """
    if len(hashes) < LEAST:
        return hashes[:0]
    first, (folds, levels) = len(hashes) - math.ceil(ALIKE * len(hashes) - 1e-9) + 1, common
    if not len(folds):
        return hashes[:first]
    own = _folded(hashes)
    at = np.minimum(np.searchsorted(folds, own), len(folds) - 1)
    return hashes[np.lexsort((hashes, np.where(folds[at] == own, levels[at], 0)))[:first]]


def _folded(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of hashes: shingles that share one meet as if they were the same, and are told apart later."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Bits of which each says whether a text has an odd number of the hashes that fall to it, at least one for each hash."""
    bits = max(BITS, 1 << max(0, 2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def rare_shingles(text: Column, common: Broadcast) -> Column:
    """Of a text's distinct five-word shingles: n, the rarest (rare, folded, in the order of all texts) and the parities."""

    @F.pandas_udf("n int, rare array<int>, parities array<long>")
    def told(texts: pd.Series) -> pd.DataFrame:
        hashes = [_shingle_hashes(_shingles(t)) for t in texts]
        rows = [(len(h), _folded(_rarest(h, common.value)).view(np.int32), _parities(h)) for h in hashes]
        return pd.DataFrame(rows, columns=["n", "rare", "parities"])

    return told(F.coalesce(text, F.lit("")))


def common_shingles(texts: DataFrame) -> Broadcast:
    """Shingles (folded, sorted) that are among the rarest of COMMON texts (text) or more, and their levels, for the tasks.

    Each round counts what the round before made one of a text's rarest, in place of what it found to be common.
    """
    sc = texts.sparkSession.sparkContext
    before, known = None, sc.broadcast((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    for _ in range(ROUNDS):
        met = texts.select(F.explode(_newly_rare(F.col("text"), before, known)).alias("s"))
        held = met.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
        held = scratch(held.select("s", F.floor(F.log2("n")).cast("int").alias("level")), "common-shingles")
        folds, levels = known.value
        room, least = LISTED - len(folds), None
        for r in sorted(held.groupBy("level").count().collect(), key=lambda r: -r["level"]):
            room -= r["count"]
            if room < 0:
                break
            least = r["level"]
        if least is None:
            break
        more = held.filter(F.col("level") >= least).toPandas()
        folds = np.concatenate([folds, more["s"].to_numpy(np.int32).view(np.uint32)])
        levels = np.concatenate([levels, more["level"].to_numpy(np.int64)])
        order = np.argsort(folds)
        before, known = known, sc.broadcast((folds[order], levels[order]))
    return known


def _newly_rare(text: Column, before: Broadcast | None, known: Broadcast) -> Column:
    """A text's rarest shingles, folded, by the common ones that are known, without those that were among them before."""

    @F.pandas_udf("array<int>")
    def shingles(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            hashes = _shingle_hashes(_shingles(text))
            rare = _rarest(hashes, known.value)
            if before is not None:
                rare = np.setdiff1d(rare, _rarest(hashes, before.value), assume_unique=True)
            folds = np.unique(_folded(rare))
            out.append(np.setdiff1d(folds, known.value[0], assume_unique=True).view(np.int32))
        return pd.Series(out, dtype=object)

    return shingles(F.coalesce(text, F.lit("")))


def _enough(a, b, least: Callable):
    """Whether two members of a bucket may be alike, of columns or arrays: what they share stands from its shingle on in both."""
    return (least(a["behind"], b["behind"]) >= (a["n"] + b["n"]) * SHARED - 1e-6) & (a["root"] != b["root"])


def _apart(sketches: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that differ between sketches i and j, of which the longer ones are folded."""
    sizes, out = np.array([len(s) for s in sketches]), np.zeros(len(i), np.int64)
    least = np.minimum(sizes[i], sizes[j])
    for size in np.unique(least).tolist():
        fit = np.flatnonzero(least == size)
        used = np.unique(np.concatenate([i[fit], j[fit]]))
        folded = np.stack([np.bitwise_xor.reduce(sketches[k].reshape(-1, size), axis=0) for k in used])
        for some in np.array_split(fit, len(fit) * size // (1 << 20) + 1):
            a, b = (folded[np.searchsorted(used, side[some])] for side in (i, j))
            out[some] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def _cell_kin(members: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of a cell that may be alike, as many as connect what they connect."""
    own = {c: members[c].to_numpy() for c in ("node", "root", "n", "behind")}
    sketches = [np.asarray(s, np.int64).view(np.uint64) for s in members["sketch"]]
    nodes, tops, found = own["node"], np.arange(len(members)), []
    for at in range(0, len(members), 256):
        some = {c: x[at : at + 256, None] for c, x in own.items()}
        i, j = np.nonzero(_enough(some, own, np.minimum) & (some["node"] < nodes))
        i += at
        near = _near_by_parities(_apart(sketches, i, j), own["n"][i] + own["n"][j])
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            if tops[a] != tops[b]:
                found.append((int(nodes[a]), int(nodes[b])))
                tops[tops == tops[b]] = tops[a]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _kin_links(members: pd.DataFrame) -> pd.DataFrame:
    """Links within a cell of kin, as many as connect what they connect, from the counts of shared hashes."""
    members = members.drop_duplicates("node")
    nodes, tops = members["node"].to_numpy(), members["root"].to_numpy().copy()
    n = members["hashes"].str.len().to_numpy()
    codes = np.unique(np.concatenate(members["hashes"].to_list()), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(n)), n)[np.argsort(codes, kind="stable")]
    held = np.bincount(codes)
    first, ends, found = np.cumsum(held) - held, np.cumsum(n), []
    for i in range(len(nodes)):
        own = codes[ends[i] - n[i] : ends[i]]
        each = held[own]
        shared = np.bincount(holders[np.repeat(first[own] - np.cumsum(each) + each, each) + np.arange(each.sum())], minlength=len(n))
        for j in np.flatnonzero((shared / (n[i] + n - shared) >= ALIKE) & (tops != tops[i])).tolist():
            if tops[i] != tops[j]:
                found.append((int(nodes[i]), int(nodes[j])))
                tops[tops == tops[j]] = tops[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def missed_links(rare: DataFrame, hashed: Callable[[DataFrame], DataFrame], roots: DataFrame) -> DataFrame:
    """Links a, b that connect all near copies of different roots (node, root; nodes that are absent are their own).

    Two texts of similarity ALIKE share one of their rarest shingles (``rare``: node, n, rare, parities), whatever the order.
    Of the first that they share there are enough behind it in both, or they are surely unlike; so they are
    where too many parities differ. All other pairs, joined in small buckets and met in blocks in large ones, make kin of
    their texts. Kin are compared by their hashes, which returns no more links than connect them.
    """
    rooted = rare.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = rooted.select("node", "root", "n", F.posexplode("rare").alias("at", "s"))
    bucket = Window.partitionBy("v")
    sized = placed.select(F.col("s").cast("long").alias("v"), "node", "root", "n", (F.col("n") - F.col("at")).alias("behind"))
    sized = sized.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket), "size": F.count(F.lit(1)).over(bucket)})
    sized = scratch(sized.filter("low < high").drop("low", "high"), "rare-buckets")
    sketched = rare.select("node", "n", F.col("parities").alias("sketch"))
    few = sized.filter(F.col("size") <= PAIRED).select("v", F.struct("node", "root", "n", "behind").alias("a"))
    met = few.hint("merge").join(few.withColumnRenamed("a", "b").hint("merge"), "v").filter("a.node < b.node").filter(_enough(F.col("a"), F.col("b"), F.least))
    pairs = scratch(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "rare-pairs")
    close = scratch(_close(pairs, sketched, _near_by_parities), "rare-close")

    many = sized.filter(F.col("size") > PAIRED).groupBy("node", "root").agg(F.collect_list(F.struct("v", "behind")).alias("at"))
    members = many.join(sketched, "node").select("node", "root", "n", "sketch", F.inline("at"))
    cells = block_cells(members).groupBy("v", "i", "j").applyInPandas(_cell_kin, "a long, b long")
    kin = scratch(components(close.unionByName(cells)).select("node", F.col("root").alias("v")), "rare-kin")
    hashes = scratch(hashed(kin.select("node")), "rare-hashes")
    whole = kin.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(hashes.hint("merge"), "node")
    return block_cells(whole).groupBy("v", "i", "j").applyInPandas(_kin_links, "a long, b long")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group of near copies, the one with the least id (null ids last).

    Near copies have five-word shingles (distinct, A-Z lower-cased) with a Jaccard similarity of
    at least ALIKE, counted on 64-bit hashes. Groups are what links reach. Texts without words are
    near copies of each other; rows that repeat are too.
    """
    width = width_for(docs.count())
    keys = text_keys(docs[id_col], docs[text_col])
    stored = docs.select(*[k.alias(name) for name, k in keys.items()], wide_simhash(docs[text_col], width).alias("w"))
    rows = scratch(stored.select(*keys, "w.*"), "wide-rows")
    least = F.min(F.struct("key_none", "key_id", "key_a", "key_b"))
    same = rows.groupBy("digest").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("n", "shingles", "few")])
    nodes = scratch(same.withColumn("node", F.monotonically_increasing_id()), "wide-fingerprints")

    def of_nodes(some: DataFrame, told: Column, name: str, how: str) -> DataFrame:
        own = docs.select(*[k.alias(key) for key, k in keys.items()], told.alias(name))
        met = own.join(some.select("node", "least.*").hint(how), list(keys))
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("node"))
        return met.withColumn("nth", first).filter("nth = 1").select("node", name)

    def hashed(some: DataFrame) -> DataFrame:
        sought = scratch(nodes.join(some, "node", "left_semi").select("node", "least"), "wide-sought")
        met = of_nodes(sought, docs[text_col], "text", "broadcast" if sought.count() <= SOUGHT else "merge")
        return met.select("node", shingle_hashes(F.col("text")).alias("hashes"))

    common = common_shingles(docs.select(docs[text_col].alias("text")))
    rare = scratch(of_nodes(nodes, rare_shingles(docs[text_col], common), "r", "merge").select("node", "r.*"), "rare-shingles")
    roots = scratch(components(wide_links(nodes, hashed, rare, width)), "wide-roots")
    linked = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    wanted = linked.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    return one_of_each(docs, keys, scratch(wanted, "wide-kept"))
