"""Collocations from a weighted de Bruijn graph of word grams.

An edge is a gram of ``longest`` words (4), from the node of its first three words to that of its last three, and
its weight is how often it occurs. Each word of the corpus gives one record, the gram that starts there and ends after
``longest`` words or with its piece, whichever comes first. Shorter counts follow from these records alone: a node
occurs as often as its outgoing edges plus the records that end with it (the piece-end corrections), shorter grams
likewise from the next longer ones.

Nodes with one edge in, one out and no record ending there carry one flow, so runs of them are compacted to paths: a
passage that thousands of documents share is one row. Candidates are read off the paths, the nodes between them and the flows.

Records are cut short where two neighbouring words are not a frequent pair, as no frequent gram holds such a pair. That
counts as one more kind of end and changes no count of a frequent gram. The frequent pairs are a bit set of bounded size, and pairs that
share a bit with a frequent one are only kept longer than needed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickbars.llm.common import HEAVY_SHARE, join_to_unique, scratch

LONGEST = 4
LEAST = 30
#: A candidate goes if a longer one that holds it has at least so many hundredths of its count.
ABSORBED = 80
TOP = 2000
NO_LANGUAGE = "und"

#: Bytes of a text as the grams see them: A-Z in lower case, a line feed between pieces, spaces between words.
_SEEN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Size of the set of frequent pairs: bits per pair, and the least and greatest size as powers of two.
_BITS_PER_PAIR = 16
_BITS = (16, 28)
#: Entries that a task's dictionaries hold before they are handed on or forgotten.
_HELD = 300_000
#: Pairs that a task gathers before it counts them.
_GATHERED = 1 << 20
#: Words of a text that are looked at together, and bytes of a long piece.
_TOGETHER = (1 << 16, 1 << 20)


class _Hashes(dict):
    """XXH64 of each word asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _stretches(text: str, overlap: int, together: tuple[int, int]) -> Iterator[tuple[list[bytes], list[int], int]]:
    """Words of a text in stretches of bounded size: the words, the positions where pieces end, and how many words from
    the first on begin their grams here. A stretch that ends inside a piece shares its last ``overlap`` words with the next."""
    words, ends, (most, most_bytes) = [], [], together
    for piece in text.encode().translate(_SEEN).split(b"\n"):
        at = 0
        while len(piece) - at > most_bytes and (stop := piece.find(b" ", at + most_bytes)) >= 0:
            words += piece[at:stop].split()
            at = stop
            if len(words) > overlap:
                n = len(words) - overlap
                yield words, ends, n
                words, ends = words[n:], [e - n for e in ends if e > n]
        words += piece[at:].split() if at else piece.split()
        if words and (not ends or ends[-1] < len(words)):
            ends.append(len(words))
        if len(words) >= most:
            yield words, ends, len(words)
            words, ends = [], []
    if words:
        yield words, ends, len(words)


def _pairs(words: list[bytes], ends: list[int], hashes: _Hashes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word with the next, and whether both stand in one piece."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] << np.uint64(31) | h[1:] >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += np.uint64(seed)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    together = np.ones(len(mixed), bool)
    last = np.array(ends, np.int64) - 1
    together[last[last < len(mixed)]] = False
    return mixed, together


def _first(gram: Column, n: Column | int) -> Column:
    return F.call_function("substring_index", gram, F.lit(" "), n if isinstance(n, Column) else F.lit(n))


def _last(gram: Column, n: Column | int) -> Column:
    return _first(gram, -n)


def _rest(gram: Column) -> Column:
    """All words but the first."""
    return F.substring(gram, F.instr(gram, " ") + 1, F.char_length(gram))


@dataclass
class Graph:
    """``records``: lang, gram, words, c; ``flows``: per number of words below the longest lang, gram, c (all grams, the
    frequent ones exact); ``paths``: lang, phrase, c, words (compacted edges); ``least``, ``longest``."""

    records: DataFrame
    flows: dict[int, DataFrame]
    paths: DataFrame
    longest: int
    least: int

    @classmethod
    def build(cls, docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> Graph:
        """The graph of all texts, per language. Other columns do not matter. Repeated rows count each time, texts without
        words give nothing, a null language is ``und``. No table gives an empty graph."""
        if longest < 2 or least < 1:
            raise ValueError("a gram needs two words, and counts begin at 1")
        texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("t"))
        texts = texts.filter("t != ''")
        records = scratch(_records(texts, _frequent_pairs(texts, least), longest), "records")
        edge = (F.col("words") == longest) & (F.col("c") >= least)
        out = (
            records.filter(F.col("words") >= longest - 1)
            .groupBy("lang", _first(F.col("gram"), longest - 1).alias("gram"))
            .agg(
                F.sum("c").alias("c"),
                F.count_if(edge).alias("n_out"),
                F.max(F.when(edge, F.col("gram"))).alias("next"),
                F.max(F.when(edge, F.col("c"))).alias("c_out"),
            )
        )
        nodes = scratch(out, "nodes")
        flows = {longest - 1: nodes.select("lang", "gram", "c")}
        for n in range(longest - 2, 0, -1):
            ended = records.filter(F.col("words") == n).select("lang", "gram", "c")
            longer = flows[n + 1].select("lang", _first(F.col("gram"), n).alias("gram"), "c")
            flows[n] = scratch(longer.unionByName(ended).groupBy("lang", "gram").agg(F.sum("c").alias("c")), "flows")
        paths = scratch(_compacted(records.filter(edge).select("lang", "gram", "c"), nodes), "paths")
        return cls(records, flows, paths, longest, least)

    def words(self) -> DataFrame:
        """Occurrences of words per language: lang, n."""
        return self.flows[1].groupBy("lang").agg(F.sum("c").alias("n"))

    def frequent(self) -> DataFrame:
        """All grams of up to ``longest`` words that occur at least ``least`` times: lang, gram, words, c."""
        words = F.split("phrase", " ")

        def windows(n: int, begin: int, end: Column) -> DataFrame:
            starts = F.when(end >= begin, F.sequence(F.lit(begin), end)).otherwise(F.array().cast("array<int>"))
            split = self.paths.select("lang", "c", F.inline(F.array(F.struct(words.alias("w"), starts.alias("s")))))
            grams = F.transform("s", lambda i: F.array_join(F.slice("w", i, n), " "))
            return split.select("lang", F.explode(grams).alias("gram"), F.lit(n).alias("words"), "c")

        size, n = F.size(words), self.longest
        edges = windows(n, 1, size - (n - 1))
        within = windows(n - 1, 2, size - (n - 1))  # nodes inside a path have its flow
        junctions = self.flows[n - 1].filter(F.col("c") >= self.least).join(within, ["lang", "gram"], "left_anti")
        found = edges.unionByName(within).unionByName(junctions.select("lang", "gram", F.lit(n - 1).alias("words"), "c"))
        for k in range(1, n - 1):
            flow = self.flows[k].filter(F.col("c") >= self.least)
            found = found.unionByName(flow.select("lang", "gram", F.lit(k).alias("words"), "c"))
        return found


def _frequent_pairs(texts: DataFrame, least: int) -> tuple[int, bytes]:
    """A set of bits by the hash of language and word pair, which holds every pair that occurs ``least`` times:
    its size as a power of two, and the bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seeds, gathered, n = _Hashes(), _Hashes(), [], 0

        def counted() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *gathered]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times, pa.int64())], ["h", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for words, ends, _ in _stretches(text.as_py(), 1, _TOGETHER):
                    mixed, together = _pairs(words, ends, hashes, seeds[lang.as_py().encode()])
                    gathered.append(mixed[together])
                    n += len(gathered[-1])
                    if n > _GATHERED:
                        yield counted()
                        gathered, n = [], 0
                    if len(hashes) > _HELD:
                        hashes.clear()
        yield counted()

    found = texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    frequent = scratch(found.filter(F.col("n") >= least).select("h"), "pairs")
    size = min(max((frequent.count() * _BITS_PER_PAIR).bit_length(), _BITS[0]), _BITS[1])
    slots = frequent.select(F.col("h").bitwiseAND((1 << size) - 1).alias("slot"))
    held = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bits, rows = np.zeros(1 << size - 6, np.uint64), held.toPandas()
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return size, bits.tobytes()


def _records(texts: DataFrame, pairs: tuple[int, bytes], longest: int) -> DataFrame:
    """One record per word, counted: lang, gram, words, c."""
    size, bits = pairs
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mask = np.frombuffer(shared.value, np.uint8), np.uint64((1 << size) - 1)
        hashes, seeds, held = _Hashes(), _Hashes(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = held.setdefault(lang, Counter())
                for words, ends, n in _stretches(text.as_py(), longest - 1, _TOGETHER):
                    mixed, together = _pairs(words, ends, hashes, seeds[lang.encode()])
                    slot = mixed & mask
                    goes_on = together & (known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    goes_on, length = np.append(goes_on, False), np.ones(len(words), np.int64)
                    further = goes_on
                    for _ in range(longest - 1):
                        length += further
                        further = goes_on & np.append(further[1:], False)
                    length = length[:n]
                    counts.update(compress(words, (length == 1).tolist()))
                    at = np.flatnonzero(length > 1)
                    counts.update(b" ".join(words[i:j]) for i, j in zip(at.tolist(), (at + length[at]).tolist()))
                    if sum(map(len, held.values())) > _HELD:
                        yield _counted(held)
                        held = {}
                        counts = held.setdefault(lang, Counter())
                    if len(hashes) > _HELD:
                        hashes.clear()
        yield _counted(held)

    grams = texts.mapInArrow(count, "lang string, gram string, c bigint")
    words = F.char_length("gram") - F.char_length(F.replace("gram", F.lit(" "), F.lit(""))) + 1
    return grams.groupBy("lang", "gram").agg(F.sum("c").alias("c")).select("lang", "gram", words.alias("words"), "c")


def _counted(held: dict[str, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, counts in held.items() for _ in counts]
    grams = [gram for counts in held.values() for gram in counts]
    numbers = [c for counts in held.values() for c in counts.values()]
    columns = [pa.array(langs, pa.string()), pa.array(grams, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "c"])


def _compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges joined to paths through the nodes that have one edge in, one edge out, and all their flow in both.

    Each edge doubles its step towards the head of its path in every round, so the rounds are the logarithm of the
    longest path, which is no longer than the longest piece of a text.
    """
    into = edges.groupBy("lang", _rest(F.col("gram")).alias("gram")).agg(
        F.count(F.lit(1)).alias("n_in"), F.max("gram").alias("before"), F.max("c").alias("c_in")
    )
    through = nodes.filter("n_out = 1 AND c = c_out").join(into, ["lang", "gram"]).filter("n_in = 1 AND c_in = c")
    steps = through.select("lang", F.col("next").alias("gram"), F.col("before").alias("up"))
    marked = scratch(edges.join(steps, ["lang", "gram"], "left"), "steps")
    heads = marked.filter("up IS NULL").select("lang", "gram", "c", F.col("gram").alias("head"), F.lit(0).cast("bigint").alias("at"))
    state = marked.filter("up IS NOT NULL").select("lang", "gram", "c", "up", F.lit(1).cast("bigint").alias("at"))
    done = heads
    while not state.isEmpty():
        # above an edge stands a head, an edge whose head was found before, or one still on its way
        above = done.select("lang", F.col("gram").alias("up"), F.col("head"), F.lit(None).cast("string").alias("further"), F.col("at").alias("more"))
        moving = state.select("lang", F.col("gram").alias("up"), F.lit(None).cast("string").alias("head"), F.col("up").alias("further"), F.col("at").alias("more"))
        moved = scratch(state.join(above.unionByName(moving), ["lang", "up"]), "steps")
        done = done.unionByName(moved.filter("head IS NOT NULL").select("lang", "gram", "c", "head", (F.col("at") + F.col("more")).alias("at")))
        state = moved.filter("head IS NULL").select("lang", "gram", "c", F.col("further").alias("up"), (F.col("at") + F.col("more")).alias("at"))
    last = _last(F.col("gram"), 1)
    path = done.groupBy("lang", "head").agg(F.max("c").alias("c"), F.sort_array(F.collect_list(F.struct("at", last.alias("word")))).alias("ends"))
    tail = F.transform(F.filter("ends", lambda e: e["at"] > 0), lambda e: e["word"])
    return path.select("lang", F.array_join(F.concat(F.array("head"), tail), " ").alias("phrase"), "c")


def _parts(grams: DataFrame) -> DataFrame:
    """Both parts of every cut of each gram of two words or more: lang, phrase, a, k, left, part."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = grams.select("lang", F.col("gram").alias("phrase"), F.col("c").alias("a"), "words", cut)
    left = _first(F.col("phrase"), F.col("k"))
    right = _last(F.col("phrase"), F.col("words") - F.col("k"))
    sides = F.inline(F.array(F.struct(F.lit(True).alias("left"), left.alias("gram")), F.struct(F.lit(False).alias("left"), right.alias("gram"))))
    return cuts.select("lang", "phrase", "a", "k", sides)


def collocations(graph: Graph, *, absorbed: int = ABSORBED, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to ``longest`` words is as good as its worst cut: floor(2000000 a / (l + r)), where a counts the phrase and l
    and r its parts. Of cuts that tie, the one after fewer words counts. Phrases go that stand in a longer
    candidate of ``absorbed`` hundredths of their count or more. (One more word is enough to look at: a gram between the two
    occurs at least as often as the longer one.) Ties in rank go by a, then by phrase in byte order.
    """
    frequent = scratch(graph.frequent(), "frequent")
    candidates = frequent.filter("words > 1")
    around = F.explode(F.array(_first(F.col("gram"), F.col("words") - 1), _rest(F.col("gram")))).alias("gram")
    longer = candidates.filter("words > 2").select("lang", "c", around).groupBy("lang", "gram").agg(F.max("c").alias("longest_c"))
    absorbing = F.expr(f"CAST(longest_c AS DECIMAL(38, 0)) * 100 >= CAST(c AS DECIMAL(38, 0)) * {absorbed}")
    kept = candidates.join(longer, ["lang", "gram"], "left").filter(F.col("longest_c").isNull() | ~absorbing)

    parts = scratch(_parts(kept), "parts")
    known = frequent.filter(F.col("words") < graph.longest).select("lang", "gram", F.col("c").alias("f"))
    often = parts.groupBy("lang", "gram").count().filter(F.col("count") * HEAVY_SHARE >= parts.count()).filter("count > 1")
    met = join_to_unique(parts, known, ["lang", "gram"], known.join(often.select("lang", "gram"), ["lang", "gram"], "left_semi"))
    cuts = met.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("k", "left", "f")).alias("cuts"))

    def side(k: Column, left: bool) -> Column:
        return F.filter("cuts", lambda x: (x["k"] == k) & (x["left"] == F.lit(left)))[0]["f"]

    each = F.transform(
        F.array_distinct(F.transform("cuts", lambda x: x["k"])), lambda k: F.struct(k.alias("k"), side(k, True).alias("l"), side(k, False).alias("r"))
    )
    split = cuts.select("lang", "phrase", "a", F.explode(each).alias("cut")).select("lang", "phrase", "a", "cut.*")
    scored = split.withColumn("score", F.expr("CAST(a AS DECIMAL(38, 0)) * 2000000 div (l + r)"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = worst.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))
    return best.join(graph.words(), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
