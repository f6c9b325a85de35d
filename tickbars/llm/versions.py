"""Document fingerprints that tell what differs: invertible Bloom lookup sketches of paragraphs.

A paragraph is known by its 64-bit digest. A sketch has CELLS cells in three
tables; a digest is added to one cell of each, which hold a count, and the exclusive or of digests
and of their checks. Sketches of two versions are subtracted cell by cell: shared paragraphs
vanish. A cell with a single digest left, which its check proves, gives it away; taking it
out of its other cells may leave further single ones, and so on. If cells remain
full, the sketches were too small: both are built again with more parts, a part being a sketch of
its own for the digests of a range of hashes, and only the parts that fail grow further.
DataFrame functions only; sums over the digests of a document stay within a task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickbars.llm.common import scratch
from tickbars.session import shared_dir

#: Cells of a sketch: TABLES tables of WIDTH cells, a power of 2.
TABLES = 3
WIDTH = 4
CELLS = TABLES * WIDTH

#: Differing digests a part is meant for, growth of a part that fails, rounds of peeling.
LOAD = 3
GROWTH = 64
ROUNDS = 10

_BITS = WIDTH.bit_length() - 1

#: A paragraph ends after a line end, or after a sentence whose last word has six letters: texts
#: without line ends have paragraphs too, and where one ends depends on what stands there alone.
#: The ending is looked for before the word, as most places fail at that.
_PARAGRAPH = r"(?<=[.!?\n])(?<=\n|\p{L}{6}[.!?])"

#: The finer rule: a paragraph ends after every line end and every sentence end, of other scripts too.
SENTENCE = r"(?<=[.!?\n\u2026\u3002\uFF0E\uFF01\uFF1F\uFF61\u061F\u06D4\u0964\u0965])"


def paragraph_digests(text: Column, ends: str = _PARAGRAPH) -> Column:
    """The distinct 64-bit digests of a text's paragraphs, which end where the pattern ``ends`` matches."""
    parts = F.filter(F.split(text, ends), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _hits(check: Column, cell: Column | int) -> Column:
    """Whether a digest with this check has a place in the cell: its table's bits of the check name it."""
    if isinstance(cell, int):
        return F.shiftright(check, cell // WIDTH * _BITS).bitwiseAND(F.lit(WIDTH - 1)) == cell % WIDTH
    bits = F.call_function("shiftright", check, F.shiftright(cell, _BITS) * _BITS)
    return bits.bitwiseAND(F.lit(WIDTH - 1)) == cell.bitwiseAND(F.lit(WIDTH - 1))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), k.alias("k"), c.alias("c"))


def _added(a: Column, b: Column, sign: int = 1) -> Column:
    return _cell(a["n"] + b["n"] * sign, a["k"].bitwiseXOR(b["k"]), a["c"].bitwiseXOR(b["c"]))


def sketch(digests: Column) -> Column:
    """The sketch of a version, in one part, from its array of digests: an array of cells n, k and c."""
    entries = F.transform(digests, lambda d: _cell(F.lit(1), d, _check(d)))
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    # the outer array of one holds the entries, so that they are made once
    built = F.transform(
        F.array(entries),
        lambda e: F.transform(
            F.sequence(F.lit(0), F.lit(CELLS - 1)),
            lambda i: F.aggregate(e, zero, lambda cell, d: F.when(_hits(d["c"], i), _added(cell, d)).otherwise(cell)),
        ),
    )
    return built[0]


def sketches(digests: DataFrame, *keys: str) -> DataFrame:
    """Cells for each key, from rows of the keys, digest and sign: 1 in the first version, -1 in the second.

    Sums being linear, this is the difference of the sketches of both versions.
    """
    checked = digests.withColumn("check", _check(F.col("digest")))
    cells = []
    for i in range(CELLS):
        hit = _hits(F.col("check"), i)
        cells += [
            F.sum(F.when(hit, F.col("sign")).otherwise(0)).alias(f"n{i}"),
            F.bit_xor(F.when(hit, F.col("digest")).otherwise(0)).alias(f"k{i}"),
            F.bit_xor(F.when(hit, F.col("check")).otherwise(0)).alias(f"c{i}"),
        ]
    summed = checked.groupBy(*keys).agg(*cells)
    return summed.select(*keys, F.array(*[_cell(F.col(f"n{i}"), F.col(f"k{i}"), F.col(f"c{i}")) for i in range(CELLS)]).alias("cells"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _added(x, y, -1))


def is_empty(cells: Column) -> Column:
    return ~F.exists(cells, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))


def peel(cells: Column) -> Column:
    """Digests that a difference of sketches gives away, a struct of cells (what is left) and got (k, n, c).

    n is 1 for digests of the first version only, -1 for those of the second. All is recovered
    if the cells left are empty.
    """
    empty = F.array().cast("array<struct<n:bigint,k:bigint,c:bigint>>")
    start = F.struct(cells.alias("cells"), empty.alias("got"), F.lit(True).alias("going"))

    def pure(state: Column, n: int) -> Column:
        single = F.filter(state["cells"], lambda x: (x["n"] == n) & (x["c"] == _check(x["k"])))
        return F.transform(F.array_distinct(F.transform(single, lambda x: x["k"])), lambda k: _cell(F.lit(n), k, _check(k)))

    def without(state: Column, found: Column) -> Column:
        left = F.transform(
            state["cells"],
            lambda x, i: F.aggregate(found, x, lambda cell, f: F.when(_hits(f["c"], i), _added(cell, f, -1)).otherwise(cell)),
        )
        stuck = F.struct(state["cells"].alias("cells"), state["got"].alias("got"), F.lit(False).alias("going"))
        moved = F.struct(left.alias("cells"), F.concat(state["got"], found).alias("got"), F.lit(True).alias("going"))
        return F.when(F.size(found) == 0, stuck).otherwise(moved)

    def turn(state: Column, _: Column) -> Column:
        found = F.concat(pure(state, 1), pure(state, -1))
        return F.when(~state["going"], state).otherwise(F.transform(F.array(found), lambda f: without(state, f))[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s.dropFields("going"))


def peeled_count(cells: Column) -> Column:
    """What peeling recovers of a difference of sketches, a struct of d (digests) and ok (whether that is all).

    Where each cell of a table is empty or holds a single digest, that table gives all of them away in one look; only
    other sketches are peeled.
    """

    def single(x: Column) -> Column:
        none = (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)
        return none | (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))

    def told(d: Column, ok: Column) -> Column:
        return F.struct(d.cast("int").alias("d"), ok.alias("ok"))

    peeled = F.transform(F.array(peel(cells)), lambda p: told(F.size(p["got"]), is_empty(p["cells"])))[0]
    for table in reversed(range(TABLES)):
        own = [F.get(cells, F.lit(table * WIDTH + i)) for i in range(WIDTH)]
        looks = reduce(lambda a, b: a & b, [single(x) for x in own])
        found = reduce(lambda a, b: a + b, [F.abs(x["n"]) for x in own])
        peeled = F.when(looks, told(found, F.lit(True))).otherwise(peeled)
    return peeled


def fingerprint_text(cells: Column) -> Column:
    """A sketch as text: for each cell count, digests and checks in hexadecimal."""
    word = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.array_join(F.transform(cells, lambda x: F.concat(F.lpad(F.hex(x["n"]), 4, "0"), word(x["k"]), word(x["c"]))), ""))


def by_row(df: DataFrame) -> DataFrame:
    """``df`` stored in buckets of its ``row``, so that sums over the digests of a row need no further shuffle."""
    spark = df.sparkSession
    name, n = f"paragraphs_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/tables/{name}"
    dealt = df.repartition(n, "row").write.format("parquet").option("compression", "zstd").option("path", path)
    dealt.bucketBy(n, "row").saveAsTable(name)
    return spark.table(name)


def larger_sketches(stored: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Numbers of differing digests of pairs whose first sketches failed: row, pair, d.

    ``stored`` has a unique row and arrays of distinct digests; a pair names two of these, and a
    column that is true where it failed. Sketches get as many parts as the digests of both sides
    ask for at LOAD, and from there on parts that fail are split by GROWTH, until none is left.
    """
    both = lambda a, b: F.concat(
        F.transform(a, lambda d: F.struct(d.alias("digest"), F.lit(1).alias("sign"))),
        F.transform(b, lambda d: F.struct(d.alias("digest"), F.lit(-1).alias("sign"))),
    )
    sides = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(failed).alias("failed"))
        for i, (a, b, failed) in enumerate(pairs)
    ])
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(2.0), (F.size("a") + F.size("b")) / LOAD)))).cast("long")
    place = F.shiftright(_check(F.col("digest")), CELLS * _BITS)
    sought = stored.select("row", F.inline(F.filter(sides, lambda x: x["failed"])))
    sought = sought.select("row", "pair", parts.alias("parts"), F.explode(both("a", "b")).alias("d"))
    level, found = sought.select("row", "pair", "parts", "d.*"), []
    while True:
        rows = level.withColumn("part", place.bitwiseAND(F.col("parts") - 1))
        cells = sketches(rows, "row", "pair", "parts", "part").filter(~is_empty(F.col("cells")))
        done = scratch(cells.withColumn("p", peeled_count(F.col("cells"))).select("row", "pair", "parts", "part", "p.d", "p.ok"), "peeled")
        found.append(done.filter("ok").select("row", "pair", "d"))
        failed = done.filter("not ok").select("row", "pair", "parts", F.col("part").alias("of"))
        if failed.isEmpty():
            break
        # the low bits of a place name the part that failed, the next ones its parts
        again = failed.join(stored.select("row", sides.alias("sides")).hint("merge"), "row")
        again = again.withColumn("side", F.element_at("sides", F.col("pair") + 1)).select("row", "pair", "parts", "of", "side.a", "side.b")
        again = again.select("row", "pair", "parts", "of", F.explode(both("a", "b")).alias("d")).select("row", "pair", "parts", "of", "d.*")
        level = again.filter(place.bitwiseAND(F.col("parts") - 1) == F.col("of")).withColumn("parts", F.col("parts") * GROWTH).drop("of")
    return reduce(DataFrame.unionByName, found).groupBy("row", "pair").agg(F.sum("d").alias("d"))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared of all distinct digests, from the numbers of both sides and of those that differ; 1 if there are none."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - differing) / (a + b + differing))


def with_next_text(docs: DataFrame, id_col: str, text_col: str, chunks: int | None = None) -> DataFrame:
    """Documents as id, text and next, the text of the document with the next lower id.

    Null ids come last, equal ones by a hash of the text; the last one's next is the first. The
    order is cut into chunks at quantiles of the ids, and the first row of each is copied to
    the chunk before, so texts are shuffled once. The driver holds the border of each chunk.
    """
    spark = docs.sparkSession
    chunks = chunks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    shares = [i / chunks for i in range(1, chunks)]
    bounds = sorted(set(rows.agg(F.percentile_approx("id", shares, 10 * chunks)).first()[0] or []))
    steps = [1 << i for i in reversed(range(max(1, len(bounds)).bit_length()))]
    limits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(None).cast("long"))
    chunk = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(limits, at + step) <= F.col("id")), at + step).otherwise(at),
    )
    rows = rows.withColumn("chunk", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(chunk))
    tops = rows.groupBy("chunk").agg(F.max(F.struct("id", "tie")).alias("top")).orderBy(F.desc("chunk")).collect()
    ghosts = [(r["top"]["id"], r["top"]["tie"], tops[i - 1]["chunk"]) for i, r in enumerate(tops)]
    known = spark.createDataFrame(ghosts, "gid long, gtie long, target int")
    also = rows.join(F.broadcast(known), F.col("id").eqNullSafe(F.col("gid")) & (F.col("tie") == F.col("gtie")))
    dealt = rows.withColumn("ghost", F.lit(False)).unionByName(
        also.select("id", "text", "tie", F.col("target").alias("chunk"), F.lit(True).alias("ghost"))
    )
    order = Window.partitionBy("chunk").orderBy("ghost", F.desc_nulls_last("id"), F.desc("tie"))
    return dealt.withColumn("next", F.lead("text").over(order)).filter("not ghost").select("id", "text", "next")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: str = _PARAGRAPH) -> DataFrame:
    """Fingerprints of texts and of edited texts, and how like they and the next text's are.

    The edited text has its last third (rounded down, in code points) replaced by the first as many
    code points of the next document. Per document: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts are empty; a document alone is
    its own next; no documents give no rows.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third))
    texts = with_next_text(docs, id_col, text_col).withColumn("edited", edited)
    digests = texts.select(
        "id",
        n.cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("edited_sha256"),
        paragraph_digests(F.col("text"), ends).alias("own"),
        paragraph_digests(F.col("edited"), ends).alias("changed"),
        paragraph_digests(F.col("next"), ends).alias("following"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = digests.withColumns({f"s_{c}": sketch(F.col(c)) for c in ("own", "changed", "following")})
    first = first.withColumns({f"p_{c}": peel(subtract(F.col("s_own"), F.col(f"s_{c}"))) for c in ("changed", "following")})
    # an edited text begins as the text does: only what stands behind the paragraphs they share is stored
    parted = F.array_position(F.zip_with("own", "changed", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(parted == 0, F.size("own")).otherwise(parted - 1).cast("int")
    rest = lambda digests: F.slice(digests, F.col("shared") + 1, F.size(digests))
    first = first.withColumn("shared", shared)
    stored = by_row(first.select(
        "id", "n_chars", "edited_sha256", "own", rest("changed").alias("changed"), "shared", "following", "row",
        F.unhex(fingerprint_text(F.col("s_own"))).alias("fingerprint"),
        F.unhex(fingerprint_text(F.col("s_changed"))).alias("edited_fingerprint"),
        *[F.size(f"p_{c}.got").alias(f"d_{c}") for c in ("changed", "following")],
        *[(~is_empty(F.col(f"p_{c}.cells"))).alias(f"failed_{c}") for c in ("changed", "following")],
    ))
    sides = stored.withColumn("own_rest", rest("own"))
    larger = larger_sketches(sides, [("own_rest", "changed", "failed_changed"), ("own", "following", "failed_following")])
    side = lambda i: F.max(F.when(F.col("pair") == i, F.col("d"))).alias(f"larger_{i}")
    out = stored.join(larger.groupBy("row").agg(side(0), side(1)), "row", "left")

    def near(i: int, other: str, size: Column) -> Column:
        differing = F.when(F.col(f"failed_{other}"), F.col(f"larger_{i}")).otherwise(F.col(f"d_{other}"))
        return likeness(F.size("own"), size, differing)

    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(
        "id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"),
        near(0, "changed", F.col("shared") + F.size("changed")).alias("near_edited"),
        near(1, "following", F.size("following")).alias("near_next"),
    )
