import random

import pytest
from pyspark.sql import functions as F

from tickbars.operators.running import numbered, previous, running


def rows(n=300, seed=3):
    rnd = random.Random(seed)
    order = rnd.sample(range(5 * n), n)
    return [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), s, rnd.randrange(1000)) for s in order]


@pytest.mark.parametrize("chunk", [3, 50, 10**6])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, chunk, inclusive):
    data = rows()
    df = spark.createDataFrame(data, "k string, s bigint, v bigint")
    got = running(
        df, ["k"], "s", {"mx": ("max", "v"), "mn": ("min", "v"), "sm": ("sum", "v")}, inclusive=inclusive, chunk_rows=chunk
    )
    for r in got.collect():
        before = [v for k, s, v in data if k == r.k and (s < r.s or (inclusive and s == r.s))]
        assert (r.mx, r.mn, r.sm) == (max(before, default=None), min(before, default=None), sum(before))
    assert got.count() == len(data)


@pytest.mark.parametrize("chunk", [3, 10**6])
def test_previous_with_null_values(spark, chunk):
    data = [(k, s, None if v % 5 == 0 else v) for k, s, v in rows()]
    df = spark.createDataFrame(data, "k string, s bigint, v bigint")
    by_key = {}
    for k, s, v in sorted(data, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((s, v))
    want = {(k, s): (None if i == 0 else vs[i - 1][1]) for k, vs in by_key.items() for i, (s, _) in enumerate(vs)}
    got = {(r.k, r.s): r.p for r in previous(df, ["k"], "s", "v", "p", chunk_rows=chunk).collect()}
    assert got == want


@pytest.mark.parametrize("desc", [False, True])
def test_numbered(spark, desc):
    data = rows()
    df = spark.createDataFrame(data, "k string, s bigint, v bigint")
    got = numbered(df, ["s"], F.floor(F.col("s") / 40), "n", descending=desc).collect()
    assert [r.s for r in sorted(got, key=lambda r: r.n)] == sorted((s for _, s, _ in data), reverse=desc)
    assert sorted(r.n for r in got) == list(range(1, len(data) + 1))
