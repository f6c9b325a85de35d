"""Collocations against counts of every gram, on awkward texts and on none."""

import collections
import random
import re

import pytest

from cases import SCHEMA, documents, texts
from tickbars.llm import collocations, queries

WORDS = "the of and new york city times square garden".split()


def corpus(n=400):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = texts()
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))
        text = text.replace("new", "New York", 1) + rng.choice(["", ".", " ; ", "\n\n", " . . ,"]) + rng.choice(["", passage, " " + passage + "\t\tthe end"])
        rows.append((1000 + i, text, "s"))
    rows.append((5000, "loop " * 3000, "s"))
    return rows


def frame(spark, rows):
    langs = ["en", None, "fr"]
    full = [(i, t, langs[n % 3] if n % 7 else "en", s, None if t is None else len(t), 7, "k", "d", 0.5, "n", 3, "s") for n, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3), [(t or "", r[2] or "und") for (_, t, _), r in zip(rows, full)]


def counted(pairs, longest):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in pairs:
        low = text.encode().lower().decode()
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][" ".join(words[i : i + n])] += 1
    return counts


def best(counts, longest, least, absorbed=80, top=2000):
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if " " not in g)
        candidates = {g: c for g, c in f.items() if " " in g and c >= least}
        gone = set()
        for g, c in candidates.items():
            w = g.split(" ")
            for a in range(len(w)):
                for b in range(a + 2, len(w) + 1):
                    inner = " ".join(w[a:b])
                    if b - a < len(w) and 100 * c >= absorbed * f[inner]:
                        gone.add(inner)
        rows = []
        for g, a in candidates.items():
            if g in gone:
                continue
            w = g.split(" ")
            cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])], k) for k in range(1, len(w))]
            score, _, l, r = min((2000000 * a // (l + r), k, l, r) for l, r, k in cuts)
            rows.append((-score, -a, g.encode(), l, r))
        for rank, (score, a, g, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize("longest, least", [(4, 30), (4, 3), (3, 10), (2, 5)])
def test_as_counted_by_hand(spark, longest, least):
    docs, pairs = frame(spark, corpus())
    graph = collocations.Graph.build(docs, longest=longest, least=least)
    counts = counted(pairs, longest)
    found = {(r.lang, r.gram): (r.words, r.c) for r in graph.frequent().collect()}
    assert found == {(lang, g): (g.count(" ") + 1, c) for lang, f in counts.items() for g, c in f.items() if c >= least}
    assert sorted(map(tuple, collocations.collocations(graph, top=50).collect())) == best(counts, longest, least, top=50)


def test_paths_hold_each_edge_once(spark):
    docs, pairs = frame(spark, corpus())
    graph = collocations.Graph.build(docs)
    counts = counted(pairs, 4)
    edges = collections.Counter()
    for r in graph.paths.collect():
        w = r.phrase.split(" ")
        assert len(w) >= 4
        for i in range(len(w) - 3):
            edges[r.lang, " ".join(w[i : i + 4])] += 1
            assert counts[r.lang][" ".join(w[i : i + 4])] == r.c
    assert edges == {(lang, g): 1 for lang, f in counts.items() for g, c in f.items() if g.count(" ") == 3 and c >= 30}
    longest = max((r.phrase for r in graph.paths.collect()), key=len)
    assert " ".join(f"p{i}" for i in range(1, 39)) in longest


def test_a_full_set_of_pairs_and_short_stretches_change_nothing(spark, monkeypatch):
    docs, pairs = frame(spark, corpus(200))
    monkeypatch.setattr(collocations, "_BITS", (6, 6))
    monkeypatch.setattr(collocations, "_HELD", 50)
    monkeypatch.setattr(collocations, "_GATHERED", 50)
    monkeypatch.setattr(collocations, "_TOGETHER", (7, 9))
    graph = collocations.Graph.build(docs, least=5)
    assert sorted(map(tuple, collocations.collocations(graph).collect())) == best(counted(pairs, 4), 4, 5)


def test_large_counts_are_exact(spark):
    a = 4_000_000_000_000_000_000
    grams = [("en", "x y", 2, a), ("en", "x", 1, a), ("en", "y", 1, a), ("en", "x z", 2, a - 1), ("en", "z", 1, a)]
    flows = spark.createDataFrame([r[:2] + (r[3],) for r in grams if r[2] == 1], "lang string, gram string, c bigint")
    graph = collocations.Graph(None, {1: flows.limit(1)}, None, 2, 30)
    graph.frequent = lambda: spark.createDataFrame(grams, "lang string, gram string, words int, c bigint")
    found = {r.phrase: r.score for r in collocations.collocations(graph).collect()}
    assert found == {"x y": 1_000_000, "x z": 2_000_000 * (a - 1) // (2 * a)}


def test_nothing(spark):
    for docs in (spark.createDataFrame([], SCHEMA), documents(spark, [(1, None, "a"), (2, "", "a"), (3, " . ,\n", None)])):
        graph = collocations.Graph.build(docs)
        assert collocations.collocations(graph).count() == 0 and graph.paths.count() == 0


def test_query(spark, tmp_path):
    docs, _ = frame(spark, corpus())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_collocations(spark, str(tmp_path))
    assert found.dtypes == [
        ("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint"),
    ]
    assert found.count() > 0
