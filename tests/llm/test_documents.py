"""Operators on documents against brute force, on awkward rows and on none."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, documents, sentence, texts
from tickbars.llm import bpe, components, exactdedup, linededup, mixing, simhash, suffixdedup, toxicity, versions


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text) -> bytes:
    return (text or "").encode().lower()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup ----------------------------------------------------------------------------


def test_exact_dedup(spark, docs, none):
    rows = exactdedup.DigestIndex(spark, buckets=4).add(docs, "doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for i, t, _ in texts():
        groups[lower(t)].append(i)
    assert len(rows) == len(texts())
    for r in rows:
        group = next(g for t, g in groups.items() if sha(t) == bytes(r.digest).hex())
        assert r.group_size == len(group)
        assert r.keep_id == max((i for i in group if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    assert exactdedup.DigestIndex(spark, buckets=4).add(none, "doc_id", "text").count() == 0
    kept = exactdedup.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exactdedup.distinct_documents(none).count() == 0


def test_index_grows_by_what_is_new(spark):
    index = exactdedup.DigestIndex(spark, buckets=4)
    first = documents(spark, [(1, "a", "s"), (2, "A", "s"), (3, "b", "s")])
    second = documents(spark, [(9, "a", "s"), (4, "c", "s"), (5, "c", "s")])
    assert {(r.id, r.kept) for r in index.add(first, "doc_id", "text", "one").collect()} == {(1, False), (2, True), (3, True)}
    assert {(r.id, r.keep_id, r.kept) for r in index.add(second, "doc_id", "text", "two").collect()} == {(9, 2, False), (4, 5, False), (5, 5, True)}
    assert index.table().count() == 3
    assert {(r.id, r.kept) for r in index.add(second, "doc_id", "text", "two").collect()} == {(9, False), (4, False), (5, True)}
    again = exactdedup.DigestIndex(spark, path=index.path, buckets=4)
    assert again.table().count() == 3


def test_heavy_group(spark):
    rows = documents(spark, [(i, "same" if i % 3 else f"own {i}", "s") for i in range(300)])
    got = exactdedup.DigestIndex(spark, buckets=4).add(rows, "doc_id", "text").collect()
    assert sum(r.kept for r in got) == 101 and {r.keep_id for r in got if r.group_size > 1} == {299}


# --- mixing -----------------------------------------------------------------------------------


def waterfill(sizes, weights, share=1.5, most=2.0):
    total, full = share * sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        free = sum(weights[i] for i in range(len(sizes)) if i not in full)
        level = left / free if free else 0
        above = {i for i in range(len(sizes)) if i not in full and level * weights[i] >= most * sizes[i]}
        if not above:
            return [most * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= above


def sizes_by_source():
    sizes = collections.Counter()
    for _, t, s in texts():
        sizes[s] += len((t or "").encode().split())
    return sizes


@pytest.mark.parametrize("block, shard", [(8, 60), (4096, 10**7), (50, 7)])
def test_mixing(spark, docs, block, shard):
    taken, drawn = mixing.mix(mixing.numbered_rows(docs), block_words=block, shard_words=shard)
    sizes = sizes_by_source()
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(order, waterfill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    words = collections.Counter()
    for r in drawn.collect():
        words[r.row] += r.words
    by_source, rows = collections.Counter(), taken.collect()
    assert len(rows) == len(texts())
    for r in rows:
        source = None if r.skey == "1" else r.skey[1:]
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
        assert words[r.row] <= 2 * r.size
        by_source[source] += words[r.row]
    for s in order:
        assert by_source[s] == round(targets[s])


def test_mix_is_repeatable_and_in_disjoint_shards(spark, docs, none):
    runs = [mixing.mixed_documents(docs, block_words=8, shard_words=60) for _ in range(2)]
    seen = [sorted((str(r.doc_id), r.text, r.source or "", r.shard) for r in run.collect()) for run in runs]
    assert seen[0] == seen[1] and len({x[3] for x in seen[0]}) > 3
    got = collections.Counter()
    for _, text, source, _ in seen[0]:
        got[source] += len(text.encode().split())
    sizes = sizes_by_source()
    order = sorted((s for s in sizes if s is not None)) + [None]
    for s, t in zip(order, waterfill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])):
        assert got[s or ""] == round(t)
    assert runs[0].columns == [*docs.columns, "shard"]
    assert mixing.mixed_documents(none).count() == 0


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("0a", 1000), ("0b", 1), ("0c", 0), ("1", 333)], "skey string, quota long")
    rows = mixing.split_quotas(quotas, 300).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.skey].append((r.lo, r.hi, r.shard))
    assert {k: max(h for _, h, _ in v) for k, v in by.items()} == {"0a": 1000, "0b": 1, "1": 333}
    for v in by.values():
        v.sort()
        assert v[0][0] == 0 and all(a[1] == b[0] and a[2] < b[2] for a, b in zip(v, v[1:]))
    shards = collections.Counter()
    for r in rows:
        shards[r.shard] += r.hi - r.lo
    assert sum(shards.values()) == 1334 and set(shards.values()) <= {4, 5}


# --- suffix dedup -----------------------------------------------------------------------------


def covered(data: list[bytes], length: int) -> list[list[bool]]:
    starts = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("length, anchor, widths", [(400, 128, (64, 16, 4, 1)), (40, 8, (9, 2, 1)), (20, 20, (1,))])
def test_suffix_dedup(spark, docs, length, anchor, widths):
    got = suffixdedup.without_repeats(docs, threshold=length, anchor=anchor, widths=widths).collect()
    data = [bytes(r.data) for r in got]
    assert sorted(data) == sorted((t or "").encode() for _, t, _ in texts())
    for r, gone in zip(got, covered(data, length)):
        kept = bytes(b for b, g in zip(r.data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(gone), sum(gone), spans, sha(kept))
        assert suffixdedup.kept_bytes(bytes(r.data), [(s.start, s.end) for s in r.spans]) == kept


def test_suffix_dedup_of_random_strings(spark):
    rnd = random.Random(3)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 9))), "s") for i in range(60)]
    got = suffixdedup.without_repeats(documents(spark, rows), threshold=50, anchor=17, widths=(8, 3, 1)).collect()
    for r, gone in zip(got, covered([bytes(r.data) for r in got], 50)):
        assert r.n_removed == sum(gone)


def test_planted_passages(spark):
    """Passages of over 50 words and 400 bytes go wherever they stand; what is shorter than 400 bytes stays, by the contract."""
    long, short = [sentence(700 + k, 60) for k in range(3)], [" ".join("ab cd ef".split() * 17 + [f"k{k}"]) for k in range(2)]
    assert all(len(x) >= 400 for x in long) and all(len(x.split()) > 50 and len(x) < 200 for x in short)
    rows = [(i, f"{sentence(i, 9)} [{long[i % 3]}] {sentence(i + 40, 9)} ({short[i % 2]})", "s") for i in range(12)]
    rows += [(100 + i, sentence(900 + i, 80), "clean") for i in range(12)]
    got = {r.d.doc_id: r for r in suffixdedup.without_repeats(documents(spark, rows)).collect()}
    starts = collections.Counter(t[k : k + 400] for _, t, _ in rows for k in range(len(t) - 399))
    for i, text, source in rows:
        gone = {k + j for k in range(len(text) - 399) if starts[text[k : k + 400]] > 1 for j in range(400)}
        assert (got[i].n_removed, got[i].n_spans) == (len(gone), source == "s")
        if source == "s":
            at = text.index(long[i % 3])
            assert gone.issuperset(range(at, at + len(long[i % 3]))) and not gone & set(range(text.index(short[i % 2]), len(text) - 1))


def test_suffix_dedup_of_nothing(none):
    assert suffixdedup.without_repeats(none).count() == 0


# --- byte pairs -------------------------------------------------------------------------------


def test_byte_pairs(spark, docs, none):
    P = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    direct = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pairs = bpe.BytePairs(spark, path, P.PATTERN)
    text = F.col("text")
    out = docs.select("text", pairs.encode(text).alias("ids"), pairs.round_trip(text).alias("t"))
    out = out.withColumn("back", pairs.decode(F.col("ids")))
    for r in out.collect():
        ids = direct.encode_ordinary(r.text or "")
        assert r.ids == ids and bytes(r.back) == (r.text or "").encode()
        assert (r.t.n_tokens, r.t.ids_sha256, r.t.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(r.text or ""))
    assert none.select(pairs.round_trip(text)).count() == 0


def test_stretches_are_safe():
    P = pytest.importorskip("public_tokenizers")
    import regex

    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "é", "1", " ", "  ", "\n", "\t", "'s", "'", "漢", "\x1c", "\x85", "\u2003", "!", "don't "]) for _ in range(80))
        cut = list(bpe.stretches(text, 5))
        assert "".join(cut) == text
        assert [m for c in cut for m in regex.findall(P.PATTERN, c)] == regex.findall(P.PATTERN, text)
    assert list(bpe.stretches("x" * 100, 5)) == ["x" * 100]


# --- lines --------------------------------------------------------------------------------------


def lines_left(rows, run):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    gone = {k: set() for k in order}
    full = {k: [i for i, x in enumerate((rows[k][1] or "").split("\n")) if x.strip(" ")] for k in order}
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        for j in range(len(full[k]) - run + 1):
            window = tuple(lines[i] for i in full[k][j : j + run])
            if window in seen:
                gone[k] |= set(full[k][j : j + run])
            seen.add(window)
    for k in range(len(rows)):
        lines = (rows[k][1] or "").split("\n")
        out.append((str(rows[k][0]), len(full[k]), len(gone[k]), sha("\n".join(x for i, x in enumerate(lines) if i not in gone[k]))))
    return sorted(out)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(spark, docs, none, run):
    kept = linededup.without_repeated_lines(docs, run=run)
    got = sorted((str(r.d.doc_id), r.n_lines, r.n_removed, sha(r.kept)) for r in kept.collect())
    assert got == lines_left(texts(), run)
    assert linededup.without_repeated_lines(none, run=run).count() == 0


def test_line_runs(spark):
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(0, 12))), "s") for i in range(60)]
    kept = linededup.without_repeated_lines(documents(spark, rows), run=3)
    assert sorted((str(r.d.doc_id), r.n_lines, r.n_removed, sha(r.kept)) for r in kept.collect()) == lines_left(rows, 3)


# --- versions -----------------------------------------------------------------------------------


def paragraphs(text):
    import regex

    return {p for p in regex.split(r"(?<=\n|\p{L}{6}[.!?])", text) if p}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_versions(spark, none):
    rows = [(i, t, s) for i, t, s in texts() if i is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(30 + k, "\n".join(sentence(k + j, 3) for j in range(k * 4)), "v") for k in range(12)]
    got = {r.id: r for r in versions.compare_with_edits(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert r.near_edited == pytest.approx(jaccard(paragraphs(t), paragraphs(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraphs(t), paragraphs(after)))
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    assert got[4].fingerprint == got[5].fingerprint != got[1].fingerprint
    assert versions.compare_with_edits(none).count() == 0


def test_versions_query_ends_paragraphs_at_every_sentence(spark, tmp_path):
    from tickbars.llm import queries

    short = " ".join(f"It is {i} to me now." for i in range(40))
    cjk = "".join(f"漢字{i}。" for i in range(30))
    rows = [(3, short, "s"), (2, cjk, "s"), (1, "No end here", "s")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op8_versions(spark, str(tmp_path)).collect()}
    sentences = lambda t: {p for p in re.split(r"(?<=[.!?\n。])", t) if p}
    for k, (i, t, _) in enumerate(rows):
        after = rows[(k + 1) % 3][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].near_edited == pytest.approx(jaccard(sentences(t), sentences(edited)))
    assert got[3].near_edited > 0.3 and got[2].near_edited > 0.3


def test_one_look_recovers_what_peeling_does(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.randrange(-(2**63), 2**63), rnd.choice((-1, 1))) for i in range(300) for _ in range(i % 12)]
    cells = versions.sketches(spark.createDataFrame(rows, "row int, digest long, sign int"), "row")
    peeled = versions.peel(F.col("cells"))
    want = F.struct(F.size(peeled["got"]).alias("d"), versions.is_empty(peeled["cells"]).alias("ok"))
    got = cells.select("row", want.alias("want"), versions.peeled_count(F.col("cells")).alias("got")).collect()
    assert len(got) == 275 and all(r.want == r.got for r in got if r.want.ok or r.got.ok)
    assert {r.want.ok for r in got} == {r.got.ok for r in got} == {True, False}
    assert all(r.got.d == r.row % 12 for r in got if r.got.ok)


def test_versions_with_null_and_repeated_ids(spark, docs):
    got = versions.compare_with_edits(docs).collect()
    assert len(got) == len(texts())
    alone = versions.compare_with_edits(documents(spark, [(None, "abc def", "s")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha("abc d" + "ab")


# --- SimHash ------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    import xxhash

    ws = lower(text).split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(n, links):
    above = list(range(n))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        above[max(ra, rb)] = min(ra, rb)
    return [root(x) for x in range(n)]


def test_simhash(spark, docs, none):
    rows = texts() + [(200 + i, " ".join([*sentence(8, 400).split()[:i], "edit", *sentence(8, 400).split()[i:]]), "n") for i in range(0, 60, 5)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = roots_of(len(rows), links)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in roots}
    want = sorted((str(rows[i][0]), fps[i], str(least[roots[i]])) for i in range(len(rows)))
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component)) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("partitions", [(2,), (3,), (4,)])
def test_no_link_is_lost(spark, partitions):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(6))) for b in base for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    plan = simhash.make_plan(df, partitions=partitions)
    assert sum(plan.thresholds) == 3 - len(plan.groups) + 1 and sorted(b for g in plan.groups for b in g) == list(range(64))
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert {(r.a, r.b) for r in simhash.near_links(df, plan).collect()} == want


def test_thresholds_cost_least():
    from itertools import product

    rnd = random.Random(5)
    costs = [[0.0, *sorted(rnd.random() for _ in range(4))] for _ in range(3)]
    cost, chosen = simhash.allot(costs, 1)
    best = min(sum(costs[i][k + 1] for i, k in enumerate(c)) for c in product(range(-1, 4), repeat=3) if sum(c) == 1)
    assert cost == pytest.approx(best) and sum(chosen) == 1


def test_components(spark):
    rnd = random.Random(6)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2001 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = roots_of(2100, links)
    assert got == {x: roots[x] for x in {y for a, b in links if a != b for y in (a, b)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(spark, docs, none):
    rnd = random.Random(7)

    def edited(words, k):
        words = list(words)
        for i in rnd.sample(range(len(words)), k):
            words[i] = f"new{rnd.randrange(10**6)}"
        return " ".join(words)

    own = [[f"w{rnd.randrange(5000)}" for _ in range(300)] for _ in range(30)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(own)]
    rows += [(100 + i * 40 + j, edited(own[i], 4), "s") for i in range(2) for j in range(40)] + [(500 + i, edited(own[5 + i], 3), "s") for i in range(10)]
    kept = {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).collect()}
    assert kept == set(range(30))
    out = simhash.without_near_copies(docs)
    assert out.columns == docs.columns
    left = [r.text for r in out.collect()]
    assert sum(not (t or "").split() for t in left) == 1 and sum(lower(t) == b"hello world" for t in left) == 1
    assert simhash.without_near_copies(none).count() == 0


def shingle_set(text):
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def copies_at_the_limit(n, kinds=("block", "append", "scatter")):
    """Pairs of texts of Jaccard similarity 0.80 to 0.85 over five-word shingles, by the kind of edit."""
    rnd = random.Random(10)
    out = []
    for k in range(n):
        kind = kinds[k % len(kinds)]
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(120, 500))]
        for m in range(1, len(words)):
            fresh = [f"new{rnd.randrange(10**6)}" for _ in range(m)]
            if kind == "append":
                edited = words + fresh
            elif kind == "block":
                edited = words[:40] + fresh + words[40 + m :]
            else:
                edited = list(words)
                for place, word in zip(random.Random(k).sample(range(len(words)), m), fresh):
                    edited[place] = word
            if jaccard(shingle_set(" ".join(words)), shingle_set(" ".join(edited))) < 0.85:
                break
        pair = " ".join(words), " ".join(edited)
        if jaccard(*map(shingle_set, pair)) >= 0.8:
            out.append((kind, *pair))
    return out


def test_edits_of_all_kinds_are_candidates(spark):
    pairs = copies_at_the_limit(300)
    assert len(pairs) > 250 and {k for k, _, _ in pairs} == {"block", "append", "scatter"}
    rows = [(2 * i + j, p[1 + j], "s") for i, p in enumerate(pairs) for j in range(2)]
    held = documents(spark, rows).select("doc_id", simhash.wide_fingerprints(F.col("text")).alias("w")).collect()
    bands = {r.doc_id: set(r.w.bands) for r in held}
    assert [p[0] for i, p in enumerate(pairs) if not bands[2 * i] & bands[2 * i + 1]] == []
    assert not any(bands[2 * i] & bands[2 * i + 2] for i in range(len(pairs) - 1))


def test_keys_of_candidates_are_parts_of_the_simhash(spark):
    pairs = copies_at_the_limit(60)
    rows = [(i, t, "s") for i, t in enumerate([x for p in pairs for x in p[1:]] + ["one two three four five six seven"])]
    for width in (20, 26):
        parts = simhash.parts_of(width)
        held = documents(spark, rows).select("doc_id", simhash.wide_fingerprints(F.col("text"), width).alias("w")).collect()
        bands = {}
        for r in held:
            bits = "".join(format(x % 2**64, "064b")[::-1] for x in r.w.shingles)
            want = [k << 48 | int(bits[k * width : (k + 1) * width][::-1], 2) for k in range(parts)]
            bands[r.doc_id] = set(r.w.bands)
            assert r.w.bands == (want if r.w.n >= 4 else [])
        assert not any(bands[2 * i].isdisjoint(bands[2 * i + 1]) for i in range(len(pairs)))
    assert simhash.width_for(212_367) == 20 and simhash.width_for(15_000_000) == 26


def test_near_copies_of_few_shingles(spark):
    words = lambda i, n: " ".join(f"t{i}x{k}" for k in range(n))
    rows = [(2 * i + j, words(i, 8 + j), "s") for i in range(200) for j in range(2)] + [(1000 + i, words(i, 7), "s") for i in range(200)]
    kept = {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).collect()}
    assert kept == {2 * i for i in range(200)} | {1000 + i for i in range(200)}


def mixed_copies():
    """Texts whose edits leave similarities from 0.6 to 1, alone and in a large group that no single text links."""
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(150)]
        m = i % 30
        edited = (words[:70] + [f"e{i}x{k}" for k in range(m)] + words[70 + m :]) if i % 2 else words + [f"e{i}x{k}" for k in range(2 * m)]
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(edited), "s")]
    chain = [f"c{rnd.randrange(3000)}" for _ in range(200)]
    for k in range(40):
        rows.append((1000 + k, " ".join(chain[k:] + [f"d{j}" for j in range(k)]), "s"))
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = mixed_copies()
    sets = [shingle_set(t) for _, t, _ in rows]
    likes = {(i, j): jaccard(sets[i], sets[j]) for i in range(len(rows)) for j in range(i)}
    assert sum(0.7 <= x < 0.8 for x in likes.values()) > 10 and sum(0.8 <= x < 0.85 for x in likes.values()) > 5
    roots = roots_of(len(rows), [p for p, x in likes.items() if x >= 0.8])
    want = {min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in roots}
    assert {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).collect()} == want


def pairs_without_a_shared_part(n, width=simhash.NARROW):
    """Texts of similarity 0.8 or more whose SimHashes agree on no part."""
    rnd, place = np.random.default_rng(13), 1 << np.arange(width)
    parts, out = simhash.parts_of(width), []

    def values(text):
        words = simhash._wide_bits(simhash._shingle_hashes(simhash._shingles(text)), parts * width // 64 + 1)
        return np.unpackbits(words.view(np.uint8), bitorder="little")[: parts * width].reshape(parts, width) @ place

    while len(out) < n:
        words = [f"m{k}" for k in rnd.integers(0, 10**6, 40)]
        pair = " ".join(words), " ".join([*words, *(f"n{k}" for k in rnd.integers(0, 10**6, 9))])
        if not (values(pair[0]) == values(pair[1])).any():
            out.append(pair)
    return out


def test_near_copies_that_no_part_of_the_simhash_finds(spark):
    pairs = pairs_without_a_shared_part(3)
    assert all(jaccard(shingle_set(a), shingle_set(b)) >= 0.8 for a, b in pairs)
    rows = [(2 * i + j, t, "s") for i, p in enumerate(pairs) for j, t in enumerate(p)]
    held = documents(spark, rows).select("doc_id", simhash.wide_fingerprints(F.col("text"), simhash.NARROW).alias("w")).collect()
    bands = {r.doc_id: set(r.w.bands) for r in held}
    assert all(bands[2 * i].isdisjoint(bands[2 * i + 1]) for i in range(len(pairs)))
    assert {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).collect()} == {0, 2, 4}


@pytest.mark.parametrize("block, paired, common", [(8, 4, 16), (1024, 64, 2), (8, 4, 10**9)])
def test_rarest_shingles_miss_no_near_copy(spark, monkeypatch, block, paired, common):
    """What the SimHash leaves apart is found, also where it leaves all apart, and where lines are common."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "simhash_links", lambda nodes, *_: nodes.sparkSession.createDataFrame([], "a long, b long"))
    line = " ".join(f"common{k}" for k in range(30))
    words = lambda i, n: " ".join(f"t{i}x{k}" for k in range(n))
    rows = mixed_copies()
    rows += [(2000 + i, f"{t} {line}" if i % 2 else f"{line} {t}", "s") for i, (_, t, _) in enumerate(rows[:60])]
    rows += [(3000 + 3 * i + j, words(i, n), "s") for i in range(4) for j, n in enumerate((7 + i, 8 + i, 9 + i))]
    rows += [(4000, line, "s"), (4001, line + " end", "s"), (4002, "", "s")]
    sets = [shingle_set(t) for _, t, _ in rows]
    roots = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    want = {min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in roots}
    assert {r.doc_id for r in simhash.without_near_copies(documents(spark, rows)).collect()} == want


def test_common_shingles_come_last(spark):
    """A line of all texts fills no bucket: it is among the rarest shingles of none that has others."""
    line = " ".join(f"common{k}" for k in range(20))
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(60)) + " " + line, "s") for i in range(40)]
    common = simhash.common_shingles(documents(spark, rows).select("text"))
    shared = simhash._folded(simhash._shingle_hashes(simhash._shingles(line)))
    held = documents(spark, rows).select(simhash.rare_shingles(F.col("text"), common).alias("r")).collect()
    met = collections.Counter(s % 2**32 for r in held for s in r.r.rare)
    assert all(len(r.r.rare) == 76 - 61 + 1 for r in held) and max(met.values()) < simhash.COMMON
    assert set(common.value[0].tolist()) <= set(shared.tolist()) and len(common.value[0])


def test_only_strays_meet_all_members_of_a_bucket(spark, monkeypatch):
    """Rows of a large bucket grow with its members where most of them have one root; any two of different roots meet."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    members = [(v, v * 1000 + k, v * 1000 + (k if k in strays else 500)) for v, n, strays in [(1, 200, {3, 4, 5}), (2, 6, {1}), (3, 60, range(20)), (4, 40, ())] for k in range(n)]
    cells = simhash.block_cells(spark.createDataFrame(members, "v long, node long, root long")).collect()
    rows, met = collections.Counter(r.v for r in cells), collections.defaultdict(list)
    assert rows[1] == 197 + 3 * 26 and rows[2] == 6 and rows[4] == 0
    for r in cells:
        met[r.v, r.i, r.j].append(r)
    pairs = {frozenset((x.node, y.node)) for cell in met.values() for x in cell for y in cell if x.root != y.root}
    assert pairs == {frozenset((x, y)) for v, x, r in members for w, y, q in members if v == w and r != q}


def test_members_are_joined_once_not_for_each_bucket(spark, monkeypatch):
    """A large group of texts of similarity 0.6 to 0.9: what is known of a member is joined once, not for each of its pairs or buckets."""
    rnd = random.Random(12)
    base = [f"g{rnd.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for place in rnd.sample(range(150), rnd.randrange(1, 9)):
            words[place] = f"n{i}x{place}"
        rows.append((i, " ".join(words), "s"))
    made, whole = {}, simhash.scratch

    def noted(df, name):
        out = whole(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "scratch", noted)
    joined, join = [], type(documents(spark, rows)).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on in ("node", "b") and how is None:
            joined.append(out)
        return out

    monkeypatch.setattr(type(documents(spark, rows)), "join", counted)
    simhash.without_near_copies(documents(spark, rows)).collect()
    assert made["wide-cells"] > 4 * len(rows) and joined
    assert max(x.count() for x in joined) <= len(rows)


# --- toxicity -----------------------------------------------------------------------------------


def brute_segments(scores):
    """Maximal segments by their definition: split around the best one."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    shift = lambda found, k: [(a + k, b + k, s) for a, b, s in found]
    return brute_segments(scores[:i]) + [(i, j, best[0])] + shift(brute_segments(scores[j + 1 :]), j + 1)


def test_pipeline_hands_texts_over_in_small_batches(spark):
    """A batch of 10,000 texts took hundreds of MB beyond the heap, of an executor that has 3,000 in all."""
    import corpus_pipeline
    from tickbars.session import BATCH_BYTES, BATCH_ROWS

    @F.pandas_udf("struct<rows: int, bytes: long>")
    def got(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(texts)] * len(texts), "bytes": [int(texts.str.len().sum())] * len(texts)})

    for stage, asked, most in ((corpus_pipeline.without_near_copies, "10000", BATCH_ROWS), (corpus_pipeline.encoded, "0", BATCH_ROWS), (corpus_pipeline.encoded, "7", 7)):
        own = spark.newSession()
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", asked)
        assert stage(own, documents(own), "").count()
        short = own.range(0, 4000, 1, 1).select(got(F.col("id").cast("string")).alias("g"))
        assert short.agg(F.max("g.rows")).first()[0] == most
        long = own.range(0, 100, 1, 1).select(got(F.repeat(F.lit("x"), 100_000 + F.col("id").cast("int") * 0)).alias("g"))
        assert long.agg(F.max("g.bytes")).first()[0] <= BATCH_BYTES + 100_000


def test_maximal_segments():
    rnd = random.Random(8)
    for _ in range(200):
        drift = 0.37
        scores = [rnd.choice([-drift, -drift, -drift, rnd.uniform(0.1, 2), -rnd.uniform(0.5, 2)]) for _ in range(rnd.randrange(1, 25))]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s != -drift], drift)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def test_toxicity(spark, docs, none):
    rnd = random.Random(9)
    rows = [(i, sentence(i, 40) + (" you grumbling zorkface and vilehead now" if i % 5 == 0 else ""), "s") for i in range(400)]
    rnd.shuffle(rows)
    labelled = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.ToxicityModel.fit(labelled, labels)
    got = labelled.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("h"), model.score(F.col("text")).alias("s")).collect()
    assert all((r.s >= 0.5) == (r.doc_id % 5 == 0) for r in got if r.h) and any(r.h for r in got)
    found = labelled.filter("doc_id = 0").select("text", model.passages(F.col("text")).alias("p")).first()
    assert "zorkface" in found.text[found.p[0].start : found.p[0].end]
    scores = [r.s for r in docs.select(model.score(F.col("text")).alias("s")).collect()]
    assert len(scores) == len(texts()) and all(0 <= s < 0.5 for s in scores)
    assert none.select(model.score(F.col("text"))).count() == 0
    blank = toxicity.ToxicityModel.fit(none, labels)
    assert all(r.s < 0.5 for r in docs.select(blank.score(F.col("text")).alias("s")).collect())


def test_repeated_words_tell_each_time(spark):
    model = toxicity.ToxicityModel({"grumbling": 3.0, "zorkface": 3.0, "vilehead": 3.0}, {}, 0.05)
    passage, clean = "you grumbling zorkface and vilehead now", [sentence(i, 250) for i in range(4)]
    twice = " ".join([clean[0], passage, clean[1], passage, clean[2]])
    spread = " ".join([clean[0], "zorkface", clean[1], "vilehead", clean[2], "grumbling", clean[3], passage, clean[0]])
    rows = documents(spark, [(1, twice, "s"), (2, spread, "s"), (3, passage, "s")])
    found = {r.doc_id: r for r in rows.select("doc_id", "text", model.passages(F.col("text"), 0.001).alias("p")).collect()}
    told = {i: [r.text[p.start : p.end] for p in r.p] for i, r in found.items()}
    toxic = "grumbling zorkface and vilehead"
    assert told == {1: [toxic, toxic], 2: [toxic], 3: [toxic]}
    assert [p.score for r in found.values() for p in r.p] == pytest.approx([found[3].p[0].score] * 4)


def test_labels_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    n = toxicity.training_labels(labels, sample=500).count()
    assert 300 < n <= 500
    assert not toxicity.training_labels(labels).filter(toxicity.is_held_out(F.col("id"))).count()


def test_pages_and_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert any(re.match(rf"op{n}_", name) for name in names)
    assert "pipeline" in names
