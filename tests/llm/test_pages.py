"""WARC archives and the URL filter."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tickbars.llm import urlfilter, warc
from tickbars.session import shared_dir

SCHEMA = "page_id bigint, url string, html string, row bigint, digest string, n int, host string"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2, "h") for i, u, h in rows], SCHEMA).repartition(3)


BIG = "<p>" + "ä" * 60 + "\r\n\r\nWARC/1.1\r\n</p>"
PAGES = [
    (5, "http://a.org/x", BIG),
    (3, "http://b.org/y\r\nX: 1", BIG),
    (None, None, BIG),
    (9, "http://c.org", BIG),
    (9, "http://c.org", BIG),
    (1, "http://d.org", "short"),
    (2, "http://e.org", "short"),
    (4, "http://f.org", None),
    (6, "http://g.org", ""),
    (7, "http://h.org", "z" * 300_000),
    (8, "http://i.org", "b" * 99),
    (10, "http://i.org", "b" * 99),
    (11, "http://i.org", "c" * 100),
    (12, "http://i.org", "c" * 100),
]


def test_archives(spark, tmp_path):
    path = f"{shared_dir(spark)}/archives-test-{tmp_path.name}"
    warc.write_archives(pages(spark, PAGES), path, "2024-01-01T00:00:00Z", records=4)
    records = warc.read_archives(spark, path)
    got = warc.resolve_revisits(records).collect()
    assert len(got) == len(PAGES) == len({r.record_id for r in got})
    want = []
    for k, (i, _, h) in enumerate(PAGES):
        data = (h or "").encode()
        same = [x for x in range(len(PAGES)) if (PAGES[x][2] or "").encode() == data]
        first = min(same, key=lambda x: (PAGES[x][0] is None, PAGES[x][0], x))
        again = len(data) >= 100 and first != k
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(PAGES[first][0]) if again else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
    assert any(r.target_uri == "http://b.org/y%0D%0AX: 1" for r in got)


def test_no_pages(spark, tmp_path):
    path = f"{shared_dir(spark)}/archives-none-{tmp_path.name}"
    warc.write_archives(spark.createDataFrame([], SCHEMA), path, "2024-01-01T00:00:00Z")
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0


URLS = {
    "https://EXAMPLE.org/es/1#x": ("example.org", "/es/1", "example.org/es/", "block"),
    "http://m.Example.ORG/en/17?q=/es/": ("m.example.org", "/en/17", "example.org/en/1", "block"),
    "http://www.example.org/en/2": ("www.example.org", "/en/2", "org/", "allow"),
    "http://example.org": ("example.org", "", None, None),
    "http://shop.com/de/1": ("shop.com", "/de/1", "com/de/", "block"),
    "http://shop.com/fr/://x": ("shop.com", "/fr/://x", "com/fr/", "allow"),
    "http://notorg/x": ("notorg", "/x", None, None),
    "x://?a://b.org/": ("", "", None, None),
    "no scheme": ("", "", None, None),
    "ÄB://ÄB.org/": ("Äb.org", "/", "org/", "allow"),
}


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(99, None, None)]
    got = {r.url: r for r in urlfilter.judge(pages(spark, rows).drop("host"), RULES).collect()}
    for url, (host, path, rule, verdict) in URLS.items():
        r = got[url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert (got[None].host, got[None].path, got[None].rule) == ("", "", None)


def test_words_and_model(spark):
    rows = [(i, f"http://{h}/{p}/{i}", None) for i, (h, p) in enumerate(
        [("casinobets.example.net", "slots"), ("cheap-pills.example.net", "buy"), ("news.example.net", "story")] * 30 + [("garden-tools.example.net", "story")] * 40)]
    rows += [(1000, "http://gardentools.example.net/story/1", None), (1001, "http://other.example.net/slots/buy", None)]
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, rows), []).collect()}
    assert got[0].verdict == got[1].verdict == "block" and got[2].verdict == got[1000].verdict == "allow"
    assert got[1001].score > got[1000].score
    urls = pages(spark, rows).select(urlfilter.url_host(F.col("url")).alias("host"), urlfilter.url_path(F.col("url")).alias("path"), F.lit("").alias("title"))
    model = urlfilter.UrlModel.fit(urls)
    assert model.segment("gardentools") == ["garden", "tools"] and model.segment("casinobets") == ["casino", "bets"] and model.segment("") == []


def brute_split(model, name):
    if not name:
        return 0.0, []
    best = None
    for k in range(1, len(name) + 1):
        word, (rest, words) = name[:k], brute_split(model, name[k:])
        cost = model.words.get(word, model.unknown - len(word) * 2.302585092994046) + rest
        if best is None or cost > best[0] + 1e-9:
            best = (cost, [word, *words])
    return best


@pytest.mark.parametrize("name", ["freeslots", "xfreeq", "adsad", "winspamx"])
def test_split_is_the_most_probable(name):
    model = urlfilter.UrlModel({"free": -3.0, "slots": -4.0, "ads": -3.5, "ad": -3.4, "win": -3.0, "spam": -5.0}, -6.0, {}, 0.0)
    words = model.segment(name)
    cost = sum(model.words.get(w, model.unknown - len(w) * 2.302585092994046) for w in words)
    assert "".join(words) == name and cost == pytest.approx(brute_split(model, name)[0])


def test_no_urls(spark):
    assert urlfilter.judge(spark.createDataFrame([], SCHEMA), RULES).count() == 0
