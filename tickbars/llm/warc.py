"""WARC archives in which repeated payloads are revisit records.

Each page's payload digest and size are taken once and stored with it. The headers alone are
grouped by digest; the response of a digest is joined to the others, which become revisits of
it. Every row has then its own record, and payloads meet their decisions by row number, a key
without skew. Spark's text writer writes the records, whose separator is the end of a record.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.llm.common import HEAVY_SHARE, join_to_unique, scratch

#: Payloads below this many bytes are stored each time.
LEAST_BYTES = 100

#: Records in an archive file at most; readers hold a file in memory.
RECORDS = 1000

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = (
    "record_id string, record_type string, target_uri string, page_id long, payload_digest string, "
    "payload_bytes long, refers_to_record string, payload binary"
)


def write_archives(
    pages: DataFrame,
    path: str,
    date: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST_BYTES,
    records: int = RECORDS,
) -> None:
    """Write a record per page below ``path``, as gzip files.

    Of equal payloads of ``least`` bytes or more the one with the smallest id is stored, null ids
    last; of rows that tie, one. The others are revisits of it. A null payload is empty, a null
    url or id is left out of the header, line ends in a url are escaped. No pages give no records.
    """
    payload = F.coalesce(pages[payload_col], F.lit(""))
    stored = scratch(
        pages.select(
            pages[id_col].cast("long").alias("page_id"),
            F.regexp_replace(F.regexp_replace(pages[url_col], "\r", "%0D"), "\n", "%0A").alias("url"),
            payload.alias("payload"),
            F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"),
            F.octet_length(payload).cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "pages",
    )
    headers = stored.drop("payload")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url")
    groups = headers.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = scratch(groups.filter("n > 1").select("digest", "n", "first.page_id", "first.row", "first.url"), "payloads").select(
        "digest", "n", *[F.col(c).alias(f"first_{c}") for c in ("page_id", "row", "url")]
    )
    heavy = groups.filter(F.col("n") * HEAVY_SHARE >= headers.count())
    again = join_to_unique(headers.select("row", "digest"), groups, "digest", heavy).filter("row != first_row")
    revisits = scratch(again.select("row", "first_row", "first_url"), "revisits")

    record = stored.join(revisits.hint("merge"), "row", "left").select(_record(date).alias("value"))
    record.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _record_id(row: Column, digest: Column) -> Column:
    """A name for a record: from its row and digest, in the form of a UUID."""
    parts = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", row, digest)), parts, "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(date: str) -> Column:
    first = F.col("first_row")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END)
    )
    block = F.when(first.isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # noqa: E731  null, and left out, where the value is
    revisit = lambda name, value: F.when(first.isNotNull(), line(name, value))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(first.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _record_id(F.col("row"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        revisit("WARC-Profile", F.lit(_PROFILE)),
        revisit("WARC-Refers-To", _record_id(first, F.col("digest"))),
        revisit("WARC-Refers-To-Target-URI", F.col("first_url")),
        revisit("WARC-Refers-To-Date", F.lit(date)),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(_END), block)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives: headers and, if asked for, the payload of responses.

    A response whose payload differs from its digest fails the job. A file is read as a whole;
    ``records`` of the writer bounds it.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = gzip.decompress(content)
                rows, held = [], 0
                for row in _parsed(memoryview(data), payloads):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 16_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = [part.split()[0] for part in _READ.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, _READ)


def _parsed(data: memoryview, payloads: bool) -> Iterator[tuple]:
    raw, at, end = data.obj, 0, _END.encode()
    while at < len(raw):
        stop = raw.index(end, at)
        head = dict(line.split(": ", 1) for line in raw[at:stop].decode().split("\r\n")[1:])
        block = data[stop + 4 : stop + 4 + int(head["Content-Length"])]
        at = stop + 4 + len(block) + len(end)
        inner = bytes(block[:1024]).index(end) + 4
        http = dict(line.split(": ", 1) for line in bytes(block[: inner - 4]).decode().split("\r\n")[1:])
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        payload = block[inner:] if head["WARC-Type"] == "response" else None
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        number = head.get("X-Page-ID")
        yield (
            head["WARC-Record-ID"],
            head["WARC-Type"],
            head.get("WARC-Target-URI"),
            None if number is None else int(number),
            digest,
            int(http["Content-Length"]),
            head.get("WARC-Refers-To"),
            bytes(payload) if payloads and payload is not None else None,
        )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with refers_to, the page_id of the response that a revisit stands for; else null."""
    again = records.filter("record_type = 'revisit'").withColumnRenamed("refers_to_record", "target")
    counts = again.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    first = records.filter("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    known = scratch(first.join(counts, "target"), "responses")
    heavy = known.filter(F.col("n") * HEAVY_SHARE >= records.count())
    found = join_to_unique(again, known, "target", heavy).drop("target", "n")
    alone = records.filter("record_type = 'response'").drop("refers_to_record").withColumn("refers_to", F.lit(None).cast("long"))
    return alone.unionByName(found)
