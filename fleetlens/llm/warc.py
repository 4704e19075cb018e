"""WARC archives with revisit resolution.

Archives are written by Spark's own text writer: a row is one whole record, the line separator is the empty pair of
lines that ends a record, files are gzip streams. Since such a file isn't splittable, one task reads it in order,
and a payload that itself holds the text between two records is put together again by its Content-Length.

1. `write_archives` writes a response record per page.
2. `read_records` gives the records back, digests computed from the payloads that were read.
3. `resolve_revisits` shuffles headers by payload digest (no payloads), takes the smallest page_id of each digest
   as the original and joins the others to it; frequent digests are looked up by broadcast, of which there is a
   proven bound.
4. `deduplicated` writes new archives: originals whole, revisits with fresh headers and no payload.

Null html is the empty payload. Payloads under `least_bytes` are never resolved. Pages with a null page_id are
written as responses with an empty id and never become originals. Repeated page_ids with equal payloads are one
record's copies: each is a response if the page_id is the smallest. Empty tables give archives without records;
other columns are ignored. Payloads are text (UTF-8).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, looked_up, new_path, staged

# Fixed values of the format.
VERSION, BREAK = "WARC/1.1\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, uri string, payload string, payload_bytes long, payload_digest string, refers_to long"


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in pairs for x in (F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))])


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]", " ")


def record_text(kind: str, date: str) -> Column:
    """The text of a record from page_id, uri, payload, payload_bytes, payload_digest and, for revisits, refers_to."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes"))), F.lit("\r\n"))
    block = http if kind == "revisit" else F.concat(http, F.col("payload"))
    head = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _one_line(F.col("uri"))), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))]
    if kind == "revisit":
        head += [("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))]
    head += [("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block))]
    return F.concat(F.lit(VERSION), _lines(*head), F.lit("\r\n"), block)


def _save(texts: DataFrame, path: str, mode: str = "error") -> None:
    texts.write.mode(mode).option("lineSep", BREAK).option("compression", "gzip").text(path)


def write_archives(pages: DataFrame, path: str, date: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> None:
    """One response record per row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    _save(rows.select(record_text("response", date)), path)


def _records(pieces: Iterator[str]) -> Iterator[tuple[dict[str, str], str]]:
    """Headers and block of each record, from text cut at every BREAK + VERSION."""
    held, need, size, seam = None, 0, 0, len((BREAK + VERSION).encode())
    for piece in pieces:
        if held is None:
            head, _, body = piece.removeprefix(VERSION).partition(BREAK)
            headers = dict(x.split(": ", 1) for x in head.split("\r\n") if ": " in x)
            held, need, size = [body], int(headers["Content-Length"]), len(body.encode())
        else:
            held.append(piece)
            size += seam + len(piece.encode())
        if size >= need:  # joined once, however often the payload holds the text between records
            yield headers, (BREAK + VERSION).join(held).encode()[:need].decode()
            held = None
    if held is not None:
        raise ValueError("an archive ends inside a record")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, uri, payload, payload_bytes, payload_digest, refers_to of each record."""

    def number(urn: str) -> int | None:
        return int(x) if (x := urn.rpartition(":")[2].rstrip(">")) else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in RECORD.split(", ")]
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names)

        for headers, block in _records(piece for b in it for piece in b.column(0).to_pylist()):
            head, _, payload = block.partition(BREAK)
            kind = headers["WARC-Type"]
            if kind == "revisit":
                http = dict(x.split(": ", 1) for x in head.split("\r\n") if ": " in x)
                row = (None, int(http["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:"), number(headers["WARC-Refers-To"]))
            else:
                raw = payload.encode()
                row = (payload, len(raw), hashlib.sha256(raw).hexdigest(), None)
            out.append((number(headers["WARC-Record-ID"]), kind, headers["WARC-Target-URI"], *row))
            size += len(block)
            if size > 4_000_000:
                yield batch()
                out, size = [], 0
        yield batch()

    return spark.read.option("lineSep", BREAK + VERSION).text(path).mapInArrow(run, RECORD)


def resolve_revisits(headers: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, refers_to of the records that become revisits, from page_id, payload_bytes and payload_digest."""
    large = headers.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first, _ = staged(large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "originals")
    total = first.agg(F.sum("n")).first()[0] or 0
    return looked_up(large, first, ["payload_digest"], total).filter(F.col("page_id") != F.col("refers_to")).select("page_id", "payload_digest", "refers_to")


def deduplicated(spark: SparkSession, source: str, target: str, date: str, least_bytes: int = 100) -> None:
    """Reads the archives in `source`, writes deduplicated ones to `target`."""
    headers, h_path = staged(read_records(spark, source).select("page_id", "payload_bytes", "payload_digest"), "headers")
    revisits, r_path = staged(resolve_revisits(headers, least_bytes).distinct(), "revisits")
    again = read_records(spark, source).drop("refers_to").join(revisits, ["page_id", "payload_digest"], "left")
    _save(again.select(F.when(F.col("refers_to").isNull(), record_text("response", date)).otherwise(record_text("revisit", date))), target)
    dropped(spark, h_path, r_path)


def archive_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 100, **cols: str) -> tuple[DataFrame, str]:
    """Writes, resolves and rewrites; the records of the deduplicated archives and the archives' place."""
    spark = pages.sparkSession
    whole, target = new_path(spark, "warc"), new_path(spark, "warc-dedup")
    write_archives(pages, whole, date, **cols)
    deduplicated(spark, whole, target, date, least_bytes)
    dropped(spark, whole)
    return read_records(spark, target), target
