"""WARC archives with revisit records for repeated payloads.

Headers (page, payload digest, length) are grouped by digest; of payloads of at least
least_bytes the record with the largest page_id is the response and the others become
revisits of it. Archives are written with fresh headers by Spark's own text writer, whose
line separator is the CRLF CRLF that ends every WARC record, so any file system that Spark
writes to will do. Reading parses the files' records by Content-Length, checks each payload
against its digest, and joins revisits to the responses they refer to. It takes archives of one gzip
member, of one a record, or without compression, and holds one record at a time.

Only headers are grouped; the largest page_id of a digest is a partial aggregate, and the
join back to the headers can be split by adaptive execution, so a payload that a third of
all pages share does not land in one task.

Defined cases: null html is an empty payload; a null url is written as an urn of the page;
rows with equal page_id and payload are equal records (all responses if theirs is the
largest page_id); a null page_id comes before all others and is read back as null, as is the
id -2^63; very long pages are written whole; an empty table gives no records; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import table

_LOWEST = -(2**63)
_EOL = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROW = "page_id bigint, uri string, record_id string, record_type string, refers_to_id string, payload_bytes bigint, payload_digest string, intact boolean"


def record_id(page: Column) -> Column:
    """A record id derived from the page, the same in every run."""
    h = F.md5(F.concat(F.lit("warc-page:"), page.cast("string")))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(_LOWEST)).alias("ord"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("bigint").alias("n"),
    )


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(ord, digest, refers): the records that revisit another, and which."""
    heads = payloads(pages).where(F.col("n") >= least_bytes).select("ord", "digest")
    first = heads.groupBy("digest").agg(F.max("ord").alias("refers"), F.count("*").alias("rows")).where("rows > 1")
    return heads.join(first.drop("rows"), "digest").where("ord <> refers").distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 5000) -> None:
    """Writes the deduplicated archives, gzip-compressed, into the folder path."""
    again = table(revisits(pages, least_bytes), "warc-revisits")
    d = payloads(pages).join(again, ["ord", "digest"], "left")
    known = F.col("ord") != _LOWEST
    uri = F.coalesce(F.regexp_replace("url", "[\r\n]", " "), F.concat(F.lit("urn:page:"), F.when(known, F.col("ord")).otherwise(F.lit("none")).cast("string")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("n").cast("string"), F.lit(_EOL * 2),
    )
    visit = F.col("refers").isNotNull()
    block = F.when(visit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(visit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("ord"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(visit, F.concat(line("WARC-Profile", F.lit(_REVISIT)), line("WARC-Refers-To", record_id(F.col("refers"))))).otherwise(F.lit("")),
        F.when(known, line("X-Page-Id", F.col("ord").cast("string"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{_EOL}"),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(_EOL),
    )
    (
        d.withColumn("block", block).select(F.concat(head, "block").alias("value"))
        .write.option("lineSep", _EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    )


def inflated(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive in parts, of all its gzip members if it is compressed."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + step]) for i in range(0, len(data), step))
        return
    member, at = zlib.decompressobj(31), 0
    rest = b""
    while at < len(data) or rest:
        part = rest or bytes(data[at : at + step])
        at += 0 if rest else step
        rest = b""
        while part:
            yield member.decompress(part, step)
            if member.eof:
                rest, part = member.unused_data, b""
                member = zlib.decompressobj(31)
            else:
                part = member.unconsumed_tail
    yield member.flush()


def records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of an archive; Content-Length alone says where a block ends.

    No more than one record and one part are held.
    """
    parts, held, passed = iter(parts), bytearray(), 0

    def fill(size: int) -> bool:
        while len(held) < size:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        stop = held.find(b"\r\n\r\n")
        while stop < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError(f"record at byte {passed} has no end of headers")
                return
            stop = held.find(b"\r\n\r\n")
        lines = held[:stop].decode("utf-8").split(_EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {passed}")
        head = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(head["content-length"])
        if not fill(end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {passed} does not end where its length says")
        yield head, bytes(held[begin:end])
        del held[: end + 4]
        passed += end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; payload_bytes and payload_digest are those of the full payload, null for revisits.

    intact says whether a response's payload has the digest that its header names.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for head, block in records(inflated(memoryview(content.as_buffer()))):
                    page = head.get("x-page-id")
                    kind = head["warc-type"]
                    size = digest = intact = None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        intact = head["warc-payload-digest"] == f"sha1:{digest}"
                    out.append((int(page) if page is not None else None, head["warc-target-uri"], head["warc-record-id"], kind, head.get("warc-refers-to"), size, digest, intact))
                types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=re.findall(r"(\w+) \w+(?:,|$)", _ROW))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _ROW)


def resolve(found: DataFrame) -> DataFrame:
    """Revisits with their response's payload size and digest and, as refers_to, its page_id."""
    answers = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("of_bytes"), F.max("payload_digest").alias("of_digest")
    )
    own = found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
    again = found.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(answers, "refers_to_id", "left")
    again = again.withColumnRenamed("of_bytes", "payload_bytes").withColumnRenamed("of_digest", "payload_digest")
    return own.unionByName(again)
