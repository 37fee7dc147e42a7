"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

A record is one row of text that ends in CR LF CR; the writer's line feed
completes the blank line between records, so the files are plain WARC/1.1.
Reading doesn't trust the magic: every place that looks like a record start is a
candidate with the offset at which its record would end, and only candidates on
the chain that begins at offset 0 are records. The chain is followed by pointer
jumping, so a file of n records takes about log2(n) rounds.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.store import shards, stored

SHARD_BYTES = 16 << 20
REVISIT_FROM = 100  # payload bytes from which an equal payload is not written again
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

_START = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def record_plan(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) for every row of ``pages``.

    A missing payload is empty. Of equal payloads of ``REVISIT_FROM`` bytes or
    more the smallest page_id is the response; rows that repeat it are responses
    as well, and so are rows without a page_id. Groups of equal payloads are
    found on digests alone; pages move once, dealt into shards of about
    ``shard_bytes`` payload.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    size, digest = F.octet_length(body).cast("long"), F.sha2(body.cast("binary"), 256)
    number = shards(pages.sparkSession, pages.agg(F.sum(size + 500)).first()[0], shard_bytes)
    named = pages.where(F.col(page_id).isNotNull() & (size >= REVISIT_FROM)).select(
        F.col(page_id).alias("page_id"), digest.alias("payload_digest")
    )
    firsts = named.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1")
    again = named.join(firsts.drop("_n"), "payload_digest").where("page_id <> refers_to").distinct()
    keys = ["page_id", "payload_digest"]
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        body.alias("html"),
        size.alias("payload_bytes"),
        digest.alias("payload_digest"),
    )
    # both sides dealt alike, so that the join needs no other exchange
    joined = rows.repartition(number, *keys).join(again.repartition(number, *keys), keys, "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def write_archives(plan: DataFrame, path: str) -> None:
    """One record per row of ``plan``, one gzip file per partition, in the order of page_id within a file."""
    again = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))

    def field(name: str, value: object) -> object:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, field("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(again, field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r"),
    )
    lines = plan.sortWithinPartitions("page_id", "payload_digest").select(record.alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)


CANDIDATE = (
    "file string, at bigint, to bigint, size bigint, record_type string, page string, refers string, "
    "stated_digest string, payload_bytes bigint, payload_digest string"
)


def parse_record(data: bytes, at: int) -> tuple | None:
    """(end, type, id, refers, stated digest, payload bytes, payload digest) of a record that begins at ``at``.

    None unless header, stated length and closing blank line fit the data.
    """
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(data[data.find(b"\r\n", at) + 2 : head + 2])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None
    begin, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    split = data.find(b"\r\n\r\n", begin, end)
    payload = memoryview(data)[split + 4 if split >= 0 else begin : end]
    text = [fields.get(k, b"").decode("utf-8", "replace") for k in (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest")]
    return (end + 4, *text, len(payload), hashlib.sha256(payload).hexdigest())


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the files that parses as a record, with the offset of its successor.

    Offsets of compressed files count their plain content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in CANDIDATE.split(", ")]
        kinds = [pa.int64() if part.endswith("bigint") else pa.string() for part in CANDIDATE.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                data, name = content.as_py(), file.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for start in _START.finditer(data):
                    found = parse_record(data, start.start())
                    if found:
                        end, kind, page, refers, stated, n, digest = found
                        rows.append((name, start.start(), end, len(data), kind, page, refers, stated, n, digest))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CANDIDATE)


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from offset 0 of their file.

    ``nodes`` has (file, at, to). Each round doubles the length of the jumps and
    adds where the known records jump to; it ends when that adds nothing.
    """
    state = stored(nodes.select("file", "at", "to", (F.col("at") == 0).alias("on")), "chain")
    known = -1
    while True:
        now = state.where("on").count()
        if now == known:
            return state.where("on").select("file", "at")
        known = now
        hit = state.where("on").select("file", F.col("to").alias("at"), F.lit(True).alias("_hit"))
        further = state.select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        state = stored(
            state.join(hit, ["file", "at"], "left")
            .join(further, ["file", "to"], "left")
            .select("file", "at", F.col("_to").alias("to"), (F.col("on") | F.coalesce("_hit", F.lit(False))).alias("on")),
            "chain",
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id as text, payload_bytes, payload_digest, record_type, refers_to as text) of all records.

    A revisit takes its length from the response that it refers to and whose
    payload has the digest that it states.
    Records after damage in a file, which no chain reaches, are left out;
    ``incomplete_files`` names such files.
    """
    found = stored(candidates(spark, path), "candidates")
    records = found.join(reachable(found), ["file", "at"], "left_semi")
    ident = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    named = records.select(
        ident("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.nullif(ident("refers"), F.lit("")).alias("refers_to"), F.regexp_extract("stated_digest", "^sha256:(.*)$", 1).alias("stated"),
    )
    wanted = named.where("record_type = 'revisit'").select("page_id", "refers_to", F.col("stated").alias("payload_digest"))
    source = named.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    # an id may stand for several payloads; the stated digest says which
    keys = ["refers_to", "payload_digest"]
    resolved = wanted.join(source.dropDuplicates(keys), keys, "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"
    )
    named = named.drop("stated")
    return named.where("record_type <> 'revisit'").unionByName(resolved)


def incomplete_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with records whose chain doesn't end at the end of the file."""
    found = stored(candidates(spark, path), "candidates")
    ends = found.join(reachable(found), ["file", "at"], "left_semi").groupBy("file").agg(F.max("to").alias("end"))
    sizes = found.groupBy("file").agg(F.max("size").alias("size"))
    return sizes.join(ends, "file", "left").where("NOT (end <=> size)").select("file")
