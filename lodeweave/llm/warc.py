"""Content-addressed WARC archive.

An archive is two tables: `headers` keeps the exact header block of every record, `payloads` keeps
each payload's bytes once under its SHA-256. A record is header + payload + end mark again through
a join on the digest; the digest is checked against the bytes when they are read.

Defined cases: a null payload is empty; payloads under MIN_SHARED bytes are never shared as revisits,
though their bytes are stored once too; of equal payloads the smallest page_id is the response (a null id after
all others: pages without one revisit it, and are responses all if no page has one; rows that repeat that id are responses all); rows equal throughout share a record id; a null url becomes
an empty target; payloads of any length that fit a row are kept whole; an empty table gives an empty
archive; further columns of the input are ignored. A header has no CR or LF from a
url: they are percent-coded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import join_often, shared_dir, staged

MIN_SHARED = 100
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column, url: Column) -> Column:
    """Rows that repeat a page_id have records of their own unless they are equal throughout."""
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest, url).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def record_headers(pages: DataFrame, captured: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, digest, record_type, refers_to, header: the header block of each page's record."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("payload_bytes"))
    first = own.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("long")
    found = join_often(own, staged(first), "digest", "n").withColumn("refers_to", F.when((F.col("payload_bytes") >= MIN_SHARED) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first.page_id")).otherwise(none))
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    header = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), F.col("url"))),
        line("WARC-Date", F.lit(captured)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"), F.col("first.url")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
    )
    return found.select("page_id", "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to", F.concat(header, F.lit(END)).alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """digest, payload, n (records that hold its bytes: one of those that are shared): each distinct payload once. Equal digests with unequal bytes end the job."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    one = pages.select("page_id", F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    stored = one.groupBy("digest").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("ids"), F.min(F.xxhash64("payload")).alias("low"), F.max(F.xxhash64("payload")).alias("high"))
    same = F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(F.lit("two payloads share digest "), F.col("digest"))))
    shared = (F.length("payload") >= MIN_SHARED) & (F.col("ids") > 0)
    return stored.select("digest", "payload", F.when(shared, 1).otherwise(F.col("n")).alias("n"), F.coalesce(same.cast("boolean"), F.lit(True)).alias("same")).filter("same").drop("same")


def write_archive(pages: DataFrame, path: str) -> None:
    record_headers(pages).write.parquet(f"{path}/headers")
    payloads(pages).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, record_type, digest, payload: headers, joined with the verified bytes of their payload; a revisit has none of its own."""
    kept = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload doesn't have digest "), F.col("digest")))
    kept = kept.select("digest", "n", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))
    headers = spark.read.parquet(f"{path}/headers").select("digest", "page_id", "header", "record_type")
    columns = ("page_id", "header", "record_type", "digest", "payload")
    full = join_often(headers.filter("record_type = 'response'"), kept, "digest", "n").select(*columns)
    return full.unionByName(headers.filter("record_type = 'revisit'").withColumn("payload", F.lit(b"")).select(*columns))


def original_records(archive: DataFrame) -> DataFrame:
    """page_id, record: the bytes of each WARC record."""
    return archive.select("page_id", F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(END).cast("binary")).alias("record"))


def parsed_records(records: DataFrame) -> DataFrame:
    """page_id, record_id, record_type, target (the record a revisit refers to), digest, length, body_digest, read from records(page_id, record)."""
    head = F.substring_index(F.col("record").cast("string"), END, 1)
    field = lambda name: F.regexp_extract("head", f"(?m)^{name}: ([^\r\n]*)", 1)
    x = records.withColumn("head", head).withColumn("length", field("Content-Length").cast("long"))
    body = F.substring(F.col("record"), F.octet_length("head") + len(END) + 1, F.col("length").cast("int"))
    rest = F.substring(F.col("record"), F.octet_length("head") + len(END) + 1 + F.col("length").cast("int"), F.lit(1 << 30))
    whole = F.when(rest != F.lit(END).cast("binary"), F.raise_error(F.lit("a record has another length than its header says")).cast("string"))
    return x.select(
        "page_id", field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Refers-To").alias("target"), F.substring(field("WARC-Payload-Digest"), 8, 64).alias("digest"), "length",
        F.coalesce(whole, F.sha2(body, 256)).alias("body_digest"),
    )


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, rebuild its records, and report what each record's own bytes say; a revisit's payload is its target's."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    read = staged(parsed_records(original_records(read_archive(spark, path))))
    wrong = F.raise_error(F.concat(F.lit("a record's payload doesn't have digest "), F.col("digest"))).cast("string")
    responses = read.filter("record_type = 'response'").withColumn("digest", F.when(F.col("digest") == F.col("body_digest"), F.col("digest")).otherwise(wrong))
    revisits = read.filter("record_type = 'revisit'").select("page_id", "digest", "record_type", F.col("target").alias("record_id"))
    asked = revisits.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    targets = staged(responses.join(asked, "record_id").groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("length").alias("length"), F.min("n").alias("n")))
    again = join_often(revisits, targets, "record_id", "n")
    none = F.lit(None).cast("long").alias("refers_to")
    return responses.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", none).unionByName(
        again.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )
