"""Content-addressed WARC archive: payloads once by digest, exact record headers apart, records rebuilt through joins.

write() leaves two tables in a folder of the shared store:

    payloads   sha256, sha1, n_bytes, winner (largest page_id), n_records, payload    one row for each distinct payload
    headers    page_id, sha256, header                              one row for each record, header as it stands in a WARC file

A payload is stored under its SHA-256; equal payloads are merged before and after the shuffle, and the records of a payload
that many share are dealt over tasks. read() joins both tables, rebuilds every record, recomputes the digests of the stored
bytes and of each record's block, and fails on any that differ from its key or from a record's header.

Of records with equal payloads of at least `REVISIT_BYTES`, those of the largest page_id are responses and the others
revisit it. null html is an empty payload, null url leaves out WARC-Target-URI. A missing page_id is never the largest;
if no record of a payload has one, all are responses. Repeated rows stay records.
A payload is one value of a row, of up to 2 GiB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import hot_keys, salted_join, scratch, write_table

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:terralith:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))


def _described(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("`html`").cast("string"), F.lit("")).cast("binary")
    one = pages.select(F.col("`page_id`").cast("bigint").alias("page_id"), F.col("`url`").cast("string").alias("url"), payload.alias("payload"))
    return one.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n_bytes": F.length("payload").cast("bigint")})


def write(pages: DataFrame, folder: str | None = None) -> str:
    """Writes the archive and returns its folder."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = _described(pages)
    store = rows.groupBy("sha256").agg(F.first("sha1").alias("sha1"), F.first("n_bytes").alias("n_bytes"), F.max("page_id").alias("winner"), F.count("*").alias("n_records"), F.first("payload").alias("payload"))
    write_table(store, f"{folder}/payloads")
    winners = spark.read.parquet(f"{folder}/payloads").select("sha256", "winner", "n_records")
    records = salted_join(rows.drop("payload"), winners.drop("n_records"), "sha256", hot_keys(winners, "sha256", "n_records"))
    revisit = (F.col("n_bytes") >= REVISIT_BYTES) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("winner")) & F.col("winner").isNotNull(), F.lit(False))
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _id(F.col("winner")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(_EOL),
    )
    write_table(records.select("page_id", "sha256", header.alias("header")), f"{folder}/headers")
    return folder


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract("header", rf"\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def _or_fail(ok: Column, value: Column, why: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(why)).cast("string"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, header, record (the bytes of the WARC record, header and block), payload, payload_digest and payload_bytes of every record.

    A payload whose digests aren't its key and a record whose header tells another digest or length fail the read.
    """
    heads = spark.read.parquet(f"{folder}/headers").select("sha256", "header")
    store = spark.read.parquet(f"{folder}/payloads")
    stored = store.select(_or_fail(F.col("sha256") == F.sha2("payload", 256), F.col("sha256"), "a stored payload is damaged").alias("sha256"), "payload", F.sha1("payload").alias("stored_digest"))
    both = salted_join(heads, stored, "sha256", hot_keys(store.select("sha256", "n_records"), "sha256", "n_records"))
    both = both.withColumns({"revisit": _field("WARC-Type", "([a-z]+)") == "revisit", "told": _field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})"), "size": _field("Content-Length", "([0-9]+)").cast("int")})
    both = both.withColumn("record", F.concat(F.col("header").cast("binary"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")))
    block = F.substring("record", F.octet_length("header") + 1, F.col("size"))
    whole = F.octet_length("record") == F.octet_length("header") + F.col("size") + 4
    digest = F.when(F.col("revisit"), F.col("stored_digest")).otherwise(F.sha1(block))
    return both.select(
        _field("WARC-Record-ID", "<urn:terralith:page:(-?[0-9]+)>").cast("bigint").alias("page_id"),
        "header",
        "record",
        "payload",
        _or_fail(whole & (F.col("told") == digest), F.col("told"), "a record is not what its header says").alias("payload_digest"),
        F.length("payload").cast("bigint").alias("payload_bytes"),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, each rebuilt and checked."""
    return records(spark, folder).select("page_id", "payload_bytes", "payload_digest", _field("WARC-Type", "([a-z]+)").alias("record_type"), _field("WARC-Refers-To", "<urn:terralith:page:(-?[0-9]+)>").cast("bigint").alias("refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     w AS (SELECT d, n, max(page_id) AS m FROM p GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 1000 AND p.page_id <> w.m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 1000 AND p.page_id <> w.m THEN w.m END AS refers_to
FROM p JOIN w ON p.d = w.d AND p.n = w.n
"""
