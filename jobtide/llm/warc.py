"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, which is checked when they are read.
The exact header bytes of every record are stored apart. Records are rebuilt by a join,
byte for byte as they would stand in a WARC file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm.bytetext import column

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0) -> None:
    """Writes ``headers`` and ``payloads`` under ``path`` (a shared folder).

    Of records with equal payloads of at least ``revisit_from`` bytes the one with the
    smallest key is the response and the others revisit it; all others are responses. A
    NULL payload is empty, a NULL URL is left out of the header. Rows with a NULL key come
    after all keys; rows that repeat the smallest key are all responses.
    """
    body = F.coalesce(F.encode(column(payload).cast("string"), "UTF-8"), F.lit(b""))
    records = df.select(column(key).cast("long").alias("key"), column(url).cast("string").alias("url"), body.alias("body"))
    records = records.select("key", "url", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("digest"), "body")
    # Narrow, and combined before it moves: a payload may have very many copies.
    firsts = records.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.min("key").alias("first"))
    firsts.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/firsts")
    firsts = df.sparkSession.read.schema(firsts.schema).parquet(f"{path}/firsts")
    names = records.select("key", "url", "size", "digest", base32_sha1(F.col("body")).alias("sha1")).join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    uri = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(_HTTP), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(_END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(F.col("key"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", uri(F.col("first"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", length.cast("string")),
        F.lit(_END), http,
    )
    headers = names.select("key", F.encode(head, "UTF-8").alias("header"), "digest", "size", revisit.alias("revisit"))
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    # One of the equal payloads of each task moves: a payload may have very many copies.
    once = records.groupBy("digest").agg(F.first("body").alias("body"))
    once.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, body, sound): the stored payloads, and whether their bytes still have the digest."""
    stored = spark.read.schema("digest string, body binary").parquet(f"{path}/payloads")
    return stored.withColumn("sound", F.sha2("body", 256) == F.col("digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, revisit): every record's header bytes beside its full payload; a lost or changed payload fails.

    A revisit's own block has no payload bytes: they come from the record that it refers to.
    """
    headers = spark.read.schema("key long, header binary, digest string, size long, revisit boolean").parquet(f"{path}/headers")
    joined = headers.join(payloads(spark, path), "digest", "left")
    checked = F.when(F.col("sound"), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("payload is lost or changed: "), "digest")).cast("binary"))
    return joined.select("header", checked.alias("payload"), "revisit")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the exact bytes of each record of a WARC file."""
    block = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return read_archive(spark, path).select(F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def parsed(df: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from header and payload bytes."""
    head = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.regexp_extract(head, rf"\r\n{name}: {pattern}\r\n", 1)
    number = lambda name: F.nullif(field(name, "<urn:page:(-?[0-9]*)>"), F.lit("")).cast("long")
    return df.select(
        number("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), field("WARC-Type", "([a-z]+)").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), (field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)") == base32_sha1(F.col("payload"))).alias("digest_holds"),
    )
