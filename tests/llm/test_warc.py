import base64
import hashlib

import pytest

from jobtide.llm import warc

ROWS = [
    (3, "http://a/", "same \u00e9"), (1, "http://b/", "same \u00e9"), (9, None, "same \u00e9"), (4, "u", None), (2, "u", ""), (None, "n", "other"),
    (5, "long", "x" * 200_000), (6, "one", "\u65e5"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def archive(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    warc.write_archive(df, str(tmp_path / "warc"))
    return str(tmp_path / "warc")


def test_read_back(spark, archive):
    got = {r["page_id"]: tuple(r)[1:] for r in warc.parsed(warc.read_archive(spark, archive)).collect()}
    first = {"same \u00e9": 1, "": 2}
    for key, _, text in ROWS:
        text = text or ""
        of = first.get(text, key)
        kind = ("response", None) if key == of else ("revisit", of)
        assert got[key] == (len(text.encode()), digest(text), *kind, True)
    assert warc.payloads(spark, archive).count() == 5


def test_records_are_whole(spark, archive):
    records = [bytes(r[0]) for r in warc.records(spark, archive).collect()]
    assert len(records) == len(ROWS)
    for record in records:
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        body = block[:-4]
        assert len(body) == int(fields[b"Content-Length"])
        http, _, payload = body.partition(b"\r\n\r\n")
        if fields[b"WARC-Type"] == b"response":
            assert b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) == fields[b"WARC-Payload-Digest"]
            assert f"Content-Length: {len(payload)}".encode() in http
        else:
            assert payload == b"" and fields[b"WARC-Refers-To"].startswith(b"<urn:page:")


def test_changed_payload_is_noticed(spark, archive, tmp_path):
    from pyspark.sql import functions as F

    bad = warc.payloads(spark, archive).drop("sound").withColumn("body", F.concat("body", F.lit(b"!"))).collect()
    spark.createDataFrame(bad, "digest string, body binary").write.mode("overwrite").parquet(f"{archive}/payloads")
    with pytest.raises(Exception, match="payload is lost or changed"):
        warc.read_archive(spark, archive).collect()


def test_threshold_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"), revisit_from=3)
    kinds = {r["page_id"]: r["record_type"] for r in warc.parsed(warc.read_archive(spark, str(tmp_path / "a"))).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0
