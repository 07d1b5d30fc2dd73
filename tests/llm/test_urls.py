import random
import re

import pytest

from jobtide.llm.queries import RULES
from jobtide.llm.urls import bloom_filter, judge, possible

from pyspark.sql import functions as F


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def expected(url, listed):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if (host, path) in listed else "allow")
    return host, path, rule, verdict


@pytest.mark.parametrize("blocks", [0, 1 << 16])
def test_equals_plain_rules(spark, blocks):
    rnd = random.Random(7)
    hosts = ["a.com", "COM", "example.com", "www.Example.com", "x.www.example.com", "b.net", "net", "dot.org", "notexample.org", "example.com.org", ""]
    tails = ["", "/", "/en", "/en/", "/en/x?y=/fr/", "/es/1#z", "/fr/", "?q", "#f", "/EN/"]
    urls = [f"{rnd.choice(['http', 'https', ''])}://{h}{t}" for h in hosts for t in tails] + [None, "", "no scheme", "a://b://c/d", "http://x.org/a\nb"]
    listed = {("dot.org", "/"), ("dot.org", "/en/"), ("x.org", "/a\nb"), ("com", "/")}
    rows = [(i, u, "old") for i, u in enumerate(urls + urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    known = spark.createDataFrame([*listed, *listed, (None, "/")], "host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df, RULES, known, max_blocks=blocks).collect()}
    assert got == {i: expected(u, listed) for i, u, _ in rows}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://q.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string")
    assert judge(pages, RULES, none).first()["verdict"] == "allow"
    assert judge(pages, [], none).first()["rule"] is None
    assert judge(pages.limit(0), RULES, none).count() == 0
    with pytest.raises(ValueError):
        judge(pages, [("", "/", "allow")], none)


def test_blocks_follow_the_list(spark):
    """A list too long for the filter that is sent still gets one that drops what is not listed."""
    from jobtide.llm import urls

    listed = spark.range(3_000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"))
    pages = spark.range(4_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") * 2, F.lit(".org/")).alias("url"))
    seen = {}
    real = urls.possible

    def watched(df, bloom, blocks, most):
        seen.update(blocks=blocks, most=most, passed=real(df, bloom, blocks, most).count())
        return real(df, bloom, blocks, most)

    urls.possible = watched
    try:
        got = judge(pages, RULES, listed, max_blocks=16).groupBy("verdict").count().collect()
    finally:
        urls.possible = real
    assert {r["verdict"]: r["count"] for r in got} == {"block": 1_500, "allow": 2_500}
    assert seen["blocks"] >= 3_000 / urls.PER_BLOCK and seen["most"] == 16 and 1_500 <= seen["passed"] < 1_800


def test_filter_loses_no_key_and_drops_most_others(spark):
    keys = spark.range(2_000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = bloom_filter(keys, 128).cache()
    assert possible(keys, bloom, 128).count() == 2_000
    assert possible(keys, bloom, 128, most=64).count() == 2_000
    others = spark.range(10_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert possible(others, bloom, 128).count() < 500
