"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Listed are whole canonical URLs, and rules of a host with its subdomains and the beginning
of a path. Both become keys of one list. A URL has as many possible keys as the rules have
shapes (labels of the host, length of the path), and one of its own. The filter is a
table of 256-bit blocks, as many as the list asks for; what it lets through wrongly falls
out of the join with the list itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.bytetext import column
from jobtide.llm.components import written

#: Blocks (32 bytes each) of the largest filter that is sent to all tasks. That of a longer list is dealt by block.
BLOCKS = 1 << 16
#: Keys a block is meant for.
PER_BLOCK = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(df: DataFrame, url: str = "url") -> DataFrame:
    """The rows with ``host`` and ``path``, which make up the canonical URL."""
    kept = [column(c) for c in df.columns if c not in ("host", "path")]
    return df.select(*kept, host_of(column(url).cast("string")).alias("host"), path_of(column(url).cast("string")).alias("path"))


def _bits(h: Column) -> list[Column]:
    """Two bits in each of the four words of a block."""
    def bit(i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def _addressed(df: DataFrame, blocks: int) -> DataFrame:
    block = F.xxhash64("key").bitwiseAND(F.lit(blocks - 1)).alias("block")
    return df.select("*", block, *[b.alias(f"m{w}") for w, b in enumerate(_bits(F.xxhash64("key", F.lit(1))))])


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the keys: at most ``blocks`` rows."""
    return _addressed(keys.select("key"), blocks).groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(4)])


def possible(df: DataFrame, bloom: DataFrame, blocks: int, most: int = BLOCKS) -> DataFrame:
    """The rows whose key the filter may hold. A filter of at most ``most`` blocks is sent to all tasks, a larger one joined by block."""
    hit = F.lit(True)
    for w in range(4):
        hit = hit & (F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}"))
    passed = _addressed(df, blocks).join(F.broadcast(bloom) if blocks <= most else bloom, "block").where(hit)
    return passed.drop("block", *[f"{x}{w}" for x in "mw" for w in range(4)])


def judge(
    df: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url", default: str = "allow",
    listed_verdict: str = "block", max_blocks: int = BLOCKS,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (host, path, verdict) and are few; ``listed`` has canonical URLs (host,
    path) of any number. A rule fits its host and all subdomains, where the path begins
    with the rule's; of several the longest wins. Without a rule a listed URL gets
    ``listed_verdict`` and any other ``default``. A URL that is NULL or has no ``://`` has
    an empty host and path. Repeated rows and list entries are fine, so are empty tables;
    listed NULLs are left out; input columns named like an output are replaced.
    """
    if not all(host for host, _, _ in rules) or len({r[:2] for r in rules}) < len(rules):
        raise ValueError("rules need a host each, and no two the same host and path")
    spark = df.sparkSession
    pages = canonical(df.drop("rule", "verdict"), url)
    urls = pages.select("host", "path").distinct()
    entries = [(f"r{host} {path}", f"{host}{path}", verdict) for host, path, verdict in rules]
    kind = "key string, rule string, verdict string"
    own = F.concat(F.lit("u"), "host", F.lit(" "), "path").alias("key")
    known = listed.where("host IS NOT NULL AND path IS NOT NULL").select(own).distinct()
    known = known.select("key", F.lit(None).cast("string").alias("rule"), F.lit(listed_verdict).alias("verdict"))
    known = written(known.unionByName(spark.createDataFrame(entries, kind)), "listed")
    blocks, many = 1, known.count()
    while blocks * PER_BLOCK < many:
        blocks *= 2

    shapes = sorted({(host.count(".") + 1, len(path)) for host, path, _ in rules})
    keys = [own]
    for labels, size in shapes:
        fits = (F.length("path") >= size) & (F.length("host") - F.length(F.translate("host", ".", "")) >= labels - 1)
        end = F.substring_index("host", ".", -labels)
        keys.append(F.when(fits, F.concat(F.lit("r"), end, F.lit(" "), F.substring("path", 1, size))))
    candidates = urls.select("host", "path", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")
    hits = possible(candidates, bloom_filter(known, blocks), blocks, max_blocks).join(known, "key")
    best = F.max_by(F.struct("rule", "verdict"), F.coalesce(F.length("rule"), F.lit(-1))).alias("best")
    found = written(hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict"), "verdicts")
    out = pages.join(found, ["host", "path"], "left")
    kept = [column(c) for c in pages.columns]
    return out.select(*kept, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
