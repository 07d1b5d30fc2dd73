"""Language identification by compression.

One raw-content dictionary per language, cut from a bounded sample of labelled texts,
primes a zstandard compressor. The whole text is compressed in its own order, block by
block, and each block counts by its length, however well it repeats itself. A text
belongs to the language whose dictionary makes it smallest; where two come close, the
answer is rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from jobtide.llm.bytetext import column, map_texts

UNKNOWN = "und"
#: Distinct labelled texts per language that are looked at (those of the smallest hashes), code points taken of each
#: for the dictionary, and the bytes of a dictionary.
SAMPLE, SHARE, DICTIONARY = 300, 8_192, 98_304
#: Groups by hash in which the smallest hashes are ranked before they meet.
GROUPS = 64
#: Most languages that one model may have.
LANGUAGES = 256
#: Texts are compressed in independent blocks, so that a long text does not become its own dictionary. Blocks are short,
#: so that a passage hardly meets its own repetition in one.
LEVEL, BLOCK = 9, 512
#: Bytes that a drawn text may give to a dictionary at least, if there is room.
PIECE = 256
#: Margin from which on a language is accepted: on sf0.1, 1,595 of 1,600 held-out texts have more, no text of random letters has.
MARGIN = 0.07
#: Bytes of the dictionary's end that lead each block: a sure match, so that even a few words pay no more for theirs.
LEAD = 64

_APART = re.compile(r"[\W\d_]+")


def running_words(text: str) -> str:
    """All words of the text in lower case and in their order."""
    return _APART.sub(" ", text.lower()).strip()


def even_share(sizes: list[int], room: int) -> int:
    """The most bytes that each may have, so that all together fill the room."""
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) >= room:
            return room // (len(sizes) - i)
        room -= n
    return max(sizes, default=0)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionary of each language from rows with text and language; rows without either, or without a letter, are left out.

    Equal texts count once: of each language the ``sample`` texts of the smallest hashes are
    taken, or all if there are fewer. Of a long text a piece from a place that follows its hash is used.
    """
    rows = labelled.select(column(text).cast("string").alias("t"), column(lang).cast("string").alias("l"))
    rows = rows.where(r"l IS NOT NULL AND t RLIKE '\\p{L}'").withColumn("h", F.xxhash64("t"))
    ranked = rows.select("l", "h").distinct()
    for group in (["l", F.pmod("h", F.lit(GROUPS))], ["l"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("h"))
        ranked = ranked.withColumn("n", rank).where(F.col("n") <= sample).drop("n")
    last = {r["l"]: r["h"] for r in ranked.groupBy("l").agg(F.max("h").alias("h")).limit(LANGUAGES + 1).collect()}
    if len(last) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not last:
        return {}
    drawn = rows.where(F.col("h") <= F.create_map(*[F.lit(x) for pair in last.items() for x in pair])[F.col("l")])
    letters = F.regexp_replace("t", r"[^\p{L}\p{M}]+", " ")
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length(letters) - SHARE, F.lit(0)) + 1) + 1
    piece = F.substr(letters, start.cast("int"), F.lit(SHARE))
    drawn = drawn.groupBy("l", "h").agg(F.min(piece).alias("t")).toArrow().to_pylist()
    texts: dict[str, list[bytes]] = {k: [] for k in sorted(last)}
    for row in sorted(drawn, key=lambda r: (r["h"], r["t"])):
        if words := running_words(row["t"]):
            texts[row["l"]].append(words.encode() + b" ")
    out = {}
    for k, found in texts.items():
        most = max(PIECE, even_share([len(x) for x in found], size - 1))
        out[k] = (b" " + b"".join(x[:most] for x in found))[:size]
    return {k: v for k, v in out.items() if v.strip()}


class Model:
    """Compressors primed with the dictionaries; one per task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        import zstandard

        self.block, self.compress, self.lead = block, {}, {}
        for lang, content in sorted(dictionaries.items()):
            primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=level)
            self.lead[lang] = content[-LEAD:]
            self.compress[lang] = zstandard.ZstdCompressor(
                dict_data=primed, level=level, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin: by how much of the second smallest size the smallest one is below it."""
        words = running_words(text or "")
        if not self.compress or not any(map(str.isalpha, words)):
            return UNKNOWN, 0.0
        data = f" {words} ".encode()
        with_lead = [(self.lead[lang], f) for lang, f in self.compress.items()]
        totals = [0.0] * len(with_lead)
        for i in range(0, len(data), self.block):
            block = data[i : i + self.block]
            sizes = [len(f(lead + block)) for lead, f in with_lead]
            weight = len(block) / sum(sizes)
            totals = [t + weight * n for t, n in zip(totals, sizes)]
        ranked = sorted(zip(totals, self.compress))
        return ranked[0][1], 1 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0


def identify(
    df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MARGIN, keep: list[str] | None = None
) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the margin, 0 to 1) and ``accepted`` (a language, and a margin of ``min_margin`` or more).

    NULL, empty and letterless texts are ``und`` with score 0 and are not accepted, and so
    are all texts if nothing was learned. Of equal sizes the language first in code-point
    order is given, with score 0. Rows are independent; an empty table stays empty; input
    columns named like an output are replaced.
    """
    known = df.sparkSession.sparkContext.broadcast(dictionaries)
    outputs = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())]

    def make():
        model = Model(known.value)

        def work(texts: pa.Array) -> list:
            found = [model.predict(t.as_py()) for t in texts]
            return [
                pa.array([x for x, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64()),
                pa.array([x != UNKNOWN and m >= min_margin for x, m in found], pa.bool_()),
            ]

        return work

    return map_texts(df, text, outputs, make, keep)
