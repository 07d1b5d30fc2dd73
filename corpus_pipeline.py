"""Cleans, deduplicates, mixes and encodes the documents: five stages, each a Spark job on what the one before kept.

Every stage but the last returns the columns that it gets, with their values and types,
whatever their names: they travel packed in one struct beside the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import langid, lexicon, mixing, partenum, toxicity
from jobtide.llm.bytetext import column
from jobtide.llm.components import removed, written
from jobtide.llm.queries import WEIGHTS, held_out, table, tokenizer_path
from jobtide.session import ship_packages


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """(row, text) and the named columns: ``row`` holds all columns but the text."""
    others = [column(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), F.col("text"), *[column(c) for c in names])


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return packed.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from the labels of two thirds of the ids.

    NULL, empty and wordless texts get the score of the bias alone; without labels of both
    classes nothing goes. Rows are judged one by one, so equal rows stay or go together;
    rows without an id are judged too. Columns of any name (``score``, ``predicted``)
    stay as they are; no rows give no rows.
    """
    ship_packages(spark, "jobtide")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    weights = toxicity.fit(toxicity.sample_labels(docs, labels))
    found = toxicity.score(_packed(docs), weights, keep=["row", "text"])
    return _unpacked(found.where("predicted = 0"), docs)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin. The dictionaries come from two thirds of the ids.

    NULL, empty and letterless texts have no language and go, as does everything if no
    language was learned, and a text as close to a second language. Rows are judged one by
    one, so equal rows stay or go together. Columns of any name (``score``, ``accepted``,
    ``lang_pred``) stay as they are; no rows give no rows.
    """
    ship_packages(spark, "jobtide")
    found = langid.identify(_packed(docs), langid.learn(docs.where(~held_out())), keep=["row", "text"])
    return _unpacked(found.where("accepted"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    A row is known by its id and text, so that another text with the id of a copy stays; of
    rows with equal id and text one stays. Documents without words (NULL, empty) are no copies of
    anything. Of the rows without an id one stays in each group, beside the one with an id.
    Columns of any name stay as they are; no rows give no rows.
    """
    ship_packages(spark, "jobtide")
    found = partenum.near_copies(docs, n=5, num=80, den=100)
    copies = written(found.select(F.col("doc_id").alias("copy"), F.col("hash").alias("of")), "copies")
    rows = _packed(docs).select("row", "text", F.col("row").getField("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    kept = rows.join(copies, F.col("id").eqNullSafe(F.col("copy")) & (F.col("h") == F.col("of")), "left_anti")
    names = docs.select(F.col("doc_id").alias("again"), F.xxhash64("text").alias("hash"))
    again = written(names.groupBy("again", "hash").count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return _unpacked(kept, docs)
    same = F.col("id").eqNullSafe(F.col("again")) & F.col("h").eqNullSafe(F.col("hash"))
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["id", "h"])
    return _unpacked(kept.join(again, same, "left_anti").unionByName(repeated), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for.

    Texts without words (NULL, empty) count nothing and are taken the whole part of their
    source's rate; a NULL source is one like others, the last. Rows with equal id, source and
    text are taken equally often. Columns of any name stay as they are; no rows give no rows.
    """
    ship_packages(spark, "jobtide")
    return _unpacked(mixing.mixed(_packed(docs, "doc_id", "source"), WEIGHTS), docs)


def encode_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256) of each row, repeated ones included.

    NULL and empty texts have no tokens and the digests of nothing. Columns of other names
    are not returned; no rows give no rows.
    """
    ship_packages(spark, "jobtide")
    return lexicon.encode(docs, tokenizer_path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_words),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage has read goes when it has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
