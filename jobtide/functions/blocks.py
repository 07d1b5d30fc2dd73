"""Cutting a description into blocks and labelling boilerplate blocks, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions import patterns as P
from jobtide.functions.text import strip, sub


def _not_blank(c: Column) -> Column:
    return c != ""


def split_blocks(c: Column) -> Column:
    """Blocks of a text: lines, inline section headings and bullets start a new one."""
    lines = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(sub(lines, P.SECTION_HEADING, "\n$0"), "\n", -1)
    lines = F.transform(lines, lambda line: strip(sub(strip(line), P.DASH_BULLET, "")))
    parts = F.transform(
        F.filter(lines, _not_blank),
        lambda line: F.filter(F.transform(F.split(line, P.BULLET, -1), strip), _not_blank),
    )
    return F.flatten(parts)


def _any_category() -> str:
    """One pattern that matches where some category's does: most blocks fit none and are searched once.

    Categories that begin at a word boundary share the test for it, which is costly with Unicode classes.
    """
    words, others = [], []
    for pattern in P.BLOCK_CATEGORIES.values():
        flags, rest = pattern.removeprefix("(?").split(")", 1)
        bounded = rest.startswith("\\b") and "U" in flags
        (words if bounded else others).append(f"(?{flags}:{rest.removeprefix(chr(92) + 'b') if bounded else rest})")
    return "|".join([*others, rf"(?U:\b)(?:{'|'.join(words)})"])


def block_category(block: Column) -> Column:
    """Label of the first boilerplate pattern that matches, else NULL."""
    return F.when(block.rlike(_any_category()), _first_category(block))


def _first_category(block: Column) -> Column:
    category = None
    for label, pattern in P.BLOCK_CATEGORIES.items():
        hit = block.rlike(pattern)
        if label == "Company marketing paragraph":
            hit = (F.length(block) >= P.MARKETING_MIN_LENGTH) & hit
        category = F.when(hit, label) if category is None else category.when(hit, label)
    return category


def labelled_blocks(c: Column) -> Column:
    """Array of (block, category); the category of a kept block is NULL."""
    return F.transform(
        split_blocks(c),
        lambda b: F.struct(b.alias("block"), block_category(b).alias("category")),
    )


def kept_text(original: Column, labelled: Column) -> Column:
    """Kept blocks joined by line feeds; a text without any block is left as it is."""
    kept = F.filter(labelled, lambda b: b["category"].isNull())
    joined = F.array_join(F.transform(kept, lambda b: b["block"]), "\n")
    return F.when(F.size(labelled) == 0, original).otherwise(joined)


def removed_count(labelled: Column, category: str | None = None) -> Column:
    """Number of removed blocks, of one category or of all; 0 for NULL."""
    if category is None:
        hits = F.filter(labelled, lambda b: b["category"].isNotNull())
    else:
        hits = F.filter(labelled, lambda b: b["category"].eqNullSafe(category))
    return F.when(labelled.isNull(), 0).otherwise(F.size(hits))
