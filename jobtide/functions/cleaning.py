"""The text-cleaning steps, one column function each, and the whole chain."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import patterns as P
from jobtide.functions import scan
from jobtide.functions.text import decode_entities, settle, strip, sub

Step = Callable[[Column], Column]


def contains_any(c: Column, literals: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in literals])


def _step(pattern: str, replacement: str, *needs: str) -> Step:
    """A replacement that runs only on texts holding one of the literals it needs.

    A byte search is far cheaper than decoding the text for a regular expression.
    """
    def apply(c: Column) -> Column:
        replaced = sub(c, pattern, replacement)
        return F.when(contains_any(c, needs), replaced).otherwise(c) if needs else replaced

    apply.guarded = bool(needs)
    return apply


unlink_markdown = _step(P.MARKDOWN_LINK, "$1", "](")
drop_urls = _step(P.RAW_URL, " ")
drop_tags = _step(P.HTML_TAG, " ", "<")
unwrap_bold = _step(P.MARKDOWN_BOLD, "$1", "**")
unwrap_underscore = _step(P.MARKDOWN_UNDERSCORE, "$1", "__")
unwrap_code = _step(P.INLINE_CODE, "$1", "`")
drop_emails = _step(P.EMAIL, " ", "@")
drop_phones = _step(P.PHONE, " ")
drop_partial_urls = _step(P.PARTIAL_URL, " ")
drop_asterisks = _step(P.ASTERISKS, " ", "**")
drop_redacted = _step(P.REDACTED, " ", "***")
drop_empty_wrappers = _step(P.EMPTY_WRAPPER, " ", "(", "[", "{")
drop_gender_markers = _step(P.GENDER_MARKER, " ")
drop_quotes = _step(P.QUOTE, "", '"', "'")
empty_separator_lines = _step(P.SEPARATOR_LINE, "")
drop_emoji = _step(P.EMOJI, " ")
collapse_blanks = _step(P.BLANKS, " ", "  ", "\t")
tighten_newlines = _step(P.NEWLINE_SPACING, "\n", " \n", "\n ")
collapse_newlines = _step(P.NEWLINES, "\n", "\n\n")
newline_to_period = _step(P.OPEN_NEWLINE, ". ", "\n")


def drop_call_to_action(c: Column) -> Column:
    """Drop sentences that ask to apply or join, keeping the delimiter before them.

    The sentence pattern scans from every delimiter, so it only runs on texts
    that hold one of its phrases.
    """
    return F.when(c.rlike(P.CALL_TO_ACTION_HINT), sub(c, P.CALL_TO_ACTION, "$1")).otherwise(c)


drop_call_to_action.guarded = True
strip.guarded = False

# The order matters: each step sees the output of the one before. The first ones change a
# text only around marks (see ``scan``), the others everywhere.
MARK_STEPS = [
    unlink_markdown, drop_urls, drop_tags, unwrap_bold, unwrap_underscore, unwrap_code,
    drop_emails, drop_phones, drop_partial_urls, drop_asterisks, drop_redacted,
    drop_empty_wrappers, drop_gender_markers, drop_quotes, empty_separator_lines, drop_emoji,
    drop_call_to_action,
]
LAYOUT_STEPS = [collapse_blanks, tighten_newlines, collapse_newlines, newline_to_period, strip]
STEPS = MARK_STEPS + LAYOUT_STEPS


def chain(df: DataFrame, column: str, steps: list[Step]) -> DataFrame:
    """Apply steps in order.

    A guarded step reads its input more than once, so it gets a projection of its
    own and the steps before it are not repeated; the others nest.
    """
    c = F.col(f"`{column}`")
    pending = c
    for step in steps:
        if step.guarded and pending is not c:
            df = df.withColumn(column, pending)
            pending = c
        pending = step(pending)
        if step.guarded:
            df = df.withColumn(column, pending)
            pending = c
    return df if pending is c else df.withColumn(column, pending)


def clean_text(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Entity decoding and all steps on one column; NULL stays NULL.

    The steps around marks see the body of a text only.
    """
    into = into or column
    text, at = F.col(f"`{into}`"), F.col("_at")
    df = df.withColumn(into, decode_entities(F.col(f"`{column}`")))
    df = df.withColumn("_at", scan.place(text)).withColumn("_body", scan.body(text, at))
    df = chain(df, "_body", MARK_STEPS)
    df = df.withColumn(into, F.when(at["take"] == 0, text).otherwise(scan.rejoined(text, at, F.col("_body"))))
    return settle(chain(df.drop("_at", "_body"), into, LAYOUT_STEPS), into)
