"""The text steps in DuckDB SQL.

DuckDB's regular expressions have no lookaround, and their ``\\b`` and ``\\B``
know ASCII only. So accented letters are fenced with ASCII letters while a
pattern with boundaries runs, and boundaries stand in for lookarounds.

Fixed values: the patterns below are those that the results depend on, in DuckDB's dialect.
"""

from __future__ import annotations

from bindings.base import lit

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def fence(x: str) -> str:
    return f"regexp_replace({x}, '([\\x{{C0}}-\\x{{24F}}])', 'QZ\\1QZ', 'g')"


def unfence(x: str) -> str:
    return f"replace({x}, 'QZ', '')"


def fenced(x: str, pattern: str, to: str) -> str:
    return unfence(sub(fence(x), pattern, to))


LINK = r"\[([^\]]+)\]\([^)]+\)"
URL = r"""(?i)(?:https?\s*[:\-]\s*/\s*/\s*|www\.)[^\s<>()\[\]{}"']+"""
TAG = r"<[^>]+>"
BOLD = r"\*\*([^*]+)\*\*"
UNDER = r"__([^_]+)__"
CODE = r"`([^`]+)`"
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
PHONE = r"(?:\B\+|\b)\d[\d\s().\-]{7,}\d\b"
PARTIAL = r"""(?i)(?:https?://\s*)?(?:www\.\s*)?\.[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/[^\s)\]}">']*)?(?:\?[^\s)\]}">']*)?"""
STARS = r"\*{2,}"
REDACTED = r"\B\*{3,}\B"
WRAPPER = r"\(\s*\)|\[\s*\]|\{\s*\}"
GENDER = (
    r"(?i)(?:\B[(\[]\s*|\B\s+|\b)[mfwxdh](?:\s*[/|\\-]?\s*[mfwxdh]){1,2}(?:\s*[)\]]\B|\s+\B|\b)"
)
QUOTE = r"""\\"|"|\B'|'\B"""
SEPARATOR = r"(?m)^[ \t]*(?:-{3,}|\*{3,}|#{3,}|~{3,}|/{3,}|_{3,}|[\x{2014}\x{2015}\x{2E3B}]+)[ \t]*$"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\x{20E3}]+"
ACTION = (
    r"(?i)(^|[.!?\n])\s*[^.!?\n]*\b(?:why\s+join\s+us\??|why\s+you\s+(?:should|sould)\s+join\s+us\??|"
    r"(?:apply|appy)\s+and\s+join\s+us|so\s+join\s+us|join\s+us|want\s+to\s+join\s+us\??|"
    r"contact\s+us(?:\s+at)?|apply\s+now|apply\s+today|apply\s+here)"
    r"(?:[ \t\r\f\vA-Za-z\-][^.!?\n]*)?[.!?\n]"
)
ENTITY = r"&(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);"
FORMATTING = r"\*\*[^*]+\*\*|__[^_]+__|`[^`]+`"

ENTITIES = {"&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&copy;?": "\u00a9", "&middot;?": "\u00b7", "&amp;?": "&"}


def unescape(x: str) -> str:
    """The entities that occur in the tables; cut-off ones lack the semicolon."""
    for entity, char in ENTITIES.items():
        x = sub(x, entity, char)
    return x


STEPS = {
    "c02_markdown_links": lambda x: sub(x, LINK, r"\1"),
    "c03_urls": lambda x: sub(x, URL, " "),
    "c04_html_tags": lambda x: sub(x, TAG, " "),
    "c05_bold": lambda x: sub(x, BOLD, r"\1"),
    "c06_underscore": lambda x: sub(x, UNDER, r"\1"),
    "c07_inline_code": lambda x: sub(x, CODE, r"\1"),
    "c08_emails": lambda x: sub(x, EMAIL, " "),
    "c09_phones": lambda x: fenced(x, PHONE, " "),
    "c10_partial_urls": lambda x: sub(x, PARTIAL, " "),
    "c11_asterisks": lambda x: sub(x, STARS, " "),
    "c12_redacted": lambda x: fenced(x, REDACTED, " "),
    "c13_empty_wrappers": lambda x: sub(x, WRAPPER, " "),
    "c14_gender_markers": lambda x: fenced(x, GENDER, " "),
    "c15_quotes": lambda x: fenced(x, QUOTE, ""),
    "c16_separator_lines": lambda x: sub(x, SEPARATOR, ""),
    "c17_emoji": lambda x: sub(x, EMOJI, " "),
    "c18_call_to_action": lambda x: fenced(x, ACTION, r"\1"),
    "c19_blanks": lambda x: sub(x, r"[ \t]+", " "),
    "c20_newline_spacing": lambda x: f"regexp_replace({x}, ' *\\n *', chr(10), 'g')",
    "c21_newlines": lambda x: f"regexp_replace({x}, '\\n+', chr(10), 'g')",
    "c22_newline_to_period": lambda x: sub(x, r"(^|[^.!?,:;])\n", r"\1. "),
    "c23_strip": strip,
}


def clean(cte_in: str, column: str, keep: str, name: str = "c") -> str:
    """CTEs ``{name}0 .. {name}22`` applying entity decoding and all steps in order.

    Each step is a materialised CTE: nesting them would repeat the text.
    """
    out = [f"{name}0 AS MATERIALIZED (SELECT {keep}, {unescape(column)} AS x FROM {cte_in})"]
    for i, step in enumerate(STEPS.values(), start=1):
        out.append(f"{name}{i} AS MATERIALIZED (SELECT {keep}, {step('x')} AS x FROM {name}{i - 1})")
    return ",\n".join(out)


LAST = len(STEPS)

FLAGS = {
    "html_tags": lambda x: f"regexp_matches({x}, {lit(TAG)})",
    "html_entities": lambda x: f"regexp_matches({x}, {lit(ENTITY)})",
    "markdown_links": lambda x: f"regexp_matches({x}, {lit(LINK)})",
    "markdown_formatting": lambda x: f"regexp_matches({x}, {lit(FORMATTING)})",
    "urls": lambda x: f"regexp_matches({x}, {lit(URL)})",
    "broken_or_partial_urls": lambda x: f"regexp_matches({x}, {lit(PARTIAL)})",
    "email_addresses": lambda x: f"regexp_matches({x}, {lit(EMAIL)})",
    "phone_numbers": lambda x: f"regexp_matches({fence(x)}, {lit(PHONE)})",
    "asterisk_clusters": lambda x: f"regexp_matches({x}, {lit(STARS)})",
    "redacted_placeholders": lambda x: f"regexp_matches({fence(x)}, {lit(REDACTED)})",
    "gender_markers": lambda x: f"regexp_matches({fence(x)}, {lit(GENDER)})",
    "quote_characters": lambda x: f"regexp_matches({fence(x)}, {lit(QUOTE)})",
    "decorative_separators": lambda x: f"regexp_matches({x}, {lit(SEPARATOR)})",
}
FLAG_LABELS = {
    "html_tags": "HTML tags", "html_entities": "HTML entities", "markdown_links": "Markdown links",
    "markdown_formatting": "Markdown formatting", "urls": "URLs",
    "broken_or_partial_urls": "Broken or partial URLs", "email_addresses": "Email addresses",
    "phone_numbers": "Phone numbers", "asterisk_clusters": "Asterisk clusters",
    "redacted_placeholders": "Redacted placeholders", "gender_markers": "Gender markers",
    "quote_characters": "Quote characters", "decorative_separators": "Decorative separators",
}


def flag_columns(x: str) -> str:
    return ", ".join(f"{f(x)} AS {name}" for name, f in FLAGS.items())


ANY_FLAG = "(" + " OR ".join(FLAGS) + ")"

HEADING = (
    r"(?i)\b(?:about\s+us|who\s+are\s+we|company\s+description|job\s+description|responsibilities?|requirements?|"
    r"qualifications?|benefits?|what\s+we\s+offer|our\s+mission|our\s+values|how\s+to\s+apply|application\s+process|"
    r"to\s+apply|recruitment\s+process|selection\s+process|our\s+selection\s+process|additional\s+information|"
    r"profile\s+sought|desired\s+profile)\b\s*[:.]"
)
CATEGORY_PATTERNS = {
    "Company intro heading": r"(?i)^\s*(?:who\s+are\s+we\??|about\s+us|company\s+description)\s*[:.!?]*\s*$",
    "Equal opportunity / anti-discrimination": (
        r"(?i)\b(?:equal\s+opportunit(?:y|ies)|non[- ]?discrimination|diversity\s+and\s+inclusion|"
        r"all\s+qualified\s+applicants|regardless\s+of\s+(?:age|gender|race|ethnicity|religion|disability|"
        r"sexual\s+orientation|nationality)|both\s+sexes|all\s+ages\s+and\s+all\s+nationalities|protected\s+veteran)\b"
    ),
    "GDPR/privacy/legal disclaimer": (
        r"(?i)\b(?:gdpr|data\s+protection|privacy\s+policy|processing\s+of\s+personal\s+data|art\.?\s*13\b|"
        r"regulation\s*\(?\s*(?:eu\s*)?2016\s*/\s*679\s*\)?|cookie(?:s)?)\b"
    ),
    "Application process boilerplate": (
        r"(?i)\b(?:apply\s+now|how\s+to\s+apply|application\s+process|recruitment\s+process|"
        r"selection\s+process|our\s+selection\s+process|submit\s+your\s+application|"
        r"click\s+(?:on\s+)?(?:the\s+)?apply|interview\s+process|interview\s+rounds?|"
        r"to\s+apply|please\s+submit\s+your\s+cv|please\s+send\s+(?:through\s+)?(?:an\s+updated\s+)?cv|"
        r"send\s+your\s+cv|send\s+us\s+your\s+application|if\s+you\s+are\s+(?:suitable\s+and\s+)?interested|"
        r"please\s+visit\s+our\s+website|visit\s+our\s+website|for\s+more\s+information\s+please\s+contact|"
        r"please\s+contact\s+your\s+recruiting\s+partner|"
        r"please\s+get\s+in\s+touch\s+with\s+the\s+person\s+responsible|"
        r"if\s+this\s+is\s+an\s+interest\s+please\s+reach\s+out\s+to\s+me\s+on\s+the\s+below\s+details|"
        r"please\s+contact\s+us\s+as\s+soon\s+as\s+possible|"
        r"please\s+see\s+below\s+for\s+what\s+we're\s+looking\s+for|"
        r"what\s+are\s+you\s+waiting\s+for\??\s*join\s+us|thank\s+you\s*!?)\b"
    ),
    "Recruiter contact block": (
        r"(?i)\b(?:contact\s+person|your\s+contact|for\s+more\s+information(?:,)?\s+please\s+contact|"
        r"please\s+contact|reach\s+out\s+to|recruit(?:ing|er)?\s+partner)\b.*"
        r"(?:@|linkedin|tel(?:ephone)?|phone|\+?\d[\d\s().\-]{6,}|cv|resume)"
    ),
    "Company marketing paragraph": (
        r"(?i)\b(?:about\s+us|who\s+are\s+we|our\s+mission|our\s+values|founded\s+in\s+\d{4}|"
        r"we\s+are\s+(?:a|an|the)\s+(?:leading|global|world\s+leader)|"
        r"with\s+over\s+\d[\d,.\s]*(?:employees|people|professionals)|great\s+place\s+to\s+work|"
        r"join\s+our\s+team|join\s+us|make\s+an\s+impact)\b"
    ),
}


def blocks(x: str) -> str:
    """List of blocks of a text."""
    unix = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    text = f"regexp_replace({unix}, {lit('(?i)(' + HEADING[4:] + ')')}, chr(10) || '\\1', 'g')"
    line = strip(f"regexp_replace({strip('l')}, '^\\s*[-*]\\s+', '')")
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {line}), lambda l: l <> '')"
    bullets = r"'\s*[\x{2022}\x{25CF}\x{25AA}\x{25E6}\x{25C9}]\s*'"
    parts = f"list_filter(list_transform(string_split_regex(y, {bullets}), lambda z: {strip('z')}), lambda z: z <> '')"
    return f"flatten(list_transform({lines}, lambda y: {parts}))"


def category(b: str) -> str:
    whens = []
    for label, pattern in CATEGORY_PATTERNS.items():
        test = f"regexp_matches({fence(b)}, {lit(pattern)})"
        if label == "Company marketing paragraph":
            test = f"length({b}) >= 120 AND {test}"
        whens.append(f"WHEN {test} THEN {lit(label)}")
    return "CASE " + " ".join(whens) + " END"
