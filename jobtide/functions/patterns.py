"""Regular expressions as fixed values, in the regex dialect of the JVM.

Flags: ``i`` ignore case, ``U`` Unicode character classes, ``d`` only line feed
ends a line, ``m`` anchors match at lines. ``WORD`` is a letter, digit or
underscore; it is spelled out because the JVM's Unicode ``\\w`` also takes
combining marks.

Some patterns start with a lookahead for their first character. It changes no
match; it lets the matcher pass over other characters without trying the rest.
"""

WORD = r"[\p{L}\p{N}_]"

# --- fixed values: markup and contact details ------------------------------
HTML_TAG = r"<[^>]+>"
HTML_ENTITY = r"&(?:[a-zA-Z]+|#\p{Nd}+|#x[0-9a-fA-F]+);"
MARKDOWN_LINK = r"\[([^\]]+)\]\([^)]+\)"
MARKDOWN_BOLD = r"\*\*([^*]+)\*\*"
MARKDOWN_UNDERSCORE = r"__([^_]+)__"
INLINE_CODE = r"`([^`]+)`"
MARKDOWN_FORMATTING = r"(?=[*_`])(?:\*\*[^*]+\*\*|__[^_]+__|`[^`]+`)"
RAW_URL = r"""(?iU)(?=[hw])(?:https?\s*[:\-]\s*/\s*/\s*|www\.)[^\s<>()\[\]{}"']+"""
PARTIAL_URL = (
    r"""(?iU)(?=[hw.])(?:https?://\s*)?(?:www\.\s*)?\.[a-z0-9-]+(?:\.[a-z0-9-]+)+"""
    r"""(?:/[^\s)\]}">']*)?(?:\?[^\s)\]}">']*)?"""
)
EMAIL = r"(?iU)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
PHONE = rf"(?U)(?<!{WORD})\+?\d[\d\s().\-]{{7,}}\d(?!{WORD})"
ASTERISKS = r"\*{2,}"
REDACTED = rf"(?=\*)(?<!{WORD})\*{{3,}}(?!{WORD})"
EMPTY_WRAPPER = r"(?U)(?=[(\[{])(?:\(\s*\)|\[\s*\]|\{\s*\})"
GENDER_MARKER = (
    rf"(?iU)(?<!{WORD})[(\[]?\s*[mfwxdh]\s*(?:[/|\\\-]?\s*[mfwxdh]\s*){{1,2}}[)\]]?(?!{WORD})"
)
QUOTE = rf"""(?=["'\\])(?:\\"|"|(?<!{WORD})'|'(?!{WORD}))"""
SEPARATOR_LINE = (
    r"(?md)^[ \t]*(?:-{3,}|\*{3,}|#{3,}|~{3,}|/{3,}|_{3,}|[—―⸻]+)[ \t]*$"
)
EMOJI = (
    r"(?=[\x{200D}-\x{1FAFF}])"
    r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}"
    r"\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}"
    r"\x{1FA00}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{FE0F}\x{200D}\x{20E3}]+"
)
BLANKS = r"[ \t]+"
NEWLINE_SPACING = r" *\n *"
NEWLINES = r"\n+"
OPEN_NEWLINE = r"(?<![.!?,:;])\n"

# --- fixed values: call-to-action sentences --------------------------------
CALL_TO_ACTION = (
    r"(?iUd)(^|[.!?\n])\s*[^.!?\n]*\b(?=[acjsw])(?:"
    r"why\s+join\s+us\??|why\s+you\s+(?:should|sould)\s+join\s+us\??|"
    r"(?:apply|appy)\s+and\s+join\s+us|so\s+join\s+us|join\s+us|"
    r"want\s+to\s+join\s+us\??|contact\s+us(?:\s+at)?|"
    r"apply\s+now|apply\s+today|apply\s+here"
    r")(?=\s|$|[.!?\-]|[A-Z])[^.!?\n]*[.!?\n]"
)
# Every call-to-action sentence holds one of these.
CALL_TO_ACTION_HINT = r"(?iU)(?=[jca])(?:join\s+us|contact\s+us|apply\s+(?:now|today|here))"

# --- fixed values: block segmentation --------------------------------------
SECTION_HEADING = (
    r"(?iU)\b(?=[abcdhjopqrstw])(?:about\s+us|who\s+are\s+we|company\s+description|job\s+description|"
    r"responsibilities?|requirements?|qualifications?|benefits?|what\s+we\s+offer|"
    r"our\s+mission|our\s+values|how\s+to\s+apply|application\s+process|to\s+apply|"
    r"recruitment\s+process|selection\s+process|our\s+selection\s+process|"
    r"additional\s+information|profile\s+sought|desired\s+profile)\b\s*[:.]"
)
BULLET = r"(?U)\s*[•●▪◦◉]\s*"
DASH_BULLET = r"(?U)^\s*[-*]\s+"

# --- fixed values: boilerplate blocks, first match wins --------------------
BLOCK_CATEGORIES = {
    "Company intro heading": (
        r"(?iUd)^\s*(?:who\s+are\s+we\??|about\s+us|company\s+description)\s*[:.!?]*\s*$"
    ),
    "Equal opportunity / anti-discrimination": (
        r"(?iU)\b(?=[adenprb])(?:equal\s+opportunit(?:y|ies)|non[- ]?discrimination|"
        r"diversity\s+and\s+inclusion|all\s+qualified\s+applicants|"
        r"regardless\s+of\s+(?:age|gender|race|ethnicity|religion|disability|"
        r"sexual\s+orientation|nationality)|"
        r"both\s+sexes|all\s+ages\s+and\s+all\s+nationalities|protected\s+veteran)\b"
    ),
    "GDPR/privacy/legal disclaimer": (
        r"(?iU)\b(?=[acdgpr])(?:gdpr|data\s+protection|privacy\s+policy|"
        r"processing\s+of\s+personal\s+data|art\.?\s*13\b|"
        r"regulation\s*\(?\s*(?:eu\s*)?2016\s*/\s*679\s*\)?|cookie(?:s)?)\b"
    ),
    "Application process boilerplate": (
        r"(?iU)\b(?=[acfhioprstvw])(?:apply\s+now|how\s+to\s+apply|application\s+process|recruitment\s+process|"
        r"selection\s+process|our\s+selection\s+process|submit\s+your\s+application|"
        r"click\s+(?:on\s+)?(?:the\s+)?apply|interview\s+process|interview\s+rounds?|"
        r"to\s+apply|please\s+submit\s+your\s+cv|"
        r"please\s+send\s+(?:through\s+)?(?:an\s+updated\s+)?cv|"
        r"send\s+your\s+cv|send\s+us\s+your\s+application|"
        r"if\s+you\s+are\s+(?:suitable\s+and\s+)?interested|"
        r"please\s+visit\s+our\s+website|visit\s+our\s+website|"
        r"for\s+more\s+information\s+please\s+contact|"
        r"please\s+contact\s+your\s+recruiting\s+partner|"
        r"please\s+get\s+in\s+touch\s+with\s+the\s+person\s+responsible|"
        r"if\s+this\s+is\s+an\s+interest\s+please\s+reach\s+out\s+to\s+me\s+on\s+the\s+below\s+details|"
        r"please\s+contact\s+us\s+as\s+soon\s+as\s+possible|"
        r"please\s+see\s+below\s+for\s+what\s+we're\s+looking\s+for|"
        r"what\s+are\s+you\s+waiting\s+for\??\s*join\s+us|thank\s+you\s*!?)\b"
    ),
    "Recruiter contact block": (
        r"(?iUd)\b(?=[cfpry])(?:contact\s+person|your\s+contact|"
        r"for\s+more\s+information(?:,)?\s+please\s+contact|"
        r"please\s+contact|reach\s+out\s+to|recruit(?:ing|er)?\s+partner)\b.*"
        r"(?:@|linkedin|tel(?:ephone)?|phone|\+?\d[\d\s().\-]{6,}|cv|resume)"
    ),
    "Company marketing paragraph": (
        r"(?iU)\b(?=[afgjmow])(?:about\s+us|who\s+are\s+we|our\s+mission|our\s+values|"
        r"founded\s+in\s+\d{4}|we\s+are\s+(?:a|an|the)\s+(?:leading|global|world\s+leader)|"
        r"with\s+over\s+\d[\d,.\s]*(?:employees|people|professionals)|"
        r"great\s+place\s+to\s+work|join\s+our\s+team|join\s+us|make\s+an\s+impact)\b"
    ),
}
# Shorter blocks are never marketing paragraphs.
MARKETING_MIN_LENGTH = 120

# --- fixed values: derived fields ------------------------------------------
SUPRANATIONAL_REGION = (
    r"(?iU)EMEA|European Union|European Economic Area|Schengen Area|DACH|Benelux|Nordics"
)
LAST_PARENTHETICAL = r"(?Ud)\(([^)]*)\)\s*$"
SKILL_PREFIX = r"(?iUd)^\s*skills:\s*"
SKILL_MORE_SUFFIX = r"(?iUd)\s*,\s*\+\s*\d+\s+more\s*$"
SKILL_PROFILE_MATCH = (
    r"(?iUd)^\s*\d+\s+of\s+\d+\s+skills\s+match\s+your\s+profile\s*-\s*"
    r"you\s+may\s+be\s+a\s+good\s+fit\s*$"
)

# --- fixed values: skill tokens --------------------------------------------
NOISE_TOKEN = (
    r"(?iU)\b\d+\s+of\s+\d+\s+skill\s+matches\s+your\s+profile\b|"
    r"\byou\s+may\s+be\s+a\s+good\s+fit\b"
)
UNICODE_DASH = r"[‐‑‒–—―]"
TRAILING_PARENTHETICAL = r"(?Ud)^(.+?)\s*\(([^()]+)\)\s*$"
NOT_ACRONYM_CHAR = r"[^A-Za-z0-9/+.\-]"
ACRONYM = r"^[A-Za-z0-9/+.\-]{2,12}$"
NOT_SKILL_CHAR = r"[^a-z0-9+.# ]"

# --- fixed values: markup report, in report order --------------------------
MARKUP_LABELS = {
    "HTML tags": HTML_TAG,
    "HTML entities": HTML_ENTITY,
    "Markdown links": MARKDOWN_LINK,
    "Markdown formatting": MARKDOWN_FORMATTING,
    "URLs": RAW_URL,
    "Broken or partial URLs": PARTIAL_URL,
    "Email addresses": EMAIL,
    "Phone numbers": PHONE,
    "Asterisk clusters": ASTERISKS,
    "Redacted placeholders": REDACTED,
    "Gender markers": GENDER_MARKER,
    "Quote characters": QUOTE,
    "Decorative separators": SEPARATOR_LINE,
}
