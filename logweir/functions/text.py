"""Severity, redaction, templates and display forms of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity spellings and their canonical level.
SEVERITY_LEVELS = {
    "FATAL": ["FATAL", "CRITICAL", "EMERGENCY", "EMERG"],
    "ERROR": ["ERROR", "ERR"],
    "WARNING": ["WARNING", "WARN"],
    "INFO": ["INFO", "INFORMATION", ""],
    "DEBUG": ["DEBUG", "TRACE"],
}
SEVERITY_ORDER = ["FATAL", "ERROR", "WARNING", "INFO", "DEBUG"]
ERROR_SEVERITIES = ["ERROR", "FATAL", "CRITICAL"]

# Every character Unicode calls white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

REDACTED = "[REDACTED]"

# The patterns are meant for ASCII word boundaries, ASCII blanks and Unicode case
# folding. Java's \b and \s differ from that, so both are spelled out; next to
# a digit a boundary is just the absence of another word character.
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_START = f"(?=[0-9])(?<!{_WORD})"
_END = f"(?!{_WORD})"
_BLANK = r"[\t\n\f\r ]*"

# Secrets in messages, replaced in this order. The odd class
# [A-Z|a-z] is intended: it admits a bar in the last label.
SECRET_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey", "authorization"]
ASSIGNED_SECRET = (
    "(?iu)(?:" + "|".join(SECRET_WORDS) + ")" + _BLANK + "[:=]" + _BLANK + r"[^\t\n\f\r ]+"
)
MAIL_ADDRESS = _EDGE + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + _EDGE
CARD_NUMBER = _START + "(?:[0-9]{4}[- ]?){3}[0-9]{4}" + _END

# Variable parts of a message, replaced in this order.
TEMPLATE_PATTERNS = [
    ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>"),
    ("[0-9a-f]{8,}", "<HEX>"),
    (_START + "[0-9]++" + _END, "<N>"),
]


def normalize_severity(severity: Column) -> Column:
    upper = F.upper(F.btrim(F.coalesce(severity, F.lit("")), F.lit(WHITESPACE)))
    level = upper
    for name, spellings in SEVERITY_LEVELS.items():
        level = F.when(upper.isin(spellings), F.lit(name)).otherwise(level)
    return level


def is_error(severity: Column) -> Column:
    """Error class used by detection and summaries: exact, case-sensitive."""
    return severity.isin(ERROR_SEVERITIES)


def redact_secrets(message: Column) -> Column:
    """Replace assigned secrets, mail addresses and card numbers.

    A plain search for what a pattern cannot do without comes first: it is far
    cheaper than a regex that tries every position of a text in vain.
    """
    folded = F.lower(F.replace(message, F.lit("\u017f"), F.lit("s")))
    has_word = F.contains(folded, F.lit(SECRET_WORDS[0]))
    for word in SECRET_WORDS[1:]:
        has_word = has_word | F.contains(folded, F.lit(word))
    assigned = F.regexp_replace(message, ASSIGNED_SECRET, REDACTED)
    clean = F.when(has_word, assigned).otherwise(message)
    has_at = F.contains(message, F.lit("@"))
    clean = F.when(has_at, F.regexp_replace(clean, MAIL_ADDRESS, REDACTED)).otherwise(clean)
    return F.regexp_replace(clean, CARD_NUMBER, REDACTED)


def message_template(message: Column) -> Column:
    for pattern, mark in TEMPLATE_PATTERNS:
        message = F.regexp_replace(message, pattern, mark)
    return message


def fingerprint(service: Column, template: Column) -> Column:
    return F.concat(service, F.lit(":"), F.md5(template))


def partition_key(service: Column, source: Column) -> Column:
    has_source = F.coalesce(source, F.lit("")) != ""
    return F.when(has_source, F.concat(service, F.lit(":"), source)).otherwise(service)


def message_preview(message: Column, length: int = 120) -> Column:
    cut = F.concat(F.substring(message, 1, length), F.lit("..."))
    return F.when(F.length(message) > length, cut).otherwise(message)


def trace_preview(trace_id: Column, length: int = 12) -> Column:
    missing = F.coalesce(trace_id, F.lit("")) == ""
    cut = F.concat(F.substring(trace_id, 1, length), F.lit("..."))
    return F.when(missing, F.lit("-")).otherwise(cut)


def fixed2(value: Column) -> Column:
    """Text of a value in [0, 2^50) with two decimals, as C's %.2f prints it.

    format_string() rounds the shortest decimal form half up, which differs from
    rounding the binary value when that is, say, 15.625.
    """
    scale = 1 << 53
    whole = F.floor(value).cast("bigint")
    part = (value - whole) * F.lit(float(scale))
    tail = (part - F.floor(part)) * F.lit(100.0)
    bits = F.floor(part) * F.lit(100) + F.floor(tail)
    down = F.shiftright(bits, 53)
    rest = bits.bitwiseAND(F.lit(scale - 1))
    half = F.lit(scale >> 1)
    tie = (rest == half) & (tail == F.floor(tail))
    up = (rest > half) | ((rest == half) & ~tie) | (tie & (down % 2 == 1))
    cents = whole * 100 + down + up.cast("bigint")
    return F.concat(
        F.floor(cents / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
