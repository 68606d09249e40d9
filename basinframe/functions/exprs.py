"""Pure Column functions. Each keeps the raw value reachable: a function that cannot tell returns null, never a guess."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels and tokens that stand for "no value" in the source formats.
FLOAT_MAX = 3.4028234663852886e38
UNKNOWN_TOKENS = ("", "unknown", "unresolved", "not_decoded", "not_resolved", "not_available", "not_established", "not established", "unspecified")
UNKNOWN_PREFIXES = ("unresolved;", "unresolved:", "not_resolved_", "not_available_", "not_decoded_")
LAS_NULL = -999.25
ZMAP_NULL = -1e30


def finite(v: Column) -> Column:
    """True for numbers; false for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(math.inf)), F.lit(False))


def is_sentinel(v: Column, sentinel: float = FLOAT_MAX, relative: float = 1e-12) -> Column:
    """Equal to the sentinel in size, within a relative tolerance (0: exactly)."""
    a = F.abs(v)
    return finite(v) & F.coalesce(F.abs(a - sentinel) <= F.greatest(a, F.lit(sentinel)) * relative, F.lit(False))


def without_sentinel(v: Column, sentinel: float = FLOAT_MAX, relative: float = 1e-12) -> Column:
    return F.when(~is_sentinel(v, sentinel, relative), v)


def plausible(v: Column, most: float = 1e15) -> Column:
    return finite(v) & (F.abs(v) <= most)


def number_or_null(text: Column) -> Column:
    """A finite number that a text spells, else null."""
    v = text.try_cast("double")
    return F.when(finite(v), v)


def exact_integer(v: Column, tolerance: float = 1e-6) -> Column:
    """The integer that a number is within the tolerance of, else null."""
    return F.when(finite(v) & (F.abs(v - F.rint(v)) <= tolerance) & (F.abs(v) < 9.2e18), F.rint(v).cast("long"))


def known(text: Column) -> Column:
    """Whether a metadata text says something: it is neither one of the fixed tokens nor begins with one of the fixed prefixes."""
    low = F.lower(F.trim(text))
    vague = low.isin(*UNKNOWN_TOKENS)
    for p in UNKNOWN_PREFIXES:
        vague = vague | low.startswith(p)
    return F.coalesce(~vague, F.lit(False))


def exact_sum(v: Column, places: int = 6) -> Column:
    """A sum that does not depend on the order of the rows: decimals of so many places. If a value does not fit, the sum of doubles."""
    fixed = v.try_cast(f"decimal(18,{places})")
    return F.when(F.count(fixed) == F.count(v), F.sum(fixed).cast("double")).otherwise(F.sum(v))


def exact_mean(v: Column, places: int = 6) -> Column:
    return exact_sum(v, places) / F.count(v)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised_name(text: Column) -> Column:
    """For fuzzy matching: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


# What counts as an identifier, a path, an address, a number and a secret.
OBJECT = r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}"
QUOTED_PATH = r"""["'][A-Za-z]:[\\/][^"'\r\n]*["']"""
BARE_PATH = r"(?i)(?:[a-z]:[\\/]|\\\\)[^\s,;\r\n]+"
HEX_NUMBER, DECIMAL_NUMBER = r"\b0x[0-9a-fA-F]+\b", r"\b\d+\b"
WHOLE_OBJECT = r"(?i)\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b"
PRIVATE_PATH = r"""(?i)(?:[a-z]:[\\/]|\\\\)[^\s<>"'|,;]+"""
EMAIL = r"(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}"
URL = r"""(?i)https?://[^\s<>"']+"""
SECRET = r"(?i)\b(password|passwd|secret|token|authorization|api[_-]?key)(\s*[=:]\s*)[^\s,;]+"


def normalised_reason(text: Column, most: int = 2000) -> Column:
    """An error text with identifiers, paths, hexadecimal and decimal numbers replaced by their kind, on one line, and cut to a length."""
    out = F.regexp_replace(text, OBJECT, "<object>")
    out = F.regexp_replace(out, QUOTED_PATH, "<path>")
    out = F.regexp_replace(out, BARE_PATH, "<path>")
    out = F.regexp_replace(out, HEX_NUMBER, "<hex>")
    out = F.regexp_replace(out, DECIMAL_NUMBER, "<n>")
    return F.left(collapsed(out), F.lit(most))


def tokenised(text: Column, pattern: str, kind: str, salt: str) -> Column:
    """A text in which each match is a pseudonym of its kind: the same match, the same pseudonym."""
    token = lambda m: F.concat(F.lit(f"<{kind}:"), pseudonym(m, salt, 8), F.lit(">"))

    def told(t: Column) -> Column:
        matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pieces = F.zip_with(F.split(t, pattern, -1), matches, lambda p, m: F.concat(p, F.coalesce(token(m), F.lit(""))))
        return F.array_join(pieces, "")

    # the text as a variable, since it is used twice: what it is made of would be evaluated twice, and with each further kind twice as often
    return F.get(F.transform(F.array(text), told), F.lit(0))


def scrubbed(text: Column, salt: str) -> Column:
    """A text whose identifiers, paths, mail addresses and urls are pseudonyms under a salt, and whose secrets are redacted."""
    out = text
    for kind, pattern in (("object", WHOLE_OBJECT), ("path", PRIVATE_PATH), ("email", EMAIL), ("url", URL)):
        out = tokenised(out, pattern, kind, salt)
    return F.regexp_replace(out, SECRET, "$1$2[redacted]")


def pseudonym(text: Column, salt: str, digits: int = 12) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, digits)


def signature(*columns: Column, digits: int = 20) -> Column:
    """The head of a hash of ordered values; nulls count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def csv_safe(text: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def rotated(x0: Column, y0: Column, dx: Column, dy: Column, i: Column, j: Column, degrees: float) -> tuple[Column, Column]:
    """World coordinates of lattice node (i, j)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x0 + i * dx * c - j * dy * s, y0 + i * dx * s + j * dy * c


def distance(*pairs: tuple[Column, Column]) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def histogram_bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """0 to bins - 1; the last bin is closed, and an empty range is widened by half on either side."""
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - lo) / ((hi - lo) / bins)).cast("int")))


def size_bin(n: Column) -> Column:
    return (
        F.when(n < 1000, "small").when(n < 100_000, "medium").when(n.isNotNull(), "large").otherwise("unknown")
    )


def format_signature(content: Column) -> Column:
    """What a file's first bytes say it is."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "EMPTY")
        .when(head.startswith("53514C69746520666F726D6174203300"), "SQLITE")
        .when(head.startswith("3C3F786D6C"), "XML")
        .when(head.startswith("42584D4C"), "BXML")
        .when(head.startswith("4C5A34"), "LZ4")
        .when(head.startswith("56425300"), "ZGY")
        .when(head.startswith("89504E47"), "PNG")
        .otherwise("BINARY")
    )


def bit(mask: Column, n: Column) -> Column:
    """Bit n of a binary mask, the least significant of each byte first."""
    byte = F.conv(F.hex(F.substring(mask, F.floor(n / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(n, F.lit(8)).cast("int")) == 1
