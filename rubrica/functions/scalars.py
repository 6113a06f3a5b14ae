"""Scalar functions of the rules: titles, dates, hashes, delays, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.normalize import strip

# Date formats, in order of trial.
DATE_FORMATS = ["yyyy-M-d", "d-M-yyyy", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d MMMM yyyy", "MMMM d, yyyy"]
# Delay patterns of the two providers, first match wins.
PRIMARY_DELAYS = [r"retry_delay\s*\{\s*seconds:\s*(\d+)", r"retry in (\d+\.?\d*)\s*s", r"wait (\d+\.?\d*)\s*seconds?", r"retry after (\d+\.?\d*)\s*s"]
FALLBACK_DELAYS = [r"try again in (\d+\.?\d*)\s*s", r"retry in (\d+\.?\d*)\s*s", r"wait (\d+\.?\d*)\s*seconds?", r"retry after (\d+\.?\d*)\s*s", r"(\d+\.?\d*)\s*seconds?"]
# Marks of a rate-limit error of the two providers.
PRIMARY_MARKS = ["429", "quota", "rate limit", "retry", "resource_exhausted"]
FALLBACK_MARKS = ["429", "quota", "rate limit", "rate_limit_exceeded", "retry"]
# Patterns of personal names.
NAME_PATTERNS = [r"\b(Dr|Prof|Professor|Mr|Mrs|Ms|Miss)\.?\s+[A-Z][a-z]+", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+"]
# Audit messages of a title, by whether it is the canonical one.
TITLE_MESSAGES = {
    True: 'Content does not match canonical event title. Expected: "%s". Observed: "%s". Reason: %s',
    False: 'Title/Objectives/Learning do not align with theme: %s. Observed: "%s". Reason: %s',
}


def unicode_pattern(pattern: str, before: str = r"(?<![\p{L}\p{N}_])") -> str:
    r"""A pattern with Python's \b before a letter and Python's \s, which Java and RE2 take as ASCII only."""
    return pattern.replace(r"\b", before).replace(r"\s", r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]")


def has_name(c: Column) -> Column:
    return c.rlike("|".join(map(unicode_pattern, NAME_PATTERNS)))


def canonical_title(event_type: Column, theme: Column) -> Column:
    """Level mark, category and theme of an event, joined by ' - '."""
    after = F.get(F.split(event_type, "Level"), F.lit(1))  # up to the next "Level"
    token = F.regexp_extract(strip(after), r"^(\S+)", 1)
    level = F.when(token != "", F.concat(F.lit("Level "), token))
    category = F.when(event_type.contains("-"), strip(F.regexp_extract(event_type, r"(?s)^[^-]*-(.*)$", 1))).otherwise(event_type)
    return F.concat_ws(" - ", level, category, F.when(theme != "", F.concat(F.lit("on "), theme)))


def is_canonical(event_driven: Column) -> Column:
    return F.coalesce(event_driven.isin(1, 2, 4), F.lit(False))


def expected_title(canonical: Column, event_type: Column, theme: Column, title: Column) -> Column:
    return F.when(canonical, canonical_title(event_type, theme)).otherwise(title)


def title_message(canonical: Column, expected: Column, observed: Column, reason: Column) -> Column:
    seen = F.when(observed.isNull() | (observed == ""), "Not provided").otherwise(observed)
    return F.when(canonical, F.format_string(TITLE_MESSAGES[True], expected, seen, reason)).otherwise(F.format_string(TITLE_MESSAGES[False], expected, seen, reason))


def parse_date(c: Column) -> Column:
    """A date in the first format that fits; names of months in any case."""
    text = strip(c)
    return F.coalesce(*[F.try_to_timestamp(F.initcap(text) if "MMMM" in f else text, F.lit(f)).cast("date") for f in DATE_FORMATS])


def fiscal_year(d: Column) -> Column:
    return F.year(d) - (F.month(d) < 4).cast("int")


def stamp(ts: Column) -> Column:
    """YYYYmmdd_HHMMSS, as in file names."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def retry_delay(message: Column, fallback: bool = False) -> Column:
    found = [F.regexp_extract(message, f"(?i){p}", 1) for p in (FALLBACK_DELAYS if fallback else PRIMARY_DELAYS)]
    delay = F.coalesce(*[F.when(x != "", x) for x in found]).try_cast("double")
    return delay + 0.5 if fallback else delay


def is_rate_limit(message: Column, fallback: bool = False) -> Column:
    return F.lower(message).rlike("|".join(FALLBACK_MARKS if fallback else PRIMARY_MARKS))


def backoff(message: Column, attempt: Column, fallback: bool = False) -> Column:
    """Seconds to wait after an error: 1 unless it is a rate limit; the named delay (of the first provider
    5 at least), else 2 * 2**attempt up to 60."""
    named = retry_delay(message, fallback)
    limited = F.when(named > 0, named if fallback else F.greatest(named, F.lit(5.0))).otherwise(F.least(2 * F.pow(F.lit(2.0), attempt), F.lit(60.0)))
    return F.when(is_rate_limit(message, fallback), limited).otherwise(F.lit(1.0))


def hash_bits(c: Column) -> Column:
    """The 64 bits of a hash of 16 lower-case hexadecimal characters; null for another one."""
    return F.when(c.rlike("^[0-9a-f]{16}$"), F.conv(c, 16, -10).try_cast("bigint"))


def unequal_nibbles(a: Column, b: Column) -> Column:
    """Differing hexadecimal characters of two 64-bit hashes, by bit operations."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two hashes; null for unequal lengths."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    slow = F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    x, y = hash_bits(a), hash_bits(b)
    return F.when(x.isNotNull() & y.isNotNull(), unequal_nibbles(x, y)).when(F.length(a) == F.length(b), slow)


def token_estimate(prompt: Column, images: Column | None = None) -> Column:
    base = F.floor(F.length(prompt) / 4).cast("int")
    return base if images is None else base + 1000 * images


def cache_key(model: Column, prompt: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, prompt, content), 256)


def base64_text(content: Column) -> Column:
    """Base64 on one line: Spark breaks it every 76 characters."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def safe_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")


def download_name(url: Column) -> Column:
    """The last part of a URL's path, else the first 8 characters of its md5."""
    last = F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"([^/]+)/*$", 1)
    return F.when(last != "", last).otherwise(F.substring(F.md5(url), 1, 8))


def pdf_title(meta: Column, body: Column) -> Column:
    named = [F.try_element_at(meta, F.lit(k)) for k in ("/Title", "Title", "title")]
    line = strip(F.substring_index(body, "\n", 1))
    return F.coalesce(*[F.when(x != "", x) for x in named], F.when(F.length(line).between(6, 199), line))
