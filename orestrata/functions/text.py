"""Scalar text functions as Columns: tokens, composition, caps, snippets, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: White space as Unicode knows it, for Java's engine.
SPACE = r"(?U)\s+"


def lit_strings(values) -> Column:
    """An array literal of strings, also where there is none."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits in order; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def surface(columns: list[str]) -> Column:
    """The search surface: the columns joined by a space, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode knows it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sorted_distinct(values: Column) -> Column:
    """Values of an array without null and blank ones, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (strip(v) != ""))))


def split_list(text: Column, pattern: str = ",") -> Column:
    """Trimmed non-empty parts in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(F.split(text, pattern), strip), lambda v: v != ""))


def list_blob(text: Column, cap: int = 20_000) -> Column:
    """A comma list as one ``a | b`` text, cut at ``cap`` characters."""
    return F.left(F.array_join(split_list(text), " | "), F.lit(cap))


def labelled(parts: list[tuple[str, Column]]) -> Column:
    """``Label: value`` lines of the parts that hold something."""
    lines = [F.when(strip(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), v)) for label, v in parts]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def cap_text(text: Column, limit: int) -> tuple[Column, Column]:
    """(cut text, whether it was cut)."""
    return F.left(text, F.lit(limit)), F.coalesce(F.length(text) > limit, F.lit(False))


def cap_array(values: Column, items: int = 100, chars: int = 256) -> tuple[Column, Column]:
    """(at most ``items`` values of at most ``chars`` characters, whether anything was cut)."""
    head = F.slice(values, 1, items)
    cut = (F.size(values) > items) | F.exists(head, lambda v: F.length(v) > chars)
    return F.transform(head, lambda v: F.left(v, F.lit(chars))), F.coalesce(cut, F.lit(False))


def truncated_names(flags: list[tuple[str, Column]]) -> Column:
    """Sorted names of the fields whose flag is set."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags]))))


def snippet(line: Column, query: str, limit: int = 180, lead: int = 70) -> Column:
    """The stretch around the first literal match, white space collapsed, with ellipses where it is cut."""
    flat = F.trim(F.regexp_replace(line, SPACE, " "))
    at = F.instr(F.lower(flat), query.lower())
    start = F.greatest(F.lit(0), at - 1 - lead)
    body = F.substring(flat, start + 1, F.lit(limit))
    head = F.when(start > 0, F.lit("…")).otherwise(F.lit(""))
    tail = F.when(start + limit < F.length(flat), F.lit("…")).otherwise(F.lit(""))
    return F.concat(head, body, tail)


def accession_number(key: Column) -> Column:
    """The number of an accession, null if it has none; sorts accessions as numbers."""
    return F.nullif(F.regexp_extract(key, r"^[A-Za-z]+(\d{1,18})$", 1), F.lit("")).try_cast("long")


def storage_bucket(key: Column) -> Column:
    """The storage folder of a key: all digits but the last three, then ``nnn``."""
    digits = F.regexp_extract(key, r"(\d+)$", 1)
    return F.concat(F.lit("GSE"), F.when(F.length(digits) > 3, F.substring(digits, F.lit(1), F.length(digits) - 3)).otherwise(F.lit("")), F.lit("nnn"))


def capitalized(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, F.lit(2), F.length(text))))


def blank_to_null(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; blank becomes null."""
    return F.nullif(F.left(F.coalesce(text, F.lit("")), F.lit(limit)), F.lit(""))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def token_bound(text: Column) -> Column:
    """Upper bound of a text's tokens: its UTF-8 bytes, at least 1."""
    return F.greatest(F.lit(1), F.octet_length(F.coalesce(text, F.lit(""))))


def backoff_seconds(attempt: Column, base: float = 30.0, most: float = 300.0) -> Column:
    """Seconds to wait before a further attempt: doubling from ``base``, at most ``most``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)), F.lit(most))


# Names, after lower-casing and with underscores for hyphens, whose values are secret, and how secrets stand in text.
SECRET_KEYS = ["access_key_id", "api_key", "authorization", "cookie", "password", "secret_access_key", "set_cookie"]
BEARER = r"(?i)\bBearer\s+[^\s,;]+"
ASSIGNMENT = (
    r"(?i)\b(authorization|cookie|set-cookie|password|api[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?access[_-]?key)"
    r"(\s*[:=]\s*)(?:\"[^\"]*\"|'[^']*'|[^\s,;]+)")
MASK = "[REDACTED]"
#: What a line must hold for a secret to be in it; the others needn't be parsed.
SUSPECT = r"(?i)bearer|authorization|cookie|password|api[_-]?key|access[_-]?key|\\u00"


def redacted(text: Column) -> Column:
    """Bearer tokens and assigned secrets in free text replaced, quoted values whole."""
    plain = F.regexp_replace(text, BEARER, f"Bearer {MASK}")
    return F.regexp_replace(plain, ASSIGNMENT, f"$1$2{MASK}")


def redacted_value(value):
    """A parsed JSON value with every secret member masked at any depth and the text of all others redacted."""
    import re

    if isinstance(value, dict):
        return {k: MASK if k.strip().casefold().replace("-", "_") in SECRET_KEYS else redacted_value(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted_value(v) for v in value]
    if isinstance(value, str):
        return re.sub(ASSIGNMENT, rf"\g<1>\g<2>{MASK}", re.sub(BEARER, f"Bearer {MASK}", value))
    return value


def redacted_object(line: str) -> str | None:
    """A JSON object redacted throughout, null for anything else."""
    import json

    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return json.dumps(redacted_value(value), ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None
