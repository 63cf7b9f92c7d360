"""Names, postcodes, codes and amounts as native column expressions.

Everything stays inside code generation; nulls count as empty text unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes that are dropped from the end of a name, again and again.
LEGAL_SUFFIXES = (
    "PRIVATE LIMITED COMPANY",
    "PUBLIC LIMITED COMPANY",
    "LIMITED LIABILITY PARTNERSHIP",
    "LIMITED",
    "LTD",
    "PLC",
    "LLP",
    "LP",
    "LLC",
    "CIC",
    "INCORPORATED",
    "INC",
    "CO",
    "COMPANY",
    "IN LIQUIDATION",
    "IN ADMINISTRATION",
)
# Fixed pattern: words after which another name follows.
OTHER_NAME = r"\b(?:T\s*/\s*A|TRADING\s+AS|FORMERLY)\b"


@lru_cache(maxsize=1)
def _ascii_parts() -> tuple[dict[str, str], dict[str, str]]:
    """The ASCII part of each character's compatibility decomposition, where there is one: single characters, and longer parts."""
    found = {chr(p): unicodedata.normalize("NFKD", chr(p)).encode("ascii", "ignore").decode() for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000}
    return {c: a for c, a in found.items() if len(a) == 1}, {c: a for c, a in found.items() if len(a) > 1}


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII; only rows that hold such characters are taken apart."""
    single, longer = _ascii_parts()
    table = F.str_to_map(F.lit("\n".join(map("\t".join, longer.items()))), F.lit("\n"), F.lit("\t"))
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    whole = F.when(text.rlike(f"[{''.join(longer)}]"), spelt).otherwise(text)
    folded = F.regexp_replace(F.translate(whole, "".join(single), "".join(single.values())), r"[^\x00-\x7F]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def normalize_name(raw: Column) -> Column:
    """Upper-case ASCII words without bracketed parts, other names and legal suffixes; may be empty."""
    text = F.replace(F.upper(ascii_fold(F.coalesce(raw, F.lit("")))), F.lit("&"), F.lit(" AND "))
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, f"(?s){OTHER_NAME}.*", "")
    words = F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), words), f"(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def normalize_postcode(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]+", "")


def clean_label(raw: Column) -> Column:
    return F.lower(F.trim(F.coalesce(raw, F.lit(""))))


def clean_company_number(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"\s+", "")


def canon_code(raw: Column) -> Column:
    """Lower-case words of a coded value; an ampersand reads as "and"."""
    text = F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def decoded(raw: Column, values: dict[str, str]) -> Column:
    """The value a code stands for, null for one that isn't listed."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*pairs), canon_code(raw))


def parse_amount(raw: Column) -> Column:
    """A number without pound signs and commas, brackets reading as minus; null where there is none.

    A trailing ``d`` or ``f``, which Spark's cast alone reads as part of a number, is none.
    """
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, "[£,]", ""), r"^\((.*)\)$", "-$1")
    number = F.when(~text.rlike("[dDfF]$") | F.lower(text).rlike("inf$"), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def amount_is_invalid(raw: Column) -> Column:
    """Whether a filled cell holds no number."""
    return (F.trim(F.coalesce(raw.cast("string"), F.lit(""))) != "") & parse_amount(raw).isNull()


def same_text(a: Column, value: str) -> Column:
    """Equality without case and outer blanks; false for a null."""
    return clean_label(a) == value.strip().lower()


def composite_key(*parts: Column, separator: str = "|", missing: str = "missing") -> Column:
    """Parts in text form joined by a separator; a null part reads ``missing``."""
    return F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit(missing)) for p in parts))


def canon_header(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.strip().lower())
