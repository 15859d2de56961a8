"""Scalar normalization as Column functions; Python is used only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of identifiers in source fields.
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
DOI_IN_TEXT = r"(?i)(?:doi:\s*|https?://doi\.org/)(10\.\d{4,9}/\S+)"
ISSN = r"\b\d{4}-\d{3}[\dXx]\b"
ISBN = r"(?<!\d)(?:97[89][\d -]{10,16}|[\dXx][\dXx -]{8,15})(?!\d)"
FULL_DATE = r"^(\d{4}-\d{2}-\d{2})(?:\b|T)"

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean(value: Column) -> Column:
    """Text without white space (of Unicode) at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), _EDGES, "")


def filled(value: Column) -> Column:
    """clean(value), or null if nothing is left."""
    return F.nullif(clean(value), F.lit(""))


# Letters whose folding isn't the lower case of their upper case: the final sigma, and Cherokee, which folds to upper case.
_FOLD_FROM = "\u03c2" + "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_FOLD_TO = "\u03c3" + "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))


def folded(value: Column) -> Column:
    """Case-folded text, as str.casefold gives it: sharp s is ss, the final sigma a sigma.

    Folding is lower, upper and lower case after one another; the dotless i, which would become another letter, is put
    aside meanwhile. (The translations between also keep Spark from taking the inner steps for superfluous.)
    """
    low = F.translate(F.lower(value), "\u0131", "\ue131")
    up = F.translate(F.upper(low), "\ue131", "\ue132")
    return F.translate(F.lower(up), _FOLD_FROM + "\ue132", _FOLD_TO + "\u0131")


def percent_decoded(value: Column) -> Column:
    """Percent escapes decoded as UTF-8; '+' stays and a malformed escape stays as it is."""
    safe = F.regexp_replace(F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.url_decode(safe)


def percent_encoded(value: Column) -> Column:
    """Everything but letters, digits and -._~ as percent escapes of UTF-8."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def doi(value: Column) -> Column:
    """The lower-cased DOI in a field: escapes decoded, a resolver or 'doi:' prefix and marks at the end taken off; else null."""
    bare = clean(F.regexp_replace(percent_decoded(clean(value)), DOI_PREFIX, ""))
    bare = F.regexp_replace(bare, r"[.,;)]+$", "")
    return F.when(bare.startswith("10.") & bare.contains("/"), F.lower(bare))


def item_doi(field: Column, extra: Column) -> Column:
    """doi(field), or of the first DOI that the free text names."""
    return F.coalesce(doi(field), doi(F.nullif(F.regexp_extract(clean(extra), DOI_IN_TEXT, 1), F.lit(""))))


def locator_doi(value: Column) -> Column:
    """The other rule, for whole locators: lower-cased, what follows the first 'doi.org/', no 'doi:'; must be a DOI in full."""
    low = F.regexp_replace(F.lower(clean(value)), "/+$", "")
    low = F.when(low.contains("doi.org/"), F.regexp_replace(low, r"^.*?doi\.org/", "")).otherwise(low)
    low = F.regexp_replace(low, "^doi:", "")
    return F.when(low.rlike(r"^10\.\d{4,9}/\S+$"), low)


def identity_tokens(pid: Column, notations: Column) -> Column:
    """Tokens by which records are matched: 'value:' and the folded text, 'doi:' and the DOI, of pid and notations, each once."""
    values = F.array_union(F.array(pid), F.coalesce(notations, F.array().cast("array<string>")))
    values = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    plain = F.transform(values, lambda v: F.concat(F.lit("value:"), F.regexp_replace(folded(clean(v)), "/+$", "")))
    dois = F.filter(F.transform(values, lambda v: F.concat(F.lit("doi:"), locator_doi(v))), lambda v: v.isNotNull())
    return F.array_distinct(F.concat(plain, dois))


@F.pandas_udf(T.StringType())
def _name_keys(values: pd.Series) -> pd.Series:
    return values.fillna("").map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if c.isalnum()))


def name_key(value: Column) -> Column:
    """NFKD, case-folded, letters and digits only (null is empty): 'Jürgen Straße-1' is 'jurgenstrasse1'."""
    # a filter of keys would otherwise be computed below them, in Python workers of its own
    return _name_keys.asNondeterministic()(value)


def name_key_ascii(value: Column) -> Column:
    """name_key of ASCII text without leaving the JVM."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^0-9a-z]", "")


def label_key(value: Column, prefix: str = "") -> Column:
    """Case-folded, white space as single spaces, without one leading `prefix`."""
    low = F.regexp_replace(folded(clean(value)), r"(?U)\s+", " ")
    return F.when(low.startswith(prefix), F.substring(low, len(prefix) + 1, 1 << 30)).otherwise(low) if prefix else low


def joined(sep: str, *values: Column) -> Column:
    """The non-empty cleaned values with sep between."""
    return F.concat_ws(sep, *[filled(v) for v in values])


def person_name(name: Column, first: Column, last: Column) -> Column:
    """A single-field name, or first and last name."""
    return F.coalesce(filled(name), joined(" ", first, last))


def codes(value: Column, pattern: str) -> Column:
    """All matches of pattern, upper-cased, each once, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(clean(value), F.lit(pattern), F.lit(0)), F.upper)))


def issns(value: Column) -> Column:
    return codes(value, ISSN)


def isbns(value: Column) -> Column:
    """Digits and X of the candidates, of 10 or 13 characters, each once, ascending."""
    found = F.transform(F.regexp_extract_all(clean(value), F.lit(ISBN), F.lit(0)), lambda x: F.upper(F.regexp_replace(x, r"[^\dXx]", "")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x).isin(10, 13))))


def labelled_line(value: Column, label: str) -> Column:
    """The word on a line 'label: word' (case-insensitive, whole line), or null."""
    return F.nullif(F.regexp_extract(clean(value), rf"(?im)^{label}:\s*(\S+)\s*$", 1), F.lit(""))


def full_date(value: Column) -> Column:
    """The date at the start of a text if it is written out, or null."""
    return F.nullif(F.regexp_extract(clean(value), FULL_DATE, 1), F.lit(""))


def slug(value: Column) -> Column:
    """Case-folded; runs of anything but a-z and 0-9 are a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(folded(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def record_stem(pid: Column, own_prefix: str) -> Column:
    """A file name for a pid: by DOI, ISSN, the last part of a path in one's own namespace, or ROR; else the pid; as a slug.

    Null if nothing is left, which is an error.
    """
    known, low = locator_doi(pid), folded(pid)
    after = F.substring(pid, F.instr(pid, ":") + 1, F.length(pid))
    raw = (
        F.when(known.isNotNull(), F.concat(F.lit("doi-"), known))
        .when(low.startswith("issn:"), F.concat(F.lit("issn-"), after))
        .when(pid.startswith(own_prefix) & pid.contains("/"), F.substring_index(pid, "/", -1))
        .when(low.startswith("ror:"), F.concat(F.lit("ror-"), after))
        .otherwise(pid)
    )
    return F.nullif(slug(raw), F.lit(""))
