"""Column functions over nested records: typed arrays, identifiers, references and canonical forms."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import filled, record_stem, slug


def attribute_rows(pairs: Iterable[tuple[str, Column]]) -> Column:
    """array<struct<predicate, value>> of the pairs whose value isn't empty."""
    rows = F.array(*[F.struct(F.lit(p).alias("predicate"), filled(v).alias("value")) for p, v in pairs])
    return F.filter(rows, lambda r: r["value"].isNotNull())


def typed(values: Column, schema_type: str) -> Column:
    """Each struct of an array with a constant schema_type."""
    return F.transform(values, lambda x: x.withField("schema_type", F.lit(schema_type)))


def notations(identifiers: Column, schema_type: str) -> Column:
    """Non-empty notations of the identifiers of one type, in order."""
    return F.transform(F.filter(identifiers, lambda i: (i["schema_type"] == schema_type) & (F.coalesce(i["notation"], F.lit("")) != "")), lambda i: i["notation"])


def stable_pid(pid: Column, dois: Column, keys: Column, override: Column, prefix: str) -> Column:
    """An override; else the slug of the only DOI; else the least item key, lower-cased; null if there is none."""
    by_doi = F.when(F.size(dois) == 1, F.concat(F.lit(f"{prefix}doi-"), slug(dois[0])))
    by_key = F.concat(F.lit(f"{prefix}item-"), F.lower(F.array_min(keys)))
    return F.coalesce(override, by_doi, by_key)


def minted_pid(class_name: Column, pid: Column, own_prefix: str, minted: dict[str, str]) -> Column:
    """A pid of one's own namespace stays; for the classes in `minted` another one becomes prefix + record_stem."""
    out = pid
    for name, prefix in minted.items():
        out = F.when((class_name == name) & ~pid.startswith(own_prefix), F.concat(F.lit(prefix), record_stem(pid, own_prefix))).otherwise(out)
    return out


def with_identifier(identifiers: Column, notation: Column, schema_type: str) -> Column:
    """identifiers with one more at the end, unless the notation is among them."""
    new = F.array(F.struct(notation.alias("notation"), F.lit(schema_type).alias("schema_type")))
    known = F.coalesce(F.exists(identifiers, lambda i: i["notation"] == notation), F.lit(False))
    return F.when(identifiers.isNull(), new).when(known, identifiers).otherwise(F.concat(identifiers, new))


def retargeted(targets: Column, pid_map: Column) -> Column:
    """An array of references with those in the map (old to new pid) replaced."""
    return F.transform(targets, lambda x: F.coalesce(pid_map[x], x))


def roles(relations: Column) -> Column:
    """Distinct roles that an array of relations (object, roles) names, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(relations, lambda r: F.coalesce(r["roles"], F.array().cast("array<string>"))))))


def source_record_id(keys: Column) -> Column:
    """'item:K' of the only distinct key, or 'items:K1,K2' in ascending order."""
    ordered = F.array_sort(F.array_distinct(keys))
    return F.when(F.size(ordered) == 1, F.concat(F.lit("item:"), ordered[0])).when(F.size(ordered) > 1, F.concat(F.lit("items:"), F.array_join(ordered, ",")))


def score(fields: Iterable[Column], list_size: Column, is_fallback: Column) -> Column:
    """Filled fields, plus up to 10 list elements, plus 100 unless the row is of the fallback kind."""
    total = sum((F.when(filled(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return total + F.least(F.greatest(F.coalesce(list_size, F.lit(0)), F.lit(0)), F.lit(10)) + F.when(is_fallback, 0).otherwise(100)


def canonical_text(value) -> str:
    """Compact JSON with ascending keys and text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def batched(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A function of a row's texts as a function of columns, in Arrow batches: for what Spark can't do with JSON of any shape."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def _canonical(text: str | None) -> str | None:
    return None if text is None else canonical_text(json.loads(text))


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text; null stays null."""
    return batched(_canonical, T.StringType())(text)


def digest(canonical: Column) -> Column:
    """'sha256:' and the hexadecimal digest of a text."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))
