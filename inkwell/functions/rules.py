"""Rule keys and similarities, and block diffs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

_DIFF = ArrayType(StructType([StructField(c, StringType()) for c in ("operation", "before", "after")]))


def rule_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard index of the words; 0 where either has none."""
    x, y = (F.array_distinct(F.filter(F.split(v, r"(?U)\s+"), lambda w: w != "")) for v in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


#: Ratios of keys met lately, as a user's keys meet again and again. A dict, since functions go to tasks by value.
_RATIOS: dict[tuple[str, str], float] = {}


def ratio(a: str, b: str) -> float:
    """Matching-blocks ratio; the order of arguments matters."""
    found = _RATIOS.get((a, b))
    if found is None:
        if len(_RATIOS) >= 10_000:
            _RATIOS.clear()
        found = _RATIOS[a, b] = difflib.SequenceMatcher(a=a, b=b).ratio()
    return found


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def block_diff(before: str | None, after: str | None) -> list[dict]:
    """Changed runs of blank-line separated blocks."""
    one, two = ([x.strip() for x in (t or "").split("\n\n") if x.strip()] for t in (before, after))
    codes = difflib.SequenceMatcher(a=one, b=two).get_opcodes()
    return [{"operation": op, "before": "\n\n".join(one[i:j]), "after": "\n\n".join(two[k:m])} for op, i, j, k, m in codes if op != "equal"]


def diff_json(diff: Column) -> Column:
    """A block diff as the JSON that a rule-reading model is given; characters stay as they are."""
    return F.to_json(F.coalesce(diff, F.array().cast(_DIFF)), {"pretty": "true"})


@F.pandas_udf(_DIFF)
def structured_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([block_diff(x, y) for x, y in zip(before, after, strict=True)], dtype=object)
