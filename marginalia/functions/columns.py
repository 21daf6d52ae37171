"""Small helpers for building Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """df with the values as columns that are computed once a row. Struct columns that are merely added are written out again by the optimizer wherever a field of theirs is used, lambdas included."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def any_substring(text: Column, phrases) -> Column:
    """Whether text contains one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def first_of(reasons: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in reasons:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def present(*values: Column) -> Column:
    """An array of the values that are not null, in order."""
    return F.filter(F.array(*values), lambda x: x.isNotNull())
