"""Identifier clean-up. IDs are text; a 19-digit ID never becomes a double."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from erashift import fixed_values as fv


def strip_float_suffix(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), fv.FLOAT_ID_PATTERN, "$1")


def canonical_id(c: Column) -> Column:
    """Null tokens become NULL, then '123.0' becomes '123'."""
    s = c.cast("string")
    return strip_float_suffix(F.when(~s.isin(fv.NULL_ID_TOKENS), s))


def edge_id(c: Column) -> Column:
    """Edge flavour: strip first, then a shorter list of null tokens."""
    s = strip_float_suffix(c)
    return F.when(~s.isin(fv.NULL_EDGE_TOKENS), s)


def float_id(c: Column) -> Column:
    """IDs that went through a double: '4.5E9' and 4.5e9 become '4500000000'."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^-?\d+$"), s).otherwise(
        s.try_cast("double").try_cast("bigint").cast("string")
    )


def prefixed_id(c: Column, prefix: str = "u") -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))
