"""Tweet text and reference expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from erashift import fixed_values as fv


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def pattern_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(pattern))


def hashtags(c: Column) -> Column:
    return pattern_count(c, fv.HASHTAG_PATTERN)


def mentions(c: Column) -> Column:
    return pattern_count(c, fv.MENTION_PATTERN)


def urls(c: Column) -> Column:
    return pattern_count(c, fv.URL_PATTERN)


def retweet_flag(text: Column) -> Column:
    return text_or_empty(text).startswith(fv.RETWEET_PREFIX).cast("int")


def reply_flag(reply_id: Column) -> Column:
    token = F.trim(reply_id.cast("string"))
    return F.coalesce(~token.isin(fv.NULL_REPLY_TOKENS), F.lit(False)).cast("int")


def reference_flag(refs: Column, kind: str) -> Column:
    """1 if any referenced tweet is of this kind; NULL and empty lists give 0."""
    return F.coalesce(F.exists(refs, lambda r: r["type"] == kind), F.lit(False)).cast("int")


def v2_retweet_flag(refs: Column) -> Column:
    return reference_flag(refs, "retweeted")


def v2_reply_flag(refs: Column, reply_id: Column) -> Column:
    has_id = F.coalesce(F.length(reply_id.cast("string")) > 0, F.lit(False)).cast("int")
    return F.greatest(reference_flag(refs, "replied_to"), has_id)
