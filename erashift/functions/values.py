"""Labels, numbers, flags and times. NULL means unknown; NaN never survives."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erashift import fixed_values as fv

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_BLANK = r"[\s\x1c-\x1f]"
MICROS_PER_DAY = 86_400_000_000


def numeric(c: Column) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes NULL."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def number_column(df: DataFrame, name: str) -> Column:
    """numeric() for text columns; a number column only loses its NaNs."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.NumericType):
        return numeric(F.col(name))
    as_double = F.col(name).cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(as_double), as_double)
    return as_double


def clip_low(c: Column, low) -> Column:
    """Lower bound that keeps NULL (greatest() would not)."""
    return F.when(c < F.lit(low), F.lit(low)).otherwise(c)


def log1p_clipped(c: Column) -> Column:
    return F.log1p(clip_low(c, 0.0))


def flag(c: Column) -> Column:
    """1/true to 1, 0/false to 0, every other text to NULL."""
    s = F.lower(c.cast("string"))
    return (
        F.when(s.rlike(rf"(?U)^{_BLANK}*(1|true){_BLANK}*$"), 1)
        .when(s.rlike(rf"(?U)^{_BLANK}*(0|false){_BLANK}*$"), 0)
    )


def has_text(c: Column) -> Column:
    """1 if any character is not white space, else 0 (also for NULL)."""
    return F.coalesce(c.cast("string").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)).cast("int")


def label_code(c: Column) -> Column:
    """Model reading of a label: bot 1, human 0, anything else NULL."""
    s = F.lower(c.cast("string"))
    return (
        F.when(s.rlike(rf"(?U)^{_BLANK}*bot{_BLANK}*$"), 1)
        .when(s.rlike(rf"(?U)^{_BLANK}*human{_BLANK}*$"), 0)
    )


def label_name(c: Column) -> Column:
    """'0'/'1' codes of the nested release to human/bot."""
    out = None
    for code, name in fv.LABEL_CODES.items():
        hit = c.cast("string") == code
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_bot_loose(c: Column) -> Column:
    """Diagnostics reading: lower-case only, a NULL label counts as not bot."""
    return F.coalesce((F.lower(c.cast("string")) == "bot").cast("int"), F.lit(0))


def default_picture(url: Column) -> Column:
    return F.coalesce(url.contains(fv.DEFAULT_PICTURE_MARK), F.lit(False)).cast("int")


def parse_time(c: Column, strict: bool = False) -> Column:
    """Text to UTC timestamp. strict reads ISO only; otherwise also the old
    API's 'Wed Aug 27 13:08:45 +0000 2008'."""
    s = c.cast("string")
    iso = s.try_cast("timestamp")
    if strict:
        return iso
    old = F.when(
        s.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} "),
        F.try_to_timestamp(F.substring(s, 5, 40), F.lit("MMM d HH:mm:ss Z yyyy")),
    )
    return F.coalesce(iso, old)


def time_column(df: DataFrame, name: str, strict: bool = False) -> Column:
    """The column as a timestamp whatever type the frame stores it in."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_time(F.col(name), strict)
    return F.col(name).cast("timestamp")


def long_suffix_time(c: Column) -> Column:
    """'1183552203000L' (milliseconds) to ISO text, other text untouched."""
    stamp = F.timestamp_millis(F.regexp_extract(c, r"^(\d+)L$", 1).try_cast("bigint"))
    whole = F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.when(c.rlike(fv.LONG_TIME_PATTERN), F.concat(whole, fraction, F.lit("+00:00"))).otherwise(c)


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed time in days as a double."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_DAY))


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, floored; not a calendar difference."""
    return F.floor(days_between(later, earlier))
