"""Null tokens, truth words, safe casts and safe rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haplodeck import domain

_BLANKS = " \t\n\r\x0b\x0c"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(_BLANKS))


def is_null_token(c: Column | str, any_case: bool = False) -> Column:
    """True for null and for every text that stands for "no call"; never null itself."""
    text = strip(c)
    if any_case:
        return col(c).isNull() | F.lower(text).isin(domain.NULL_TOKENS_ANY_CASE)
    return col(c).isNull() | text.isin(domain.NULL_TOKENS)


def reader_missing(c: Column | str) -> Column:
    """True where a delimited-file reader with default settings would have seen no value."""
    return col(c).isNull() | col(c).isin(domain.READER_NA_TOKENS)


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(col(c).cast("string"))).isin(domain.TRUE_TOKENS), F.lit(False))


def to_double(c: Column | str) -> Column:
    """Number or null; text that is no number, and NaN text, become null."""
    number = strip(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def both_or_null(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def pct(num: Column | str, den: Column | str) -> Column:
    """100 * num / den, null when the denominator is zero."""
    return F.try_divide(col(num).cast("double") * 100.0, col(den).cast("double"))


def share(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def display_pct(value: Column, digits: int) -> Column:
    """Half-even rounding, for report columns only."""
    return F.bround(value, digits)


def group_label(c: Column | str) -> Column:
    return F.upper(strip(c))


def epoch_seconds(c: Column | str, dtype: str) -> Column:
    """Seconds since 1970 as a double, for either kind of timestamp column."""
    if dtype == "timestamp_ntz":
        micros = F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})"
        )
    else:
        micros = F.unix_micros(col(c))
    return micros / F.lit(1e6)


def minutes_from_real_text(c: Column | str) -> Column:
    """Minutes out of a shell timing text: the line that starts with `real` and holds minutes, `m`,
    seconds, `s`."""
    line = F.get(F.filter(F.split(col(c), "\n"), lambda x: F.startswith(F.trim(x), F.lit("real"))), F.lit(0))
    clock = F.split(F.rtrim(F.replace(F.substring(F.trim(line), F.lit(5), F.length(line)), F.lit("\t"), F.lit(" ")), F.lit("s ")), "m")
    return (F.trim(F.get(clock, F.lit(0))).try_cast("double") * 60 + F.trim(F.get(clock, F.lit(1))).try_cast("double")) / 60
