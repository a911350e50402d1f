"""Week arithmetic (weeks start on Monday 00:00 UTC) and clock normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def iso_year(day: Column) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), day).cast("int")


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def iso_monday(year: Column, week: Column) -> Column:
    """Monday of an ISO (year, week): 4 January always lies in week 1."""
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    return F.date_add(first, (week.cast("int") - 1) * 7)


def iso_key(year: Column, week: Column) -> Column:
    return (year * 100 + week).cast("int")


def week_key(year: Column, week: Column) -> Column:
    return F.format_string("%d-W%02d", year.cast("int"), week.cast("int"))


def week_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def season(week: Column) -> tuple[Column, Column]:
    """Sine and cosine of the week with a 52-week period (week 53 wraps past the start)."""
    angle = F.lit(2.0) * F.pi() * week / F.lit(52.0)
    return F.sin(angle), F.cos(angle)


def to_timestamp_or_null(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string"))


def number_or_null(c: Column) -> Column:
    """Numeric coercion; goes through double so that '12.5' is kept."""
    if_num = c.try_cast("double")
    return F.when(F.isnan(if_num), F.lit(None)).otherwise(if_num)


def unix_divisor(max_abs: Column) -> Column:
    """Unit of a whole column of clocks, from its largest magnitude."""
    return F.when(max_abs > 1e15, F.lit(1.0e9)).when(max_abs > 1e12, F.lit(1.0e3)).otherwise(F.lit(1.0))


def to_unix_seconds(df: DataFrame, source: str, out: str = "created_utc", by: str | None = None) -> DataFrame:
    """Clock column of any unit, or of date strings, to unix seconds.

    The unit and the "mostly numeric" test look at a whole source, so the rows meet a profile with one row per source.
    A single profile reaches them as a scalar subquery; many are an equi-join on the source, whose small side adaptive
    execution may broadcast.
    """
    num = number_or_null(F.col(source))
    # A column of dates is not numeric, whatever its driver type.
    profile = F.struct(
        unix_divisor(F.max(F.abs(num))).alias("divisor"),
        F.avg(num.isNotNull().cast("double")).alias("share"),
    )
    parsed = F.unix_micros(to_timestamp_or_null(F.col(source))) / F.lit(1.0e6)
    value = lambda v: F.when(v["share"] > 0.8, num / v["divisor"]).otherwise(parsed)
    if by is None:
        return df.withColumn(out, value(df.agg(profile.alias("v")).scalar()))
    key = F.coalesce(F.col(by).cast("string"), F.lit(""))
    per_source = df.groupBy(key.alias("_source")).agg(profile.alias("_profile"))
    joined = df.withColumn("_key", key).join(per_source, F.col("_key") == F.col("_source"))
    return joined.withColumn(out, value(F.col("_profile"))).drop("_key", "_source", "_profile")
