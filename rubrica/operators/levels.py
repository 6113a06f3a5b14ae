"""Levels by hours, event types and duration texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.normalize import no_nan

# Hour range of each level.
LEVELS = [(1, 2.0, 4.0), (2, 5.0, 8.0), (3, 9.0, 18.0), (4, 19.0, float("inf"))]
# Event types of each level.
EVENT_TYPES = {
    1: ["Expert Talk", "Mentoring Session", "Exposure Visit"],
    2: ["Seminar", "Workshop", "Conference", "Exposure Visit", "Panel Discussion", "Roundtable Discussion", "Networking Event"],
    3: ["Boot Camp", "Workshop", "Exhibition/ Startup Showcase", "Demo Day", "Competition", "Hackathons", "Conference"],
    4: ["Challenge", "Tech/ E-Fest", "Hackathon", "Competition", "Workshop", "Boot Camp", "Exhibition/ Startup Showcase"],
}
# Words taken out of a duration, in this order.
UNITS = ["hours", "hour", "hrs", "hr", "minutes", "minute", "mins", "min", "h", "m"]


def level_of(hours: Column) -> Column:
    h, out = no_nan(hours), F
    for level, lo, hi in LEVELS:
        out = out.when((h >= lo) & (h <= hi), level)
    return out


def level_by_type(event_type: Column, hours: Column, types: dict[int, list[str]] = EVENT_TYPES) -> Column:
    """The first level that has both the event type and the hours; null if none has."""
    h, out = no_nan(hours), F
    for level, lo, hi in LEVELS:
        out = out.when(event_type.isin(types[level]) & (h >= lo) & (h <= hi), level)
    return out


def level_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, lo double, hi double").coalesce(1)


def level_join(df: DataFrame, hours: str) -> DataFrame:
    """Range join with the table of four levels; rows in the gaps keep a null level."""
    levels = F.broadcast(level_table(df.sparkSession))
    h = no_nan(F.col(hours))
    return df.join(levels, (h >= F.col("lo")) & (h <= F.col("hi")), "left")


def in_level(level: Column, hours: Column) -> Column:
    h, out = no_nan(hours), F
    for n, lo, hi in LEVELS:
        out = out.when(level == n, F.coalesce((h >= lo) & (h <= hi), F.lit(False)))
    return out.otherwise(False)


def parse_hours(duration: Column) -> Column:
    """First number once unit words are taken out, one after the other; units are not converted."""
    bare = reduce(lambda s, unit: F.replace(s, F.lit(unit), F.lit("")), UNITS, F.lower(duration))
    return F.regexp_extract(bare, r"(\d+\.?\d*)", 1).try_cast("double")


def parse_hours_by_unit(duration: Column) -> Column:
    """The same, in hours: a text with an m counts minutes."""
    return F.when(F.lower(duration).contains("m"), parse_hours(duration) / 60).otherwise(parse_hours(duration))
