"""From raw rows to the standard format.

mapped() keeps the raw row whole in one struct `raw`, so no derived name can clash with a raw one, and adds the standard format as
flat columns. They are plain columns, not fields of a struct: the optimizer keeps a column that several expressions use as
one step, but copies the fields of a struct into each of its uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.functions.normalize import Raw, float_text, strip
from rubrica.functions.scalars import is_canonical
from rubrica.operators.levels import level_of

# Paths that name no file.
NO_PATH = ["", "0", "null", "none", "n/a"]


def duration_text(value: Column, raw: Column) -> Column:
    """'{float}h' of a number, else the raw text."""
    return F.when(value.isNotNull(), F.concat(float_text(value), F.lit("h"))).otherwise(F.coalesce(raw, F.lit("")))


def participants(student: Column, faculty: Column) -> Column:
    """Sum of two counts, 0 if either is none."""
    return F.coalesce(F.try_add(student, faculty), F.lit(0).cast("bigint"))


def academic_year(year: Column) -> Column:
    """YYYY-YY of the forms YYYY-YYYY, YYYY-YY and YYYY...; other texts as the mapping defines."""
    v = strip(year)
    parts = F.split(v, "-")
    first, second = parts[0], F.get(parts, F.lit(1))
    start = F.substring(v, 1, 4).try_cast("int")
    following = F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0")
    hyphened = (
        F.when((F.size(parts) != 2) | (F.length(first) != 4), v).when(F.length(second) == 4, F.concat(first, F.lit("-"), F.substring(second, 3, 2)))
        .when(F.length(second) == 2, v).otherwise("")
    )
    unhyphened = F.when(F.length(v) < 4, v).when(start.isNull(), "").otherwise(F.concat(start.cast("string"), F.lit("-"), following))
    return F.when(v.isNull(), "").when(v.contains("-"), hyphened).otherwise(unhyphened)


def resolve_path(path: Column, event_driven: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The address of a file: https addresses stay, other paths follow the base of their event type; null for an empty path."""
    base = F
    for kind, prefix in config.bases().items():
        base = base.when(event_driven == kind, prefix.rstrip("/"))
    base = base.otherwise(config.bases()[1].rstrip("/"))
    p = strip(path)
    return F.when(p.isNull() | (p == ""), None).when(p.startswith("https://"), p).otherwise(F.concat(base, F.lit("/"), F.ltrim(p, F.lit("/"))))


def image_paths(photos: list[Column], event_driven: Column, config: EngineConfig = EngineConfig()) -> Column:
    kept = [F.when(~F.lower(strip(p)).isin(NO_PATH), resolve_path(p, event_driven, config)) for p in photos]
    return F.concat_ws(",", *kept)


def split_paths(paths: Column) -> Column:
    """By comma where there is one, else by semicolon; empty and invalid entries go."""
    parts = F.when(paths.contains(","), F.split(paths, ",")).otherwise(F.split(paths, ";"))
    return F.filter(F.transform(parts, strip), lambda p: ~F.lower(p).isin(NO_PATH))


def submission_id(raw: Raw) -> Column:
    return next((raw.shown(name) for name in ("id", "eventId") if name in raw), F.lit("unknown"))


def mapped(df: DataFrame, config: EngineConfig = EngineConfig(), origin: str = "file", keep: tuple[str, ...] = ()) -> DataFrame:
    """(raw, sid, m_*, hours, driven, canonical, directory, broken): raw rows with their standard format.

    Absent columns have their defaults, null cells read 'nan' (origin file) or 'None' (origin json), columns may have any type.
    broken holds the error of a row whose title is no text, null for other rows. The columns in `keep` are no part of the raw row.
    """
    raw = Raw(df, origin)
    hours = raw.number("activity_duration")
    shown = F.when(raw.column("activity_duration").isNotNull(), raw.shown("activity_duration")) if "activity_duration" in raw else F.lit("")
    driven = raw.whole("event_driven").try_cast("int")
    kinds = {"file": "float", "json": "NoneType"}
    broken = F.lit(None).cast("string")
    if "activity_name" in raw:
        wrong = raw.column("activity_name").isNull() if raw.is_text("activity_name") else F.lit(True)
        broken = F.when(wrong, f"'{kinds[origin]}' object has no attribute 'strip'")
    return df.select(
        *keep,
        F.struct(*[raw.column(c) for c in df.columns if c not in keep]).alias("raw"),
        submission_id(raw).alias("sid"),
        raw.text("activity_name").alias("m_title"),
        raw.text("Objective").alias("m_objectives"),
        raw.text("benefit_learning").alias("m_outcomes"),
        raw.text("event_theme").alias("m_theme"),
        raw.text("event_type").alias("m_type"),
        raw.text("from_date").alias("m_date"),
        raw.text("financial_year", "Financial").alias("m_year_type"),
        raw.text("session_type").alias("m_mode"),
        hours.alias("hours"),
        duration_text(hours, shown).alias("m_duration"),
        participants(raw.count("student_participants"), raw.count("faculty_participants")).alias("m_participants"),
        level_of(hours).alias("m_level"),
        academic_year(raw.either("acadmic_year", "financial_year", "")).alias("m_year"),
        driven.alias("driven"),
        (is_canonical(raw.column("event_driven")) if "event_driven" in raw and raw.is_number("event_driven") else F.lit(False)).alias("canonical"),
        F.concat_ws("_", raw.shown("event_driven", "None"), raw.either("acadmic_year", "financial_year", "None")).alias("directory"),
        F.coalesce(resolve_path(raw.shown("report"), driven, config), F.lit("")).alias("m_pdf_path"),
        image_paths([raw.shown("photo1"), raw.shown("photo2")], driven, config).alias("m_image_paths"),
        broken.alias("broken"),
    )


