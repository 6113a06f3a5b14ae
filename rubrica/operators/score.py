"""From outcomes to results, scores, statuses, explanations and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rubrica.operators.rules import RESULT, Outcome


def held(df: DataFrame, outcomes: list[Outcome]) -> DataFrame:
    """df with a column ok_<ord> for each outcome, then why_<ord>, the text of its result."""
    df = df.withColumns({f"ok_{o.rule.ord}": o.passed for o in outcomes})
    text = lambda o: F.when(F.col(f"ok_{o.rule.ord}"), F.lit("") if o.praise is None else o.praise).otherwise(o.message)
    return df.withColumns({f"why_{o.rule.ord}": text(o) for o in outcomes})


def total(outcomes: list[Outcome]) -> Column:
    return sum((F.when(F.col(f"ok_{o.rule.ord}"), o.rule.points).otherwise(0) for o in outcomes if o.rule.points), F.lit(0)).cast("int")


def unmet(outcomes: list[Outcome]) -> Column:
    """'criterion: message' (or the criterion alone) of each failed result, joined by '; '."""

    def piece(o: Outcome) -> Column:
        why = F.col(f"why_{o.rule.ord}")
        return F.when(~F.col(f"ok_{o.rule.ord}"), F.when(why == "", o.rule.criterion).otherwise(F.concat(F.lit(f"{o.rule.criterion}: "), why)))

    return F.concat_ws("; ", *map(piece, outcomes))


def results(outcomes: list[Outcome]) -> Column:
    """All results of a row in order, as one array."""

    def entry(o: Outcome) -> Column:
        ok, r = F.col(f"ok_{o.rule.ord}"), o.rule
        fields = {"ord": F.lit(r.ord), "category": F.lit(r.category), "criterion": F.lit(r.criterion), "passed": ok, "points": F.when(ok, r.points).otherwise(0), "message": F.col(f"why_{r.ord}")}
        return F.when(ok.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))

    return F.array_compact(F.array(*map(entry, outcomes))).cast(RESULT)


def status(score: Column, has_pdf: Column, has_images: Column, threshold: int = 60) -> Column:
    return F.when(~has_pdf | ~has_images, "Reopen").when(score >= (threshold or 60), "Accepted").otherwise("Rejected")


def breakdown(long: DataFrame) -> DataFrame:
    return long.groupBy("id", "category").agg(F.sum("points").alias("points"), F.count_if("passed").alias("n_passed"), F.count("*").alias("n_rules"))


def rollup(long: DataFrame) -> DataFrame:
    return long.rollup("category", "criterion").agg(F.sum("points").alias("points"), F.count_if("passed").alias("n_passed"))


def coerced(score: Column) -> Column:
    """A score as a whole number; texts that are none, NaN and values beyond the type are 0."""
    return F.coalesce(score.try_cast("double").try_cast("int"), F.lit(0))


def summary(scored: DataFrame) -> DataFrame:
    named = lambda s: F.count_if(F.upper("status") == s)
    mean = F.avg(F.col("score").try_cast("double").try_cast("int"))
    return scored.agg(F.count("*").alias("total"), named("ACCEPTED").alias("accepted"), named("REJECTED").alias("rejected"), named("REOPEN").alias("reopen"), named("ERROR").alias("errors"), mean.alias("mean_score"))


def observed(scored: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """scored with counts that any action on it fills: no second pass over the rows."""
    watch = Observation(name)
    named = lambda s: F.count_if(F.upper("status") == s)
    mean = F.avg(F.col("score").try_cast("double").try_cast("int"))
    return scored.observe(watch, F.count(F.lit(1)).alias("total"), named("ACCEPTED").alias("accepted"), named("REJECTED").alias("rejected"), named("REOPEN").alias("reopen"), named("ERROR").alias("errors"), mean.alias("mean_score")), watch
