"""Command line: score a file of submissions. python -m rubrica [INPUT] [options]"""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys
import time
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.operators import judge, mapping, score
from rubrica.operators.state import BudgetLedger, PhotoIndex
from rubrica.plans import pipeline
from rubrica.plans.staging import numbered, stage
from rubrica.sources import assets, readers, sinks

log = logging.getLogger("rubrica")


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="rubrica", description="Score a CSV or Excel file of submissions.")
    p.add_argument("input", nargs="?", help="the file; asked for if it is left out")
    p.add_argument("--non-interactive", action="store_true", help="never ask; print no summary")
    p.add_argument("--output-csv", help="where results go (default: a new name in ./outputs)")
    p.add_argument("--files", help="a folder with the reports and photos, of any store that Spark reads (default: they are fetched)")
    p.add_argument("--judge", default="rubrica.operators.judge:stub_verdicts", help="module:function that answers prompts")
    p.add_argument("--fallback", help="module:function to ask when the judge fails")
    p.add_argument("--cache", help="a folder that keeps answers between runs")
    p.add_argument("--state", help="a folder that keeps what batches used and remember: budgets of ids, photos of directories")
    p.add_argument("--batch", type=int, default=0, help="the batch's number in their order, with --state; one that runs again replaces its part")
    p.add_argument("--acceptance-threshold", type=int)
    p.add_argument("--phash-threshold", type=int)
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    p.add_argument("--log-file")
    return p.parse_args(argv)


def setup_logging(level: str = "INFO", path: str | None = None) -> None:
    where: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if path:
        where.append(logging.FileHandler(path, encoding="utf-8"))
    logging.basicConfig(level=level, handlers=where, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)


def provider(name: str | None) -> judge.Provider | None:
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def scored_batch(raw: DataFrame, ask: judge.Provider, config: EngineConfig = EngineConfig(), *, files: str | None = None, origin: str = "file", fallback: judge.Provider | None = None, cache: str | None = None, state: str | None = None, batch: int = 0, on_limit: Callable[[], None] | None = None) -> DataFrame:
    """The whole chain from raw rows to scored ones, in their order (column place): files, budgets, judge, duplicates, rules.

    state is a folder of what earlier batches used and remember; batches have numbers in their order, and one that runs again replaces its part.
    """
    index = PhotoIndex(raw.sparkSession, f"{state}/directories", config.phash_threshold) if state else None
    ledger = BudgetLedger(raw.sparkSession, f"{state}/budgets", config.max_calls) if state else None
    place = "row_place"
    while place in raw.columns:
        place += "_"
    rows = numbered(stage(raw.withColumn("row_order", F.monotonically_increasing_id()), "raw"), ["row_order"], place).drop("row_order")
    places = stage(mapping.mapped(rows, config, origin, (place,)).withColumnRenamed(place, "row_place"), "mapped")
    get = (lambda paths: assets.stored(paths, files, base=config.base_path)) if files else (lambda paths: assets.fetched(paths, fetch=lambda u: assets.fetch_url(u, config.fetch_timeout_s)))
    texts = stage(assets.reports(get(places.select(F.col("m_pdf_path").alias("path")))), "reports")
    named = pipeline.photos(places, "row_place")
    content = stage(get(named), "photos")
    features = stage(assets.image_features(content), "features")
    images = stage(named.join(features, "path"), "images")
    flags = pipeline.report_features(texts.select(F.col("path").alias("m_pdf_path"), "text"))
    df = pipeline.with_images(pipeline.with_reports(places, flags, "m_pdf_path"), images, "row_place")
    df = stage(pipeline.with_budget(df, F.col("sid"), "row_place", config.max_calls, ledger, batch), "budgeted")
    shown = images.groupBy(F.col("ord").alias("row_place")).agg(F.min_by("path", "pos").alias("first_path"))
    pictures = content.join(features.select("path", "sha256"), "path")
    body = texts.select(F.col("path").alias("m_pdf_path"), F.col("text").alias("body"))
    df = df.join(body, "m_pdf_path", "left").join(shown, "row_place", "left")
    df = pipeline.with_answers(df, "body", "first_path", ask, config, pictures=pictures, fallback=fallback, cache=cache, on_limit=on_limit).drop("body", "first_path")
    return pipeline.scored(pipeline.with_duplicates(df, images, "row_place", config.phash_threshold, index, batch), config)


def run(spark: SparkSession, source: str, target: str, ask: judge.Provider, config: EngineConfig = EngineConfig(), **how) -> dict:
    """Score a file into one CSV; counts, mean score and seconds of the run."""
    began = time.time()
    out, watch = score.observed(scored_batch(readers.read_batch(spark, source), ask, config, **how))
    rows = stage(out.select("row_place", "raw", "score", "status", "unmet"), "scored")
    got = dict(watch.get)
    sinks.write_csv_bom(pipeline.output(rows.orderBy("row_place")).withColumn("Overall Score", F.col("`Overall Score`").cast("string")), target)
    took = time.time() - began
    return {**got, "seconds": took, "seconds_a_row": took / max(1, got["total"])}


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    setup_logging(args.log_level, args.log_file)
    source = args.input
    if not source:
        if args.non_interactive:
            print("an input file is needed", file=sys.stderr)
            return 2
        source = input("CSV or Excel file: ").strip().strip("\"'")
    target = args.output_csv or str(Path("outputs") / sinks.output_name(source))
    given = {"acceptance_threshold": args.acceptance_threshold, "phash_threshold": args.phash_threshold}
    config = replace(EngineConfig.from_env(), **{k: v for k, v in given.items() if v is not None})
    try:
        spark = SparkSession.builder.appName("rubrica").getOrCreate()
        got = run(spark, source, target, provider(args.judge), config, files=args.files, fallback=provider(args.fallback), cache=args.cache, state=args.state, batch=args.batch)
    except FileNotFoundError:
        log.error("file not found: %s", source)
        return 1
    except KeyboardInterrupt:
        log.error("interrupted")
        return 130
    log.info("results: %s", os.path.abspath(target))
    if not args.non_interactive:
        mean = got["mean_score"]
        print(f"total {got['total']}, accepted {got['accepted']}, rejected {got['rejected']}, reopen {got['reopen']}" + (f", errors {got['errors']}" if got["errors"] else ""))
        print(f"mean score {mean if mean is not None else 0:.1f}/100, {got['seconds']:.1f} s, {got['seconds_a_row']:.2f} s a row")
    return 0


if __name__ == "__main__":
    sys.exit(main())
