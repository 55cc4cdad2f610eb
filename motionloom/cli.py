"""python -m motionloom.cli MODE ...: the verbs over files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Dynamics, Tracking, load
from .operators import cleaning, runs
from .plans import pipeline as verbs
from .sources import images, tables

KEYS = ("pog", "pwm", "trial")
MODES = ("track", "trim", "process", "check", "clean", "extract", "plot", "complete")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motionloom", description=__doc__)
    p.add_argument("mode", choices=MODES)
    p.add_argument("input", help="frames (track), recordings (trim, process, and complete with a background), tracking files (check, clean, complete), cleaned runs (extract) or physics (plot)")
    p.add_argument("output")
    p.add_argument("--background", help="background image (track, process, complete)")
    p.add_argument("--recordings", help="folder of recordings or clips (check): runs without one aren't missed")
    p.add_argument("--ending", default=".mp4", help="of recordings: .mp4 (trim, check) or one that has a decoder")
    p.add_argument("--config", help="YAML file")
    p.add_argument("--pog", action="append", help="only these (any number)")
    return p


def some(rows: DataFrame, pogs: list[str] | None) -> DataFrame:
    """Rows of these pogs, all of which have to be there."""
    if not pogs:
        return rows
    runs.known_pogs(rows.select("pog").distinct(), pogs)
    return rows.where(F.col("pog").isin(pogs))


def missing(spark: SparkSession, want: DataFrame, files: DataFrame, out: str) -> None:
    """Writes the wanted runs that have no readable tracking file, with the reason: missing, or what is wrong with the file."""
    gone = verbs.check(want, files.where("reason IS NULL").select(*KEYS).distinct(), list(KEYS))
    why = files.where("reason IS NOT NULL").groupBy(*KEYS).agg(F.min("reason").alias("reason"))
    gone.join(why, list(KEYS), "left").withColumn("reason", F.coalesce("reason", F.lit("missing"))).write.mode("overwrite").parquet(out)


def expected(spark: SparkSession, args: argparse.Namespace, folder: str | None, d: Dynamics) -> DataFrame:
    """Runs that should have tracking: the clips that recordings give, or the whole grid of the configured pogs, or of those seen."""
    if folder:
        return tables.present_clips(spark, folder, d, args.ending)
    if d.name_pogs:
        pogs = spark.createDataFrame([(n,) for n in d.name_pogs], "pog string")
    else:
        pogs = tables.tracking_files(spark, args.input).select("pog").distinct()
    return runs.experiment_grid(pogs, d)


def plot(table: DataFrame, d: Dynamics, out: str) -> None:
    for name, rows in verbs.plot_data(table, d).items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}")


def clean(rows: DataFrame, c: Tracking, d: Dynamics, out: str) -> None:
    """Writes cleaned runs and discarded ones, and beside them the rows that each step left."""
    cleaned, seen = cleaning.observed_clean(rows, KEYS, d, c)
    tables.write_clean(cleaned.drop("rn"), cleaning.discard_reasons(rows, KEYS, d), out, KEYS)
    counts = {step: int(o.get["rows"]) for step, o in seen.items()}
    rows.sparkSession.createDataFrame(list(counts.items()), "step string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{out}/counts")
    print("rows: " + ", ".join(f"{n} {step}" for step, n in counts.items()))


def extract(spark: SparkSession, clean_runs: str, d: Dynamics, out: str, pogs: list[str] | None = None) -> DataFrame:
    """Writes physics, and beside it the runs that give none with the reason."""
    rows = some(cleaning.positions(spark.read.parquet(clean_runs), KEYS), pogs)
    every = verbs.physics_or_reason(rows, KEYS, d)
    every.write.mode("overwrite").parquet(f"{out}_runs")
    every = spark.read.parquet(f"{out}_runs")
    every.where("reason IS NOT NULL").select(*KEYS, "reason").write.mode("overwrite").parquet(f"{out}_rejected")
    good = every.where("reason IS NULL").drop("reason")
    tables.write_physics(good, out)
    return good


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("motionloom").getOrCreate()
    c, d = load(Tracking, args.config), load(Dynamics, args.config)
    out = args.output
    if args.pog and d.name_pogs and (unknown := [p for p in args.pog if p not in d.name_pogs]):
        raise ValueError(f"no such pog: {', '.join(unknown)}")
    if args.mode == "track":
        found = verbs.detect(images.read_frames(spark, args.input), images.read_background_image(spark, args.background), c, flip=True)
        verbs.track(found, c, ("video_id",)).write.mode("overwrite").option("header", True).csv(out)
    elif args.mode == "trim":
        there = tables.workspace(spark, args.input, list(d.name_pogs), args.ending).where("path IS NOT NULL")
        verbs.trim(some(there, args.pog), d).write.mode("overwrite").parquet(out)
    elif args.mode == "plot":
        plot(spark.read.option("header", True).option("inferSchema", True).csv(args.input), d, out)
    elif args.mode == "check":
        want = expected(spark, args, args.recordings, d)
        want = want.where(F.col("pog").isin(args.pog)) if args.pog else want
        missing(spark, want, tables.tracking_files(spark, args.input), out)
    elif args.mode == "clean":
        clean(some(tables.read_tracking(spark, args.input), args.pog), c, d, out)
    elif args.mode == "extract":
        extract(spark, args.input, d, out, args.pog)
    else:
        recorded = args.mode == "process" or args.background
        if recorded:
            shots = images.read_frames(spark, args.input, runs.frame_ranges(d, c.fps))
            if names := args.pog or d.name_pogs:
                shots = shots.where(F.col("video_id").isin(*names) | F.regexp_replace("video_id", r"_\d+_\d+$", "").isin(*names))
            tracking = verbs.process(shots, images.read_background_image(spark, args.background), c, d)
            folder = out if args.mode == "process" else f"{out}/tracking"
            tables.write_tracking(tracking, folder)
        if args.mode == "complete":
            if recorded:
                rows = spark.read.parquet(f"{out}/tracking")
                files, seen = rows.select(*KEYS).distinct().withColumn("reason", F.lit(None).cast("string")), rows.select("pog").distinct()
            else:
                rows = some(tables.read_tracking(spark, args.input), args.pog)
                files = tables.tracking_files(spark, args.input)
                files.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{out}/rejected")
                seen = files.select("pog").distinct()
            # the configured pogs, whether they have a file or not
            names = args.pog or list(d.name_pogs)
            pogs = spark.createDataFrame([(n,) for n in names], "pog string") if names else seen
            missing(spark, runs.experiment_grid(pogs, d), files, f"{out}/missing")
            clean(rows, c, d, f"{out}/clean")
            plot(extract(spark, f"{out}/clean/runs", d, f"{out}/physics"), d, f"{out}/plots")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
