"""Tables on disk: tracking files, cleaned runs, physics, and what a workspace holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Dynamics
from ..functions.columns import run_key
from ..operators.runs import experiment_grid
from ..schema import TRACKING

COLUMNS = tuple(c.split()[0] for c in TRACKING.split(", "))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of tracking files with the run's key from the name; _bad holds a line that isn't of the schema, as the names of the columns
    aren't. The schema is stated, not inferred."""
    rows = spark.read.schema(f"{TRACKING}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    # Spark parses, and finds fault with, the columns that are asked for: this asks for all
    bad = F.coalesce("_bad", F.when(F.length(F.concat_ws(",", *COLUMNS)) < 0, ""))
    return rows.select(F.col("_metadata.file_path").alias("path"), *run_key(F.col("_metadata.file_path")), *COLUMNS, bad.alias("_bad"))


def _is_header() -> Column:
    return F.coalesce(F.regexp_replace("_bad", r"[\s\ufeff]", "") == ",".join(COLUMNS), F.lit(False))


def tracking_files(spark: SparkSession, path: str) -> DataFrame:
    """(pog, pwm, trial, path, reason) of the tracking files named {pog}_{pwm}_{trial}.csv; reason is null where a file can be read. Spark's
    sources pass over files without a byte, so these are as if they weren't there."""
    header = _is_header()
    seen = _lines(spark, path).groupBy("path", "pog", "pwm", "trial").agg(
        F.count_if(header).alias("heads"), F.count_if(F.col("_bad").isNotNull() & ~header).alias("bad"), F.count_if(F.col("_bad").isNull()).alias("rows")
    )
    reason = F.when(F.col("bad") > 0, "malformed").when(F.col("heads") == 0, "no_header").when(F.col("rows") == 0, "empty")
    return seen.select("pog", "pwm", "trial", "path", reason.alias("reason")).where("pwm IS NOT NULL")


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the tracking files that can be read. A file with a line that isn't of the schema is left out as a whole, and tracking_files() says why."""
    good = tracking_files(spark, path).where("reason IS NULL").select("path")
    return _lines(spark, path).where(F.col("_bad").isNull()).join(good, "path", "left_semi").select("pog", "pwm", "trial", *COLUMNS)


def write_tracking(tracking: DataFrame, path: str, keys: tuple[str, ...] = ("pog", "pwm", "trial"), form: str = "parquet") -> None:
    """A new data set in folders by run, which later reads prune. Raw data is never overwritten by cleaned."""
    rows = tracking.repartition(*keys).sortWithinPartitions(*keys, "time")
    writer = rows.write.partitionBy(*keys).mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def write_clean(clean: DataFrame, discarded: DataFrame, path: str, keys: tuple[str, ...] = ("pog", "pwm", "trial")) -> None:
    """Cleaned runs, and beside them the runs that were discarded with the reason."""
    write_tracking(clean, f"{path}/runs", keys)
    discarded.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/discarded")


def write_physics(physics: DataFrame, path: str) -> bool:
    """A CSV folder for each pog; nothing is written where there are no rows."""
    if physics.isEmpty():
        return False
    physics.repartition("pog").write.partitionBy("pog").mode("overwrite").option("header", True).csv(path)
    return True


def listed(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(path, name, length) of the files of a folder and those below it. Only names are listed, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(folder)
    return files.select("path", F.regexp_extract("path", rf"([^/]+)\{ending}$", 1).alias("name"), "length")


def workspace(spark: SparkSession, folder: str, names: list[str], ending: str = ".mp4") -> DataFrame:
    """(pog, path) of the configured pogs; path is null where there is no recording. Without names, all recordings there are, but for clips."""
    found = listed(spark, folder, ending)
    if not names:
        return found.where(run_key(F.col("path"))[1].isNull()).select(F.col("name").alias("pog"), "path")
    wanted = spark.createDataFrame([(n,) for n in names], "pog string")
    return wanted.join(found.select("path", F.col("name").alias("pog")), "pog", "left").select("pog", "path")


def present_clips(spark: SparkSession, folder: str, d: Dynamics, ending: str = ".mp4") -> DataFrame:
    """(pog, pwm, trial) of the clips that recordings give: all of the grid for a whole recording {pog}, and single clips {pog}_{pwm}_{trial}."""
    whole = workspace(spark, folder, list(d.name_pogs), ending).where("path IS NOT NULL").select("pog")
    single = listed(spark, folder, ending).select(*run_key(F.col("path"))).where("pwm IS NOT NULL")
    if d.name_pogs:
        single = single.where(F.col("pog").isin(*d.name_pogs))
    single = single.where(F.col("pwm").isin(*d.pwm) & (F.col("trial") < d.trials))
    return experiment_grid(whole, d).select("pog", "pwm", "trial").unionByName(single).distinct()


def present_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """(pog, pwm, trial) of the tracking files that can be read."""
    return tracking_files(spark, folder).where("reason IS NULL").select("pog", "pwm", "trial").distinct()
