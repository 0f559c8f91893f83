"""Table writes: bucketed bars, versioned histories, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.operators.merge import merge_latest
from tidepanel.sources.landing import history_or_empty

BUCKETS = 64


def write_bars(bars: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Parquet by instrument bucket: bounded directories, and pruning by bucket."""
    bucket = F.pmod(F.xxhash64("instrument"), F.lit(buckets)).cast("int")
    (bars.withColumn("bucket", bucket).repartition("bucket")
         .sortWithinPartitions("instrument", "session")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))


def read_bars(spark: SparkSession, path: str, instruments: Sequence[str] = (),
              start: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Field panel from the store: buckets pruned, filters and columns pushed down."""
    df = spark.read.parquet(path)
    if instruments:
        names = F.col("instrument").isin(list(instruments))
        wanted = (spark.createDataFrame([(n,) for n in instruments], "n string")
                  .select(F.pmod(F.xxhash64("n"), F.lit(BUCKETS)).cast("int").alias("b"))
                  .distinct())
        df = df.join(F.broadcast(wanted), df["bucket"] == wanted["b"], "left_semi").filter(names)
    if start:
        df = df.filter(F.col("session") >= F.lit(start).cast("date"))
    return df.select(*columns) if columns else df.drop("bucket")


def update_history(spark: SparkSession, root: str, version: int, fresh: DataFrame,
                   keys: Sequence[str], schema: StructType | str) -> DataFrame:
    """Merge fresh rows over version-1 and write the next version beside it: readers of
    the old version are never torn, and a failed write leaves it in place."""
    stored = history_or_empty(spark, f"{root}/v={version - 1}", schema)
    merged = merge_latest(stored, fresh, keys)
    merged.write.mode("overwrite").parquet(f"{root}/v={version}")
    return spark.read.schema(schema).parquet(f"{root}/v={version}")


def write_panel(panel: DataFrame, root: str, version: int) -> DataFrame:
    """The state panel as a versioned product: one folder a version, by year of session, read back."""
    path = f"{root}/v={version}"
    (panel.withColumn("year", F.year("session")).repartition("year").sortWithinPartitions("panel_id", "session")
          .write.mode("overwrite").partitionBy("year").parquet(path))
    return panel.sparkSession.read.parquet(path).select(*panel.columns)


def append_scorecard(scores: DataFrame, path: str, run_id: str) -> None:
    scores.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy(
        "run_id").parquet(path)


def export_scores(spark: SparkSession, path: str, scores: DataFrame) -> DataFrame:
    """Write scores by horizon and fold; only the partitions that ``scores`` has are replaced, so a rerun of a
    fold changes nothing else. Returns the whole export as it now is."""
    columns = ["panel_id", "session", "instrument", "score", "rank_pct", "lean", "horizon", "fold"]
    (scores.select(*columns).repartition("horizon", "fold").sortWithinPartitions("session", "instrument")
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("horizon", "fold").parquet(path))
    return spark.read.parquet(path)


def export_metadata(written: DataFrame, min_train: int, refit_every: int = 126) -> DataFrame:
    """One row per horizon of an export, read from the written table: rows, assets, fits, range."""
    return written.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("instrument").alias("assets"),
        F.count_distinct("fold").alias("fits"), F.min("session").alias("date_start"),
        F.max("session").alias("date_end"), F.count_if(F.col("lean") != 0).alias("legs")).withColumns(
        {"min_train": F.lit(min_train), "refit_every": F.lit(refit_every)})


def with_staleness(states: DataFrame, now, limit_days: int) -> DataFrame:
    """Age in days at read time; an unreadable stamp is stale."""
    # zone-less on both sides: an age never depends on the session zone
    stamp = F.col("as_of").try_cast("timestamp_ntz")
    age = F.timestamp_diff("MICROSECOND", stamp, F.lit(now).cast("timestamp_ntz")) / 86400e6
    return (states.withColumn("age_days", F.round(age, 1))
                  .withColumn("stale", F.coalesce(age > limit_days, F.lit(True))))
