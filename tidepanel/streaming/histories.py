"""Incremental histories as Structured Streaming jobs.

Each job reads a folder of landed files and upserts every micro-batch into a keyed
table. The table is the state: a row that arrives late, twice, or older than what is
stored meets its key there, so no delay has to be guessed and nothing is dropped. A
batch rewrites only the partitions it touches, beside their predecessors; one that
is replayed after a failure rewrites the same version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.functions.calendar import epoch_date
from tidepanel.operators.merge import keep_one
from tidepanel.session import child_names, remove_path


def landed_stream(spark: SparkSession, folder: str, schema: StructType,
                  files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def daily_totals(events: DataFrame, by: Sequence[str], event_time: str = "ts",
                 value: str = "rate") -> DataFrame:
    """Sums of UTC days. A day is usable from its end. Events without a time are a day of their own."""
    day = epoch_date(F.unix_seconds(event_time)).alias("date")
    return (events.groupBy(*by, day)
            .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
            .select(*by, "date", F.date_add("date", 1).alias("effective_date"), "total", "n"))


class KeyedTable:
    """One row per key, the greatest in ``order`` over all batches (ties: the fresher).

    Version v holds whole the partitions that batch v touched (``part`` of a row's key), and a manifest
    that names each partition's newest version: a batch reads the manifest before it and only the folders
    that it names. Once those are ``compact_after``, the next batch rewrites all partitions, so the cost of
    a batch does not grow with the number of versions, and ``vacuum`` can remove what is no longer named.
    Rows with a null ``part`` are one partition. ``order`` decides across
    batches too: an older run in a later batch does not replace a newer one.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: Sequence[str],
                 part: Column, order: Sequence[Column | str] = (), compact_after: int = 8):
        self.spark, self.root, self.schema = spark, root, schema
        self.keys, self.part, self.order = list(keys), part, list(order)
        self.compact_after = compact_after

    def path(self, version: int) -> str:
        return f"{self.root}/v={version}"

    def manifest_path(self, version: int) -> str:
        return f"{self.root}/m={version}"

    def _numbers(self, kind: str) -> list[int]:
        names = child_names(self.spark, self.root) or []
        return sorted(int(n[2:]) for n in names if n.startswith(f"{kind}="))

    def newest(self) -> int:
        """The newest complete version, 0 if nothing was written. A version is complete with its manifest."""
        for version in reversed(self._numbers("m")):
            if "_SUCCESS" in (child_names(self.spark, self.manifest_path(version)) or []):
                return version
        return 0

    def manifest(self, version: int) -> tuple[DataFrame, list[int]]:
        """(__live, __newest) of each partition as of a version, and the versions it names."""
        if "_SUCCESS" not in (child_names(self.spark, self.manifest_path(version)) or []):
            raise FileNotFoundError(f"no version {version} under {self.root}")
        parts = self.spark.read.parquet(self.manifest_path(version))
        named = sorted(r[0] for r in parts.select("__newest").distinct().collect())
        if lost := set(named) - set(self._numbers("v")):
            raise FileNotFoundError(f"versions missing under {self.root}: {sorted(lost)}")
        return parts, named

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the newest."""
        version = self.newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self._live(*self.manifest(version))

    def touched(self, version: int) -> DataFrame:
        """The partitions that a version wrote, whole."""
        return self.spark.read.schema(self.schema).parquet(self.path(version))

    def _live(self, parts: DataFrame, named: Sequence[int]) -> DataFrame:
        fields = self.schema.fieldNames()
        if len(named) == 1:  # nothing else was written since: every row lives
            return self.touched(named[0]).select(*fields)
        rows = None
        for v in named:
            own = self.touched(v).withColumn("__version", F.lit(v))
            rows = own if rows is None else rows.unionByName(own)
        rows = rows.withColumn("__part", self.part)
        same = F.col("__part").eqNullSafe(F.col("__live")) & (F.col("__version") == F.col("__newest"))
        return rows.join(parts, same, "left_semi").select(*fields)

    def upsert(self, batch: DataFrame, version: int) -> None:
        """Write version ``version`` from the one before it. Rerunning it is harmless."""
        fields = self.schema.fieldNames()
        merged, before, whole = batch.select(*fields).withColumn("__vintage", F.lit(1)), None, True
        if version > 1:
            before, named = self.manifest(version - 1)
            whole = len(named) >= self.compact_after
            stored = self._live(before, named)
            if not whole:
                parts = batch.select(self.part.alias("__fresh")).distinct()
                stored = stored.withColumn("__part", self.part).join(
                    parts, F.col("__part").eqNullSafe(F.col("__fresh")), "left_semi").select(*fields)
            merged = stored.withColumn("__vintage", F.lit(0)).unionByName(merged)
        merged = keep_one(merged, self.keys, [*self.order, "__vintage"])
        merged.select(*fields).write.mode("overwrite").parquet(self.path(version))
        made = self.touched(version).select(self.part.alias("__live")).distinct().withColumn("__newest", F.lit(version))
        if not whole:
            mine = made.select(F.col("__live").alias("__made"))
            made = made.unionByName(before.join(mine, F.col("__live").eqNullSafe(F.col("__made")), "left_anti"))
        made.coalesce(1).write.mode("overwrite").parquet(self.manifest_path(version))

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions that none of the newest ``keep`` manifests names, and older manifests."""
        newest = self.newest()
        kept = [v for v in self._numbers("m") if newest - keep < v <= newest]
        named = {n for v in kept for n in self.manifest(v)[1]}
        for v in self._numbers("v"):
            if v <= newest and v not in named:
                remove_path(self.spark, self.path(v))
        for v in self._numbers("m"):
            if v <= newest and v not in kept:
                remove_path(self.spark, self.manifest_path(v))


def run_upserts(stream: DataFrame, table: KeyedTable, checkpoint: str,
                after: Callable[[int], None] | None = None) -> int:
    """Drain what has landed; the newest version of the table, whether or not this call wrote it.
    ``after`` is told each version as it is written."""
    def batch(df: DataFrame, epoch: int) -> None:
        table.upsert(df, epoch + 1)
        if after:
            after(epoch + 1)

    query = (stream.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(batch).start())
    query.awaitTermination()
    return table.newest()


def run_daily_totals(stream: DataFrame, events: KeyedTable, totals: KeyedTable, by: Sequence[str],
                     checkpoint: str, event_time: str = "ts", value: str = "rate") -> int:
    """Events into their keyed table, each once, and the sums of the days a batch touched.

    Sums come from the stored events, so a second delivery adds nothing and a late event
    corrects its day. The events' partitions must hold whole days.
    """
    def refresh(version: int) -> None:
        totals.upsert(daily_totals(events.touched(version), by, event_time, value), version)

    run_upserts(stream, events, checkpoint, refresh)
    return totals.newest()
