"""Publication and report tables: queries only, no rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.asof import latest_per_key
from tidepanel.operators.histories import rate_label
from tidepanel.universe import ISSUER_SOURCES


def publish_positions(features: DataFrame) -> DataFrame:
    """Latest row per asset, rounded half-even, most stretched first."""
    last = latest_per_key(features, ["panel_id", "asset"], ["report_date"])
    place = F.row_number().over(_within().orderBy(F.abs(F.coalesce("z156", F.lit(0.0))).desc(),
                                                  "asset"))
    out = last.select("panel_id", "asset", "report_date",
                      F.bround("net_pct", 4).alias("net_pct_oi"), F.bround("z156", 2).alias("z156"),
                      F.bround("idx52", 2).alias("idx52"), F.bround("chg4w", 4).alias("chg4w"))
    return out.withColumn("place", place)


def _within():
    from pyspark.sql import Window
    return Window.partitionBy("panel_id")


def publish_rates(features: DataFrame) -> DataFrame:
    """Latest valid reading with its class and annualised value."""
    last = latest_per_key(features.filter("funding_1d is not null"), ["panel_id", "series_id"],
                          ["date"])
    return last.select("series_id", F.col("date").alias("data_through"),
                       F.bround("funding_1d", 6).alias("funding_1d"),
                       F.bround("funding_1d_annualized_pct", 1).alias("funding_1d_annualized_pct"),
                       F.bround("z156", 2).alias("z156"), F.bround("idx52w", 2).alias("idx52w"),
                       rate_label("z156").alias("read"))


def publish_liquidity(liquidity: DataFrame, check: DataFrame | None = None) -> DataFrame:
    last = latest_per_key(liquidity, ["panel_id"], ["day"])
    trend = F.when(F.col("netliq_chg13w") > 0, "rising").when(F.col("netliq_chg13w").isNotNull(),
                                                              "falling")
    out = last.select("panel_id", F.col("day").alias("data_through"),
                      *[F.bround(c, 1).alias(f"{c}_bn") for c in ("netliq", "walcl", "tga", "rrp")],
                      F.bround("netliq_chg13w", 1).alias("chg13w_bn"),
                      F.bround("netliq_chg13w_z", 2).alias("chg13w_z"), trend.alias("trend"))
    return out.join(check, "panel_id", "left") if check is not None else out


def publish_flow_history(snapshots: DataFrame) -> DataFrame:
    """Since when the usable record runs, and how much older history is not usable."""
    own = F.coalesce(F.col("source").isin(list(ISSUER_SOURCES)), F.lit(False))
    return snapshots.groupBy("panel_id").agg(
        F.min(F.when(own, F.col("date"))).alias("history_since"),
        F.min("date").alias("legacy_history_since"),
        F.count_if(~own).alias("legacy_rows_ignored"))


def gate_document(gates: DataFrame, assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """One nested JSON document per key: horizon -> verdict, symbol -> scores."""
    g = gates.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(
        "horizon", F.struct("passes", "dsr_ratio", "pbo", "profit_factor", "n_trades"))))
        .alias("gate"))
    a = assets.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(
        "symbol", F.struct("force", "lean", "conviction", "horizons")))).alias("assets"))
    return g.join(a, key, "full").select(
        key, F.to_json(F.struct(F.col(key).cast("string").alias("as_of"), "gate", "assets"))
        .alias("payload"))


def positioning_pivot(features: DataFrame, assets: Sequence[str]) -> DataFrame:
    """effective_date x asset, mean index."""
    return features.groupBy("effective_date").pivot("asset", list(assets)).agg(F.avg("idx52"))


def _joined(c: str) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("(none)")


def log_report(log: DataFrame, limit: int = 500) -> DataFrame:
    """Last rows of the state log by ``as_of``: a column for each story that the log's maps hold (found at run
    time; there are as many as registered stories), lists to text."""
    found = [r[0] for r in log.select(F.explode(F.map_keys("stories"))).distinct().orderBy("col").collect()]
    out = log.select("as_of", *[F.col("stories")[s].alias(s) for s in found], F.size("fired").alias("n_fired"),
                     *[_joined(c).alias(c) for c in ("fired", "crowded_long", "crowded_short")])
    return out.orderBy(F.col("as_of").desc()).limit(limit)


def fire_log(log: DataFrame, limit: int = 400) -> DataFrame:
    """The last appended rows, in the order of their appends (not of their sessions)."""
    return log.select("as_of", "generated_at", _joined("fired").alias("fired")).orderBy(
        F.col("generated_at").desc(), F.col("as_of").desc()).limit(limit)


def focus_report(frame: DataFrame, names: Sequence[str], layers: Sequence[str]) -> DataFrame:
    """One row per (instrument, layer) of the latest session of each focus name."""
    focus = frame.filter(F.col("instrument").isin(list(names)))
    last = latest_per_key(focus, ["instrument"], ["session"])
    return last.unpivot(["instrument", "session", "price", "confluence"], list(layers), "layer",
                        "verdict")


#: Days after which an input of the latest state counts as stale.
STALE_DAYS = {"VOLATILITY": 5, "POSITIONING": 14, "FUNDING": 5, "LIQUIDITY": 10, "STRUCTURE": 5, "CONDITIONS": 5}
CELL = "array<struct<metric: string, value: double, text: string>>"


def cells(figures: dict[str, Column], texts: dict[str, Column] | None = None) -> Column:
    """(metric, value, text) entries of one row: figures as numbers, texts as they are."""
    none = F.lit(None)
    made = [F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value"), none.cast("string").alias("text"))
            for k, c in figures.items()]
    made += [F.struct(F.lit(k).alias("metric"), none.cast("double").alias("value"), c.alias("text"))
             for k, c in (texts or {}).items()]
    return F.array(*made)


def latest_block(rows: DataFrame, now: DataFrame, block: str, day: str, entries: Column, have: Column,
                 by: tuple[str, ...] = ("panel_id",)) -> DataFrame:
    """The entries of each key's last usable row known on the panel's last session, with the row's day and age."""
    known = rows.join(now, "panel_id").where(have & (F.col(day) <= F.col("now")))
    last = latest_per_key(known, list(by), [day])
    return last.select("panel_id", "now", F.lit(block).alias("block"), F.col(day).alias("as_of"),
                       F.explode(entries).alias("x")).select("panel_id", "now", "block", "as_of", "x.*")


def latest_state(blocks: dict[str, DataFrame], now: DataFrame) -> DataFrame:
    """All blocks as long rows, each with the age of its own input, and a STALE INPUTS block: an input that is
    missing or older than its limit reads 1, and its block says nothing else."""
    rows = None
    for name, part in blocks.items():
        rows = part if rows is None else rows.unionByName(part)
    age = F.datediff("now", "as_of")
    limit = F.create_map(*[F.lit(x) for kv in STALE_DAYS.items() for x in kv])
    rows = rows.withColumns({"age_days": age, "stale": age > limit[F.col("block")]})
    ages = rows.groupBy("panel_id", "block").agg(F.max("as_of").alias("as_of"), F.min("age_days").alias("age_days"))
    asked = now.select("panel_id", F.explode(F.array(*map(F.lit, STALE_DAYS))).alias("block"))
    late = asked.join(ages, ["panel_id", "block"], "left").select(
        "panel_id", F.lit("STALE INPUTS").alias("block"), "as_of", F.col("block").alias("metric"),
        F.coalesce(F.col("age_days") > limit[F.col("block")], F.lit(True)).cast("double").alias("value"),
        F.lit(None).cast("string").alias("text"), "age_days",
        F.coalesce(F.col("age_days") > limit[F.col("block")], F.lit(True)).alias("stale"))
    return rows.drop("now").unionByName(late)
