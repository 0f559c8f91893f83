"""The registry of readings: how many independent signals does the state panel hold?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import matrices as mx
from tidepanel.session import materialise

STORY_CODE = {"HOLDING": 1.0, "WEAK": 0.0, "BROKEN": -1.0}
PLUMBING = ("vol_term_stale_days", "breadth_n", "struct_n_struct_assets")
KEYS = ("panel_id", "session", "sess_no")


def numeric_registry(panel: DataFrame, per_asset: bool = False) -> DataFrame:
    """Readings as numbers: story states become -1/0/1, missing stays missing."""
    keep = []
    codes = F.create_map(*[F.lit(x) for kv in STORY_CODE.items() for x in kv])
    for c, kind in panel.dtypes:
        if c in KEYS or c in PLUMBING:
            continue
        if c.startswith("cot_") and not per_asset and c != "cot_n_crowded":
            continue
        keep.append(codes[F.col(c)].alias(c) if kind == "string"
                    else F.col(c).cast("double").alias(c))
    return panel.select(*KEYS, *keep)


def readings(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in KEYS]


def differences(registry: DataFrame) -> DataFrame:
    w = Window.partitionBy("panel_id").orderBy("session")
    return registry.select(*KEYS, *[(F.col(c) - F.lag(c, 1).over(w)).alias(c)
                                    for c in readings(registry)])


def with_values(registry: DataFrame, least: int = 250) -> list[str]:
    """Readings with at least so many values; one row of counts is read on the driver."""
    names = readings(registry)
    counts = registry.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if counts[c] >= least]


def surviving(registry: DataFrame, least: int = 250) -> tuple[DataFrame, list[str]]:
    """Drop near-empty readings, then incomplete sessions, then constant readings. The
    column manifest is one row of counts, so it is read on the driver."""
    names = with_values(registry, least)
    full = registry.select(*KEYS, *names).na.drop("any", subset=names)
    spread = full.agg(*[F.stddev_samp(c).alias(c) for c in names]).first()
    names = [c for c in names if spread[c] is not None and spread[c] > 0]
    return full.select(*KEYS, *names), names


def long_form(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(KEYS), list(names), "reading", "value")


def spearman_matrix(complete: DataFrame, names: Sequence[str]) -> DataFrame:
    """Average ranks per reading, then the correlation of the ranks."""
    ranked = mx.average_rank(long_form(complete, names), "value", ["panel_id", "reading"], "r")
    vec = mx.pack(ranked, names, "r", key="reading", by=KEYS)
    return mx.corr_matrix(vec, names)


def top_pairs(corr: DataFrame, n: int = 15) -> DataFrame:
    return (corr.filter("a < b and corr is not null")
                .select("a", "b", F.abs("corr").alias("abs_corr"))
                .orderBy(F.col("abs_corr").desc(), "a", "b").limit(n))


def episodes(decorrelation: DataFrame, sessions: int) -> DataFrame:
    d = decorrelation.filter("decorrelation is not null")
    return d.groupBy("panel_id").agg(
        F.median("decorrelation").alias("median_days"), F.max("decorrelation").alias("max_days"),
        F.round(sessions / F.median("decorrelation"), 1).alias("episodes_at_median"),
        F.sort_array(F.collect_set(F.when(F.col("decorrelation") == 500.0, F.col("reading"))))
        .alias("never_decorrelated"))


# --- the report over all scopes and modes, as one keyed plan -----------------

SCOPES = ("market_level", "with_per_asset_cot")
MODES = ("level", "change")
GROUP = ("panel_id", "scope", "mode")
CAP_DAYS = 500.0


def is_per_asset(reading: str) -> Column:
    return F.col(reading).startswith("cot_") & (F.col(reading) != "cot_n_crowded")


def keyed_readings(panel: DataFrame, digits: int | None = None) -> DataFrame:
    """(panel_id, scope, mode, session, sess_no, reading, value): every reading as it is and as its change
    from the session before, in each scope it belongs to. ``digits`` rounds values before they are ranked."""
    wide = numeric_registry(panel, per_asset=True)
    names = readings(wide)

    def stacked(frame: DataFrame, mode: str) -> DataFrame:
        return long_form(frame, names).withColumn("mode", F.lit(mode))

    rows = stacked(wide, "level").unionByName(stacked(differences(wide), "change"))
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    scopes = F.when(is_per_asset("reading"), F.array(F.lit(SCOPES[1]))).otherwise(F.array(*map(F.lit, SCOPES)))
    return rows.select("panel_id", F.explode(scopes).alias("scope"), "mode", "session", "sess_no", "reading",
                       (value if digits is None else F.round(value, digits)).alias("value"))


def complete_cases(rows: DataFrame, least: int = 250) -> DataFrame:
    """Of each key: readings with ``least`` values, then sessions on which all of those have one, then readings that
    are not constant there. Counts and spreads are grouped by key, so no manifest goes through the driver."""
    key = list(GROUP)
    full = rows.groupBy(*key, "reading").agg(F.count("value").alias("n")).where(F.col("n") >= least)
    width = full.groupBy(*key).agg(F.count("*").alias("width"))
    rows = rows.where("value IS NOT NULL").join(full.drop("n"), [*key, "reading"], "left_semi")
    whole = rows.groupBy(*key, "session").agg(F.count("*").alias("have")).join(width, key).where("have = width")
    rows = rows.join(whole.select(*key, "session"), [*key, "session"], "left_semi")
    moving = rows.groupBy(*key, "reading").agg(F.stddev_samp("value").alias("sd")).where("sd > 0")
    return rows.join(moving.drop("sd"), [*key, "reading"], "left_semi")


def keyed_correlations(cases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank correlations of complete cases, per key: (panel_id, scope, mode, a, b, n, corr)."""
    ranked = mx.average_rank(cases, "value", [*GROUP, "reading"], "r")
    vectors = mx.pack(ranked, names, "r", key="reading", by=(*GROUP, "session", "sess_no"))
    return mx.corr_matrix(vectors, names, GROUP)


def dimension_rows(rows: DataFrame, cases: DataFrame, corr: DataFrame) -> DataFrame:
    """One row per scope and mode: readings and sessions used, readings dropped, effective dimension. A key with
    too few readings to measure has its counts and no dimension."""
    key = list(GROUP)
    asked = rows.groupBy(*key).agg(F.count_distinct("reading").alias("asked"))
    used = cases.groupBy(*key).agg(F.count_distinct("session").alias("rows_used"), F.min("session").alias("since"),
                                   F.max("session").alias("until"), F.count_distinct("reading").alias("kept"))
    dims = mx.effective_dimension(corr.where("corr IS NOT NULL"), key)
    return asked.join(used, key, "left").join(dims, key, "left").select(
        *key, F.coalesce("n_columns", "kept", F.lit(0)).cast("long").alias("n_columns"),
        F.coalesce("rows_used", F.lit(0)).alias("rows_used"), "since", "until",
        (F.col("asked") - F.coalesce("kept", F.lit(0))).alias("columns_dropped"), "participation_ratio", "n_for_90pct",
        "absorption")


def market_row(returns: DataFrame, names: Sequence[str], window: int = 60, gaps: int = 5) -> DataFrame:
    """The same row for the returns of all instruments over the last ``window`` sessions; an instrument with more
    than ``gaps`` missing returns is left out."""
    recent = returns.where(F.col("sess_no") >= F.col("n_sessions") - window).where("ret IS NOT NULL")
    enough = recent.groupBy("panel_id", "instrument").agg(F.count("*").alias("n")).where(F.col("n") >= window - gaps)
    recent = recent.join(enough.drop("n"), ["panel_id", "instrument"], "left_semi")
    span = recent.groupBy("panel_id").agg(F.count_distinct("session").alias("rows_used"), F.min("session").alias("since"),
                                          F.max("session").alias("until"))
    dims = mx.effective_dimension(mx.corr_matrix(mx.pack(recent, names, "ret"), names).where("corr IS NOT NULL"))
    kept = recent.groupBy("panel_id").agg((F.lit(len(names)) - F.count_distinct("instrument")).alias("columns_dropped"))
    return dims.join(span, "panel_id").join(kept, "panel_id").select(
        "panel_id", F.lit("whole_market").alias("scope"), F.lit("return").alias("mode"), "n_columns", "rows_used",
        "since", "until", "columns_dropped", "participation_ratio", "n_for_90pct", "absorption")


def redundant_pairs(corr: DataFrame, n: int = 15, by: Sequence[str] = GROUP) -> DataFrame:
    """The n most alike pairs of each key, with their place."""
    order = Window.partitionBy(*by).orderBy(F.col("abs_corr").desc(), "a", "b")
    return (corr.where("a < b AND corr IS NOT NULL").select(*by, "a", "b", F.abs("corr").alias("abs_corr"))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= n))


def placed_pairs(corr: DataFrame, groups: DataFrame, decorrelation: DataFrame, n: int = 15) -> DataFrame:
    """Pairs of one matrix with their families and decorrelation times, ranked overall and among pairs of their
    kind (within one family or across two)."""
    of = groups.select("panel_id", "reading", "family").join(
        decorrelation.select("panel_id", "reading", "decorrelation"), ["panel_id", "reading"], "left")
    rows = corr.where("a < b AND corr IS NOT NULL").select("panel_id", "a", "b", F.abs("corr").alias("abs_corr"))
    for side in "ab":
        rows = rows.join(of.select("panel_id", F.col("reading").alias(side), F.col("family").alias(f"family_{side}"),
                                   F.col("decorrelation").alias(f"days_{side}")), ["panel_id", side])
    kind = F.when(F.col("family_a") == F.col("family_b"), "within").otherwise("across")
    strongest = [F.col("abs_corr").desc(), F.col("a"), F.col("b")]
    rows = rows.withColumn("kind", kind).withColumns({
        "place": F.row_number().over(Window.partitionBy("panel_id").orderBy(*strongest)),
        "place_in_kind": F.row_number().over(Window.partitionBy("panel_id", "kind").orderBy(*strongest))})
    return rows.where((F.col("place") <= n) | (F.col("place_in_kind") <= n))


def episode_row(decorrelation: DataFrame, sessions: DataFrame) -> DataFrame:
    """Independent looks: sessions over the median and over the longest decorrelation time."""
    d = decorrelation.where("decorrelation IS NOT NULL").groupBy("panel_id").agg(
        F.median("decorrelation").alias("median_days"), F.max("decorrelation").alias("max_days"),
        F.count_if(F.col("decorrelation") == CAP_DAYS).alias("never_decorrelated"))
    span = sessions.groupBy("panel_id").agg(F.count_distinct("session").alias("sessions"))
    return d.join(span, "panel_id").select(
        "panel_id", "median_days", "max_days", F.round(F.col("sessions") / F.col("median_days"), 1).alias("episodes_at_median"),
        F.round(F.col("sessions") / F.col("max_days"), 1).alias("episodes_at_max"), "never_decorrelated")


def registry_report(panel: DataFrame, returns: DataFrame, instruments: Sequence[str], least: int = 250
                    ) -> tuple[DataFrame, DataFrame]:
    """The report's dimension rows (scopes x modes and the whole market), and its long form
    (section, item, metric, value): dimensions, episodes, pairs by kind, families, readings."""
    panel = materialise(panel, "registry-panel")
    names = [c for c in readings(numeric_registry(panel, per_asset=True))]
    rows = materialise(keyed_readings(panel), "registry-rows")
    cases = materialise(complete_cases(rows, least), "registry-cases")
    corr = materialise(keyed_correlations(cases, names), "registry-correlations")
    dims = materialise(dimension_rows(rows, cases, corr).unionByName(market_row(returns, instruments)), "registry-dimensions")
    base = corr.where((F.col("scope") == SCOPES[0]) & (F.col("mode") == MODES[0]))
    levels = rows.where((F.col("scope") == SCOPES[0]) & (F.col("mode") == MODES[0]))
    enough = levels.groupBy("panel_id", "reading").agg(F.count("value").alias("n")).where(F.col("n") >= least)
    times = materialise(mx.decorrelation_times(levels.join(enough.drop("n"), ["panel_id", "reading"], "left_semi")),
                        "registry-decorrelation")
    groups = materialise(mx.families(base.where("corr IS NOT NULL")), "registry-families")
    pairs = placed_pairs(base, groups, times)

    def cells(df: DataFrame, section: str, item: Column, metrics: Sequence[str]) -> DataFrame:
        made = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select("panel_id", F.lit(section).alias("section"), item.alias("item"), F.explode(made).alias("x")).select(
            "panel_id", "section", "item", "x.*")

    parts = [
        cells(dims, "dimension", F.concat_ws("/", "scope", "mode"),
              ["n_columns", "rows_used", "columns_dropped", "participation_ratio", "n_for_90pct", "absorption"]),
        cells(episode_row(times, levels), "episodes", F.lit("market_level"),
              ["median_days", "max_days", "episodes_at_median", "episodes_at_max", "never_decorrelated"]),
        cells(pairs, "pair", F.concat_ws(" | ", "a", "b"),
              ["abs_corr", "place", "place_in_kind", "family_a", "family_b", "days_a", "days_b"]),
        cells(groups.groupBy("panel_id", "family").agg(F.count("*").alias("members")), "family",
              F.col("family").cast("string"), ["members"]),
        cells(times.join(groups, ["panel_id", "reading"], "left"), "reading", F.col("reading"),
              ["decorrelation", "family", "position"])]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return dims, long


def coverage(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """n, first and last session and share missing of every column, of any type, in one pass."""
    as_text = panel.select("session", *[F.col(c).cast("string").alias(c) for c in names])
    rows = as_text.unpivot(["session"], list(names), "column", "value")
    total = F.count(F.lit(1))
    return rows.groupBy("column").agg(
        F.count("value").alias("n"),
        F.min(F.when(F.col("value").isNotNull(), F.col("session"))).alias("first"),
        F.max(F.when(F.col("value").isNotNull(), F.col("session"))).alias("last"),
        F.bround(1 - F.count("value") / total, 4).alias("pct_null"))
