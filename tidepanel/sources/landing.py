"""Readers and parsers for landed files: declared schemas, tolerant casts, no inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel import schemas
from tidepanel.functions.calendar import epoch_date
from tidepanel.functions.scalars import parse_number
from tidepanel.operators.merge import keep_one, resolve_priority
from tidepanel.session import child_names
from tidepanel.universe import BALANCE_LABELS, POSITIONING_CONTRACTS


def read_tabular(spark: SparkSession, path: str, schema: StructType | str | None = None,
                 **options) -> DataFrame:
    """CSV or Parquet by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "parquet"):
        raise ValueError(f"unsupported file type: {path}")
    reader = spark.read.options(**({"header": "true", **options} if suffix == "csv" else options))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path) if suffix == "csv" else reader.parquet(path)


def read_symbol_files(spark: SparkSession, folder: str, schema: StructType | str,
                      suffix: str = ".csv", limit: int | None = None) -> DataFrame:
    """One file per symbol; the symbol is the file's stem. One distributed scan. A limit on the number of
    symbols takes the first names in order, and other files are not opened."""
    reader = spark.read.schema(schema).option("pathGlobFilter", f"*{suffix}")
    paths = folder
    if limit is not None:
        paths = [f"{folder}/{n}" for n in sorted(child_names(spark, folder) or []) if n.endswith(suffix)][:limit]
        if not paths:
            return symbol_of_file(reader.parquet(folder).limit(0), suffix)
    rows = reader.option("header", "true").csv(paths) if suffix == ".csv" else reader.parquet(
        *([paths] if isinstance(paths, str) else paths))
    return symbol_of_file(rows, suffix)


def symbol_of_file(rows: DataFrame, suffix: str, out: str = "instrument") -> DataFrame:
    stem = F.regexp_replace("_metadata.file_name", F.lit(suffix.replace(".", r"\.") + "$"),
                            F.lit(""))
    return rows.select("*", F.upper(stem).alias(out))


def dump_fields(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()
                ) -> DataFrame:
    """The include list if there is one, else every column not excluded."""
    if include:
        return df.select(*[c for c in include if c in df.columns])
    return df.select(*[c for c in df.columns if c not in set(exclude)])


def parse_chart(texts: DataFrame, text: str = "payload", keys: Sequence[str] = ("instrument",)
                ) -> DataFrame:
    """Parallel arrays of a chart document to bars. A missing adjusted close is the
    close; rows without a close are dropped; the last row of a date wins."""
    doc = texts.select(*keys, F.from_json(text, schemas.CHART).alias("d"))
    result = F.element_at("d.chart.result", 1)
    doc = doc.select(*keys, result["timestamp"].alias("ts"),
                     F.element_at(result["indicators"]["quote"], 1).alias("q"),
                     F.element_at(result["indicators"]["adjclose"], 1)["adjclose"].alias("adj"))
    zipped = F.arrays_zip("ts", "q.open", "q.high", "q.low", "q.close", "q.volume",
                          F.coalesce("adj", "q.close").alias("adj"))
    rows = doc.select(*keys, F.posexplode(zipped).alias("pos", "z"))
    names = ["open", "high", "low", "close", "volume"]
    flat = rows.select(*keys, "pos", epoch_date("z.ts").alias("session"),
                       *[F.col("z")[n].alias(n) for n in names],
                       F.col("z")["adj"].alias("adjclose"))
    flat = flat.filter(F.col("close").isNotNull())
    return keep_one(flat, [*keys, "session"], ["pos"]).drop("pos")


def parse_index_history(rows: DataFrame, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """Index history with untidy headers: prices coerced, volume 0, adjusted close is the
    close, zero placeholders and unreadable closes dropped."""
    tidy = rows.toDF(*[c if c in keys else c.strip().upper() for c in rows.columns])
    prices = [F.trim(c.upper()).try_cast("double").alias(c)
              for c in ("open", "high", "low", "close")]
    out = tidy.select(*keys, F.to_date(F.trim("DATE")).alias("session"), *prices)
    return (out.filter(F.col("close") > 0)
               .withColumn("volume", F.lit(0.0)).withColumn("adjclose", F.col("close")))


def contract_table(spark: SparkSession) -> DataFrame:
    rows = [(code, asset, sign) for code, (asset, sign) in POSITIONING_CONTRACTS.items()]
    return spark.createDataFrame(rows, "code string, asset string, sign int")


def rename_position_json(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({
        "cftc_contract_market_code": "code", "report_date_as_yyyy_mm_dd": "report_date",
        "noncomm_positions_long_all": "nc_long", "noncomm_positions_short_all": "nc_short",
        "open_interest_all": "oi"})


def rename_position_delimited(rows: DataFrame) -> DataFrame:
    """Annual delimited reports: headers vary in case, blanks and wording."""
    lower = rows.toDF(*[c.strip().lower() for c in rows.columns])

    def either(*names: str) -> Column:
        found = [F.col(f"`{n}`") for n in names if n in lower.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")
    return lower.select(
        F.trim(either("cftc contract market code")).alias("code"),
        either("as of date in form yyyy-mm-dd", "report date as yyyy-mm-dd").alias("report_date"),
        either("noncommercial positions-long (all)").alias("nc_long"),
        either("noncommercial positions-short (all)").alias("nc_short"),
        either("open interest (all)").alias("oi"))


def normalise_positions(rows: DataFrame, contracts: DataFrame, order: Sequence[str] = ()
                        ) -> DataFrame:
    """Signed net share of open interest per known contract; the last row of a
    (report, asset) wins."""
    known = rows.join(F.broadcast(contracts), "code")
    panel = ["panel_id"] if "panel_id" in rows.columns else []
    values = [F.col(c).cast("string").try_cast("double").alias(c)
              for c in ("nc_long", "nc_short", "oi")]
    tidy = known.select(*panel, "asset", "sign", *order,
                        F.to_date(F.col("report_date").cast("string").substr(1, 10))
                        .alias("report_date"), *values)
    tidy = tidy.na.drop("any", subset=["report_date", "nc_long", "nc_short", "oi"]).filter("oi > 0")
    net = F.col("sign") * (F.col("nc_long") - F.col("nc_short")) / F.col("oi")
    tidy = tidy.withColumn("net_pct", net)
    return keep_one(tidy, [*panel, "report_date", "asset"],
                    list(order) or ["oi"]).select(*panel, "report_date", "asset", "net_pct", "oi")


def parse_rates(texts: DataFrame, text: str = "payload", keys: Sequence[str] = ("series_id",)
                ) -> DataFrame:
    """Hourly records; a null rate is 0; one row per timestamp."""
    recs = texts.select(*keys, F.explode(F.from_json(text, schemas.RATE_RECORDS)["result"])
                        .alias("r"))
    flat = recs.select(*keys, F.col("r.timestamp").alias("ts_ms"),
                       F.coalesce("r.interest_1h", F.lit(0.0)).alias("rate"))
    one = keep_one(flat, [*keys, "ts_ms"], ["rate"], last=False)
    return one.select(*keys, epoch_date("ts_ms", 86_400_000).alias("date"), "ts_ms", "rate")


def parse_observations(texts: DataFrame, text: str = "payload",
                       keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Observations; null, blank and '.' are missing and skipped."""
    obs = texts.select(*keys, F.explode(F.from_json(text, schemas.OBSERVATIONS)["observations"])
                       .alias("o"))
    return (obs.select(*keys, F.to_date("o.date").alias("obs_date"),
                       parse_number("o.value").alias("value"))
               .filter(F.col("value").isNotNull()))


def resolve_balances(rows: DataFrame, keys: Sequence[str] = ("panel_id",)) -> DataFrame:
    """One closing balance per date. The row label and the column that holds the balance
    changed over time; the newest known label wins, never a changeover date."""
    rank, value = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, (label, column) in reversed(list(enumerate(BALANCE_LABELS, 1))):
        here = F.col("account_type") == label
        rank = F.when(here, F.lit(i)).otherwise(rank)
        value = F.when(here, parse_number(column)).otherwise(value)
    ranked = rows.withColumn("rank", rank).withColumn("value", value).filter("rank is not null")
    return resolve_priority(ranked, [*keys, "record_date"], "rank", "value")


def parse_fund_list(texts: DataFrame, text: str = "payload") -> DataFrame:
    """List-shaped fund document: array fields hold (display, raw); assets in millions;
    net asset values are rounded to a cent, which bounds the noise of a flow."""
    docs = texts.select(F.explode(F.from_json(text, schemas.FUND_LIST)
                                  ["data"]["funds"]["etfs"]["datas"]).alias("f"))
    nav = F.element_at("f.nav", 2).try_cast("double")
    aum = F.element_at("f.aum", 2).try_cast("double") * 1e6
    out = docs.select(F.trim(F.regexp_replace("f.fundTicker", "®", "")).alias("ticker"),
                      nav.alias("nav"), aum.alias("aum_usd"),
                      F.to_date(F.element_at("f.asOfDate", 2)).alias("as_of"))
    return _fund_rows(out, "ssga", F.col("shares") * 0.005)


def parse_fund_map(texts: DataFrame, text: str = "payload") -> DataFrame:
    """Map-shaped fund document: nested raw values, yyyyMMdd integer dates."""
    docs = texts.select(F.explode(F.map_values(F.from_json(text, schemas.FUND_MAP))).alias("f"))
    out = docs.select(F.trim("f.localExchangeTicker").alias("ticker"),
                      F.col("f.navAmount.r").alias("nav"),
                      F.col("f.totalNetAssets.r").alias("aum_usd"),
                      F.to_date(F.col("f.navAmountAsOf.r").cast("string"), "yyyyMMdd")
                      .alias("as_of"))
    return _fund_rows(out, "ishares", F.col("nav"))


def _fund_rows(rows: DataFrame, source: str, noise: Column) -> DataFrame:
    good = (F.length("ticker") > 0) & (F.col("nav") > 0) & (F.col("aum_usd") > 0)
    return (rows.filter(good).withColumn("shares", F.col("aum_usd") / F.col("nav"))
                .withColumn("source", F.lit(source)).withColumn("noise_usd", noise))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log. Torn and blank lines are skipped, not fatal."""
    rows = spark.read.schema(schemas.STATE_LOG).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_torn").json(path)
    return rows.filter(F.col("_torn").isNull() & F.col("as_of").isNotNull()).drop("_torn")


def gate_rows(docs: DataFrame, text: str = "payload", ratio_min: float = 1.645,
              pbo_max: float = 0.5) -> DataFrame:
    """Stored verdicts recomputed from their statistics; a missing one cannot pass."""
    rows = docs.select("doc_id", F.explode(F.from_json(text, schemas.SCORE_DOC)["gate"])
                       .alias("horizon", "v"))
    passes = F.coalesce((F.col("v.dsr_ratio") > ratio_min) & (F.col("v.pbo") < pbo_max),
                        F.lit(False))
    stored = F.coalesce("v.passes", F.lit(False))
    return rows.select("doc_id", "horizon", passes.alias("passes"), stored.alias("stored_passes"),
                       (stored & ~passes).alias("superseded"), "v.dsr_ratio", "v.pbo",
                       "v.profit_factor", "v.n_trades")


def asset_rows(docs: DataFrame, text: str = "payload") -> DataFrame:
    rows = docs.select("doc_id", F.explode(F.from_json(text, schemas.SCORE_DOC)["assets"])
                       .alias("symbol", "v"))
    picks = [F.col("v.horizons")[h][f].alias(f"{n}_{h}")
             for h in ("5d", "21d") for f, n in (("score", "score"), ("rank_pct", "rank"),
                                                 ("lean", "lean"))]
    return rows.select("doc_id", "symbol", F.coalesce("v.force", F.lit("?")).alias("force"),
                       "v.lean", "v.conviction", *picks)


def prefer_source(candidates: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Per key the first source that has a row, tagged with its name."""
    frames = [df.withColumn("_source", F.lit(name)).withColumn("__rank", F.lit(i))
              for i, (name, df) in enumerate(candidates)]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    return keep_one(union, keys, ["__rank"], last=False).drop("__rank")


def history_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stored history, or an empty frame of its schema when it was never written. A folder
    that is there but can't be read is an error."""
    if child_names(spark, path) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
