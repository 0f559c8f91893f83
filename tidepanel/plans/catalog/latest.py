"""The state panel as a product, its histories and the latest state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import session as env
from tidepanel.operators import rules as ru
from tidepanel.plans import registries as rg
from tidepanel.plans import reports as rp
from tidepanel.plans.catalog.alignment import _LIQ, _RATES
from tidepanel.plans.catalog.rules import _COND, _CROWD, _INPUTS, _STORIES, _SURF, _state
from tidepanel.plans.catalog.sections import _SRC, _gap_ewm
from tidepanel.plans.oracle import sql
from tidepanel.plans.registry import query
from tidepanel.plans.state import State
from tidepanel.plans.views import PRIORITY_ASSETS, Views
from tidepanel.sources import landing as ld
from tidepanel.sources import store as st
from tidepanel.universe import CONDITION_IDS, POSITIONED, STORIES


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_VOL = ("vix", "vrp", "vrp_pct", "vix_pct", "term_ratio", "term_stale_days", "vvix", "skew", "skew_pct", "rv20")
_LIQUIDITY = ("netliq", "netliq_chg13w", "netliq_chg13w_z", "rrp", "walcl", "tga")
_FUNDING = ("z156", "idx52w", "funding_1d_annualized_pct")
_IDS = [s[0] for s in STORIES]
#: Columns that come from eigenvalues: SQL says on which sessions they have a value, not which.
_EIGEN = ("struct_absorption", "struct_top1_share", "cond_ABSORPTION_SPIKE")


def _filled(table: str, day: str, columns, prefix: str) -> str:
    """Columns of a dated table on each session: the value of that day, else the last one met."""
    return "SELECT c.session, " + ", ".join(
        f"last_value(t.{c} IGNORE NULLS) OVER (ORDER BY c.session ROWS UNBOUNDED PRECEDING) AS {prefix}{c}"
        for c in columns) + f" FROM cal c LEFT JOIN {table} t ON t.{day} = c.session"


_HELD = sorted(PRIORITY_ASSETS.values())
_PANEL = dict(
    _SURF, **_LIQ, **_RATES, **_CROWD, **_STORIES, inputs=_INPUTS, src=_SRC, e50=_gap_ewm(50), e200=_gap_ewm(200),
    breadth="""SELECT c.session, avg((s.close > a.y)::INT) FILTER (s.k >= 199) AS breadth_above_50,
      avg((s.close > b.y)::INT) FILTER (s.k >= 199) AS breadth_above_200, count(s.k) FILTER (s.k >= 199) AS breadth_n
      FROM cal c LEFT JOIN src s ON s.session = c.session LEFT JOIN e50 a ON a.instrument = s.instrument AND a.k = s.k
      LEFT JOIN e200 b ON b.instrument = s.instrument AND b.k = s.k GROUP BY 1""",
    lq=_filled("(SELECT * FROM liq WHERE netliq IS NOT NULL)", "day", _LIQUIDITY, "liq_"),
    fd=_filled("(SELECT *, funding_1d * 36500 AS funding_1d_annualized_pct FROM rf WHERE series_id = 'A')", "date",
               _FUNDING, "fund_"),
    held="SELECT session, " + ", ".join(
        f"max({c}) FILTER (asset = '{a}') AS cot_{c}_{a}" if a in _HELD else f"NULL::DOUBLE AS cot_{c}_{a}"
        for a in POSITIONED for c in ("idx52", "z156", "chg4w"))
    + ", count(*) FILTER (idx52 >= 0.8 OR idx52 <= 0.2) AS cot_n_crowded FROM posday GROUP BY 1",
    told="SELECT session, " + ", ".join(
        f"max({c}) FILTER (story = '{i}') AS story_{label}_{i}" for i in _IDS
        for c, label in (("corr_fast", "corr"), ("corr_slow", "corr_slow"), (_state("corr_fast"), "state")))
    + " FROM hist GROUP BY 1",
    fires="SELECT session, " + ", ".join(f"coalesce({c}, false)::DOUBLE AS cond_{k}" for k, c in _COND.items())
    + " FROM inputs",
    st="SELECT s.session, s.sess_no, " + ", ".join(f"s.{c} AS vol_{c}" for c in _VOL)
    + ", lq.* EXCLUDE (session), fd.* EXCLUDE (session), CASE WHEN s.sess_no >= 60 THEN 1.0 END AS struct_absorption, "
      "CASE WHEN s.sess_no >= 60 THEN 1.0 END AS struct_top1_share, breadth.* EXCLUDE (session), held.* EXCLUDE (session), "
      "told.* EXCLUDE (session), " + ", ".join(f"CASE WHEN s.sess_no >= 60 THEN cond_{k} END AS cond_{k}" for k in _COND)
    + " FROM surf s" + "".join(f" LEFT JOIN {t} USING (session)" for t in ("lq", "fd", "breadth", "held", "told", "fires")))
_COLUMNS = [*[f"vol_{c}" for c in _VOL], *[f"liq_{c}" for c in _LIQUIDITY], *[f"fund_{c}" for c in _FUNDING],
            "struct_absorption", "struct_top1_share", "breadth_above_50", "breadth_above_200", "breadth_n",
            *[f"cot_{c}_{a}" for a in POSITIONED for c in ("idx52", "z156", "chg4w")], "cot_n_crowded",
            *[f"story_{x}_{i}" for i in _IDS for x in ("corr", "corr_slow", "state")], *[f"cond_{k}" for k in CONDITION_IDS]]
_TEXTS = [f"story_state_{i}" for i in _IDS]
_READS = "bars cal panel posday levels tga rates grid"


@query("k03_panel_coverage", sql(_READS, """
SELECT "column", n, first, last, round_even(1 - n / (SELECT count(*) FROM cal), 4) AS pct_null FROM (
""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, min(session) FILTER ({c} IS NOT NULL) AS first,
  max(session) FILTER ({c} IS NOT NULL) AS last FROM st""" for c in _COLUMNS) + ")", recursive=True, **_PANEL))
def k03(v: Views):
    """The panel written as a versioned table, read back, and the coverage of every column of it."""
    panel = State(v, keep=True).panel()
    stored = st.write_panel(panel, env.scratch_path(v.spark, "state-panel"), 1)
    return rg.coverage(stored, [c for c in stored.columns if c not in rg.KEYS])


@query("r14_stated_panel", sql(_READS, "SELECT session, " + ", ".join(
    c if c in _TEXTS or c == "vol_term_stale_days" else f"round({c}, {4 if c == 'vol_vrp' else 6}) AS {c}"
    for c in _COLUMNS if c not in _EIGEN) + " FROM st", recursive=True, **_PANEL))
def r14_stated(v: Views):
    """Every column of the state panel but those from eigenvalues."""
    panel = State(v, keep=True).panel()
    return panel.select("session", *[
        F.col(c) if c in _TEXTS or c == "vol_term_stale_days" else r(c, 4 if c == "vol_vrp" else 6)
        for c in _COLUMNS if c not in _EIGEN])


_REGISTRY = [c for c in _COLUMNS if c not in (*_EIGEN, *rg.PLUMBING) and (not c.startswith("cot_") or c == "cot_n_crowded")]


@query("p08_stated_registry", sql(_READS, "SELECT session, sess_no, " + ", ".join(
    f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in rg.STORY_CODE.items()) + f" END::DOUBLE AS {c}"
    if c in _TEXTS else f"round({c}::DOUBLE, {4 if c == 'vol_vrp' else 6}) AS {c}"
    for c in _REGISTRY) + " FROM st", recursive=True, **_PANEL))
def p08_stated(v: Views):
    """The market-level readings as numbers, without those from eigenvalues."""
    registry = rg.numeric_registry(State(v, keep=True).panel())
    return registry.select("session", "sess_no", *[r(c, 4 if c == "vol_vrp" else 6) for c in _REGISTRY])


# --- log --------------------------------------------------------------------------

def _lists(v: Views):
    """Per session: firing conditions (structure left out), crowded names and story states, as a log row holds them."""
    state = State(v, keep=True)
    fired = state.conditions(with_structure=False).withColumns(ru.condition_columns()).select(
        "panel_id", "session", "sess_no", F.sort_array(ru.fired_list(CONDITION_IDS)).alias("fired"))
    side = state.positions().groupBy("panel_id", "sess_no").agg(
        F.sort_array(F.collect_set(F.when(F.col("idx52") >= 0.8, F.col("asset")))).alias("crowded_long"),
        F.sort_array(F.collect_set(F.when(F.col("idx52") <= 0.2, F.col("asset")))).alias("crowded_short"))
    told = state.stories().groupBy("panel_id", "sess_no").agg(
        F.map_from_entries(F.collect_list(F.struct("story", "state"))).alias("stories"))
    return fired.join(side, ["panel_id", "sess_no"], "left").join(told, ["panel_id", "sess_no"], "left")


def _landed_log(v: Views):
    """The log of two collectors, one for even and one (later) for odd sessions, appended as JSON lines."""
    rows = env.materialise(_lists(v), "log-rows")
    path = env.scratch_path(v.spark, "log")
    for part, day in ((0, "2002-01-01"), (1, "2002-03-01")):
        stamp = F.date_format(F.timestamp_add("MINUTE", "sess_no", F.lit(f"{day} 00:00:00").cast("timestamp")),
                              "yyyy-MM-dd HH:mm:ss")
        rows.where(F.col("sess_no") % 2 == part).select(
            F.col("session").cast("string").alias("as_of"), stamp.alias("generated_at"), "fired", "crowded_long",
            "crowded_short", "stories").write.mode("append").json(path)
    return ld.read_log(v.spark, path)


def _names(test: str) -> str:
    return f"coalesce(string_agg(asset, ', ' ORDER BY asset) FILTER ({test}), '(none)')"


_FIRED = "array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {c} THEN '{k}' END" for k, c in _COND.items()) + "], lambda e: e IS NOT NULL)), ', ')"
_LOG = dict(
    _SURF, **_LIQ, **_CROWD, **_STORIES, inputs=_INPUTS,
    told="SELECT session, " + ", ".join(f"max(state) FILTER (story = '{i}') AS {i}" for i in _IDS)
    + f" FROM (SELECT session, story, {_state('corr_fast')} AS state FROM hist) GROUP BY 1",
    sides=f"SELECT session, {_names('idx52 >= 0.8')} AS crowded_long, {_names('idx52 <= 0.2')} AS crowded_short FROM posday GROUP BY 1",
    lg=f"""SELECT CAST(session AS VARCHAR) AS as_of, CASE WHEN f = '' THEN '(none)' ELSE f END AS fired,
      CASE WHEN f = '' THEN 0 ELSE CAST(len(string_split(f, ', ')) AS INT) END AS n_fired, told.* EXCLUDE (session),
      crowded_long, crowded_short, strftime(CASE WHEN sess_no % 2 = 0 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2002-03-01' END
        + to_minutes(sess_no), '%Y-%m-%d %H:%M:%S') AS generated_at
      FROM (SELECT session, {_FIRED} AS f FROM inputs) JOIN cal USING (session) LEFT JOIN told USING (session)
      LEFT JOIN sides USING (session)""")


@query("k14_history_report", sql("bars cal panel posday levels tga", "SELECT as_of, " + ", ".join(_IDS) + """,
  n_fired, fired, crowded_long, crowded_short FROM lg ORDER BY as_of DESC LIMIT 500""", **_LOG))
def k14(v: Views):
    return rp.log_report(_landed_log(v))


@query("k14_fire_log", sql("bars cal panel posday levels tga", """
SELECT as_of, generated_at, fired FROM lg ORDER BY generated_at DESC, as_of DESC LIMIT 400""", **_LOG))
def k14_fires(v: Views):
    return rp.fire_log(_landed_log(v))


# --- latest state -----------------------------------------------------------------

def _latest(v: Views):
    state = State(v, keep=True)
    now = v.calendar().groupBy("panel_id").agg(F.max("session").alias("now"))
    vol = rp.latest_block(state.vol(), now, "VOLATILITY", "session", rp.cells(
        {c: F.col(c) for c in ("vix", "vrp", "vrp_pct", "term_ratio", "vvix", "skew", "rv20")},
        {"structure": F.col("structure")}), F.col("vix").isNotNull())
    side = ru.crowd_side("idx52")
    known = state.features().where("idx52 IS NOT NULL")
    crowd = rp.latest_block(known, now, "POSITIONING", "effective_date", F.when(side != "neutral", F.array(F.struct(
        F.col("asset").alias("metric"), F.col("idx52").alias("value"), side.alias("text")))).otherwise(
        F.array().cast(rp.CELL)), F.lit(True), ("panel_id", "asset"))
    counted = rp.latest_block(known, now, "POSITIONING", "effective_date", rp.cells({"assets known": F.lit(1)}), F.lit(True),
                              ("panel_id", "asset")).groupBy("panel_id", "now", "block", "metric").agg(
        F.max("as_of").alias("as_of"), F.sum("value").alias("value")).withColumn("text", F.lit(None).cast("string"))
    fund = rp.latest_block(state.funding(), now, "FUNDING", "date", rp.cells(
        {"annualised %": F.col("funding_1d_annualized_pct"), "z156": F.col("z156")}), F.col("funding_1d").isNotNull())
    liq = rp.latest_block(state.liquidity(), now, "LIQUIDITY", "day", rp.cells(
        {c: F.col(c) for c in ("netliq", "netliq_chg13w", "netliq_chg13w_z", "walcl", "tga", "rrp")}), F.lit(True))
    struct = state.structure().join(v.calendar().select("panel_id", "sess_no", "session"), ["panel_id", "sess_no"])
    eigen = rp.latest_block(struct, now, "STRUCTURE", "session", rp.cells(
        {"absorption": F.col("absorption"), "top1_share": F.col("top1_share"), "window": F.lit(60),
         "assets": F.col("n_struct_assets")}), F.col("absorption").isNotNull())
    inputs = state.conditions().withColumns(ru.condition_columns())
    fires = rp.latest_block(inputs, now, "CONDITIONS", "session", rp.cells(
        {c: F.col(c).cast("int") for c in CONDITION_IDS}), F.lit(True))
    return rp.latest_state({"v": vol, "p": crowd.unionByName(counted), "f": fund, "l": liq, "s": eigen, "c": fires}, now)


_ROW = "SELECT '{block}' AS block, {day} AS as_of, '{metric}' AS metric, {value}::DOUBLE AS value, {text} AS text FROM {table}"


def _row(block: str, table: str, day: str, metric: str, value: str = "NULL", text: str = "NULL::VARCHAR") -> str:
    return _ROW.format(block=block, table=table, day=day, metric=metric, value=value, text=text)


_NOW = "(SELECT max(session) FROM cal)"
_LATEST = dict(
    _SURF, **_LIQ, **_RATES, **_CROWD, inputs=_INPUTS,
    lv="""SELECT *, CASE WHEN term_ratio >= 1 THEN 'backwardation' WHEN term_ratio IS NOT NULL THEN 'contango' END AS structure
      FROM surf WHERE vix IS NOT NULL ORDER BY session DESC LIMIT 1""",
    lp=f"""SELECT * FROM feats WHERE idx52 IS NOT NULL AND effective_date <= {_NOW}
      QUALIFY row_number() OVER (PARTITION BY asset ORDER BY report_date DESC) = 1""",
    lf=f"SELECT * FROM rf WHERE series_id = 'A' AND funding_1d IS NOT NULL AND date <= {_NOW} ORDER BY date DESC LIMIT 1",
    ll=f"SELECT * FROM liq WHERE netliq IS NOT NULL AND day <= {_NOW} ORDER BY day DESC LIMIT 1",
    ls=f"SELECT {_NOW} AS session, (SELECT count(DISTINCT instrument) FROM panel WHERE instrument IN ("
       + ", ".join(f"'{n}'" for n in POSITIONED) + ")) AS n",
    lc="SELECT * FROM inputs ORDER BY session DESC LIMIT 1",
    cells=" UNION ALL ".join(
        [_row("VOLATILITY", "lv", "session", c, c) for c in ("vix", "vrp", "vrp_pct", "term_ratio", "vvix", "skew", "rv20")]
        + [_row("VOLATILITY", "lv", "session", "structure", text="structure"),
           """SELECT 'POSITIONING', effective_date, asset, idx52, CASE WHEN idx52 >= 0.8 THEN 'crowded long'
             ELSE 'crowded short' END FROM lp WHERE idx52 >= 0.8 OR idx52 <= 0.2""",
           "SELECT 'POSITIONING', max(effective_date), 'assets known', count(*)::DOUBLE, NULL FROM lp",
           _row("FUNDING", "lf", "date", "annualised %", "funding_1d * 36500"), _row("FUNDING", "lf", "date", "z156", "z156")]
        + [_row("LIQUIDITY", "ll", "day", c, c) for c in ("netliq", "netliq_chg13w", "netliq_chg13w_z", "walcl", "tga", "rrp")]
        + [_row("STRUCTURE", "ls", "session", "window", "60"), _row("STRUCTURE", "ls", "session", "assets", "n")]
        + [_row("CONDITIONS", "lc", "session", k, f"coalesce({c}, false)::INT") for k, c in _COND.items()
           if k != "ABSORPTION_SPIKE"]),
    limits="SELECT * FROM (VALUES " + ", ".join(f"('{b}', {d})" for b, d in rp.STALE_DAYS.items()) + ") t(block, days)",
    aged=f"SELECT c.*, CAST({_NOW} - as_of AS INT) AS age_days, {_NOW} - as_of > days AS stale FROM cells c JOIN limits USING (block)")


@query("k16_latest_state", sql("panel posday levels tga rates cal bars", """
SELECT block, as_of, metric, round(value, 6) AS value, text, age_days, stale FROM aged UNION ALL
SELECT 'STALE INPUTS', max(as_of), l.block, coalesce(bool_and(stale), true)::INT, NULL, min(age_days),
  coalesce(bool_and(stale), true) FROM limits l LEFT JOIN aged a ON a.block = l.block GROUP BY l.block""", **_LATEST))
def k16(v: Views):
    """Six blocks and the stale inputs; eigenvalue readings are k16_latest_structure's."""
    return _latest(v).where(~F.col("metric").isin("absorption", "top1_share", "ABSORPTION_SPIKE")).select(
        "block", "as_of", "metric", r("value"), "text", "age_days", "stale")


@query("k16_latest_structure")
def k16_structure(v: Views):
    return _latest(v).where(F.col("metric").isin("absorption", "top1_share", "ABSORPTION_SPIKE")).select(
        "block", "as_of", "metric", r("value"), "age_days", "stale")


# --- histories by series -----------------------------------------------------------

_VOL_HISTORY = ("spy", "vix", "vix9d", "vix3m", "vvix", "skew", "rv20", "vrp", "term_ratio", "vrp_pct", "vix_pct", "skew_pct",
                "vvix_pct", "term_ratio_pct")
_LIQ_HISTORY = ("walcl", "tga", "rrp", "netliq", "netliq_chg13w", "netliq_chg4w_z", "netliq_chg13w_z")


def _long(table: str, series: str, day: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{series}' AS series, {day} AS day, '{c}' AS metric, "
                              f"round({c}, {4 if c == 'vrp' else 6}) AS value FROM {table}" for c in columns)


@query("k17_series_history", sql("bars cal levels tga rates", " UNION ALL ".join((
    _long("surf", "volatility", "session", _VOL_HISTORY),
    _long("(SELECT * FROM liq WHERE netliq IS NOT NULL)", "liquidity", "day", _LIQ_HISTORY),
    _long("(SELECT * FROM rf WHERE series_id = 'A')", "funding", "date", ("funding_1d", "z156", "idx52w")))),
    **_SURF, **_LIQ, **_RATES))
def k17(v: Views):
    """Volatility, liquidity and funding histories, whole, as long rows."""
    state = State(v)
    parts = (("volatility", state.vol(), "session", _VOL_HISTORY), ("liquidity", state.liquidity(), "day", _LIQ_HISTORY),
             ("funding", state.funding(), "date", ("funding_1d", "z156", "idx52w")))
    out = None
    for name, rows, day, columns in parts:
        part = rows.select(F.lit(name).alias("series"), F.col(day).alias("day"), *[
            F.col(c).cast("double").alias(c) for c in columns]).unpivot(["series", "day"], list(columns), "metric", "value")
        out = part if out is None else out.unionByName(part)
    value = F.when(F.col("metric") == "vrp", F.round("value", 4)).otherwise(F.round("value", 6))
    return out.select("series", "day", "metric", value.alias("value"))


@query("k17_structure_history")
def k17_structure(v: Views):
    state = State(v)
    return state.structure().join(v.calendar().select("panel_id", "sess_no", "session"), ["panel_id", "sess_no"]).select(
        "session", r("absorption"), r("top1_share"), "n_struct_assets")
