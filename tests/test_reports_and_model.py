"""Registry report, boosting, gated trials, score export, latest state, logs, panel product, symbol scan."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import boosting as bt
from tidepanel.operators import gate, model
from tidepanel.operators import strategies as stg
from tidepanel.plans import registries as rg
from tidepanel.plans import reports as rp
from tidepanel.session import child_names
from tidepanel.sources import landing as ld
from tidepanel.sources import store as st

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=int(i))


# --- registry -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def panels(spark):
    """Two panels of readings: gaps, a constant, a near-empty one, a copy, text states, a per-asset one."""
    rng = np.random.default_rng(7)
    rows = []
    for p, n in (("a", 420), ("b", 330)):
        base = rng.normal(size=(n, 4)).cumsum(axis=0)
        for i in range(n):
            x = [None if rng.random() < 0.05 else float(v) for v in base[i]]
            copy = None if x[0] is None else x[0] * x[0] * x[0]
            rows.append((p, day(i), i, *x, copy, 1.0, 2.0 if i < 5 else None, ["HOLDING", "WEAK", "BROKEN", None][i % 4],
                         float(i % 9)))
    return spark.createDataFrame(rows, "panel_id string, session date, sess_no int, vol_x double, vol_y double, liq_z double, "
                                       "cot_idx52_SPY double, vol_copy double, liq_flat double, liq_rare double, "
                                       "story_state_S string, vol_term_stale_days double")


def expected(frame, scope, mode):
    """The report of one panel, scope and mode with pandas."""
    frame = frame.sort_values("session").drop(columns=["panel_id", "session", "sess_no", "vol_term_stale_days"])
    frame["story_state_S"] = frame.story_state_S.map({"HOLDING": 1.0, "WEAK": 0.0, "BROKEN": -1.0})
    if scope == "market_level":
        frame = frame.drop(columns=[c for c in frame if c.startswith("cot_")])
    asked = frame.shape[1]
    frame = frame.astype(float)
    if mode == "change":
        frame = frame.diff()
    frame = frame.loc[:, frame.notna().sum() >= 200].dropna()
    frame = frame.loc[:, frame.std() > 0]
    c = frame.rank().corr()
    eig = np.sort(np.linalg.eigvalsh(c.to_numpy()))[::-1]
    part = eig / eig.sum()
    return c, (frame.shape[1], len(frame), asked - frame.shape[1], round(1 / (part ** 2).sum(), 2),
               int((np.cumsum(part) < 0.9).sum()) + 1, round(part[:max(1, len(eig) // 4)].sum(), 4))


def test_registry_report_is_pandas_for_every_scope_and_mode(panels):
    rows = rg.keyed_readings(panels).cache()
    cases = rg.complete_cases(rows, 200).cache()
    names = rg.readings(rg.numeric_registry(panels, per_asset=True))
    corr = rg.keyed_correlations(cases, names).cache()
    got = {(r.panel_id, r.scope, r.mode): r for r in rg.dimension_rows(rows, cases, corr).collect()}
    assert len(got) == 8
    for (p, scope, mode), r in got.items():
        matrix, want = expected(panels.where(F.col("panel_id") == p).toPandas(), scope, mode)
        assert (r.n_columns, r.rows_used, r.columns_dropped, r.participation_ratio, r.n_for_90pct) == want[:5]
        assert abs(r.absorption - want[5]) < 1e-3
        pairs = rg.redundant_pairs(corr.where((F.col("panel_id") == p) & (F.col("scope") == scope) & (F.col("mode") == mode)), 3)
        best = sorted((-abs(matrix.loc[x, y]), *sorted((x, y))) for i, x in enumerate(matrix) for y in list(matrix)[:i])[:3]
        found = [(r.a, r.b, r.abs_corr) for r in pairs.orderBy("place").collect()]
        # vol_copy has vol_x's ranks, so their pairs with a third reading tie
        assert found[0][:2] == best[0][1:] and np.allclose([x[2] for x in found], [abs(matrix.loc[a, b]) for a, b, _ in found])
        assert np.allclose([x[2] for x in found], [-v for v, _, _ in best])


def test_registry_report_with_too_few_readings(spark, panels):
    rows = rg.keyed_readings(panels.where("sess_no < 50"))
    cases = rg.complete_cases(rows, 200)
    dims = rg.dimension_rows(rows, cases, rg.keyed_correlations(cases, ["vol_x", "vol_y"])).collect()
    assert len(dims) == 8 and all(r.n_columns == 0 and r.participation_ratio is None for r in dims)


def test_registry_long_report_ranks_pairs_within_and_across_families(spark, panels):
    returns = panels.selectExpr("panel_id", "session", "sess_no", "420 AS n_sessions", "'SPY' AS instrument", "vol_x AS ret").unionByName(
        panels.selectExpr("panel_id", "session", "sess_no", "420", "'TLT'", "vol_y").toDF(
            "panel_id", "session", "sess_no", "n_sessions", "instrument", "ret"))
    dims, long = rg.registry_report(panels, returns, ["SPY", "TLT", "GOLD"], 200)
    assert {r.scope for r in dims.collect()} == {"market_level", "with_per_asset_cot", "whole_market"}
    got = long.where("panel_id = 'a'").toPandas()
    assert set(got.section) == {"dimension", "episodes", "pair", "family", "reading"}
    first = got[(got.section == "pair") & (got.item == "vol_copy | vol_x")].set_index("metric").value
    assert first["place"] == 1 and first["place_in_kind"] == 1 and first["family_a"] == first["family_b"]
    assert first["abs_corr"] > 0.999


# --- model --------------------------------------------------------------------------

NAMES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in ("a", "b"):
        for s in range(160):
            for k in range(8):
                f = rng.normal(size=3)
                y = float(0.02 * (f[0] > 0.3) - 0.03 * (f[1] < -0.5) + 0.002 * rng.normal())
                rows.append((p, f"n{k}", day(s), s, 160, y if s < 155 else None, 2 * y if s < 150 else None,
                             None if rng.random() < 0.1 else float(f[0]), float(f[1]), float("nan") if k == 0 else float(f[2])))
    raw = spark.createDataFrame(rows, "panel_id string, instrument string, session date, sess_no int, n_sessions int, "
                                      "label_5 double, label_21 double, f0 double, f1 double, f2 double").repartition(5)
    return raw, bt.binned(raw, NAMES, (5, 21), F.col("sess_no") < 100)


def numpy_scores(frame, fit, trees, depth, rate, leaf, least):
    """The same boosting in one piece, for one panel and fit."""
    x = np.stack([np.frombuffer(b, np.uint8) for b in frame.x])
    y = frame[f"label_{fit.horizon}"].to_numpy(float)
    train = (frame.sess_no.to_numpy() < fit.train_end) & ~np.isnan(y)
    if train.sum() < least:
        return None
    total = np.zeros(len(x))

    def split(rows, level):
        """The values that a (sub)tree gives to all rows, chosen on the training rows among ``rows``."""
        out, own = np.zeros(len(x)), rows & train
        g = np.rint((y - total) / bt.UNIT)
        best = None
        for f in fit.features:
            for c in range(bt.BINS + 1):
                low, high = own & (x[:, f] <= c), own & (x[:, f] > c)
                if low.sum() >= leaf and high.sum() >= leaf:
                    gain = (g[low].sum() * bt.UNIT) ** 2 / low.sum() + (g[high].sum() * bt.UNIT) ** 2 / high.sum()
                    if best is None or gain > best[0]:
                        best = (gain, f, c)
        low = rows if best is None else rows & (x[:, best[1]] <= best[2])
        for part in (low, rows & ~low):
            if level + 1 < depth:
                out[part] = split(part, level + 1)[part]
            elif (part & train).any():
                out[part] = rate * bt.UNIT * g[part & train].sum() / (part & train).sum()
        return out

    for _ in range(trees):
        total = total + split(np.ones(len(x), bool), 0)
    live = (frame.sess_no >= fit.score_from) & (frame.sess_no < fit.score_to)
    return frame[live].assign(score=total[live])


def test_side_by_side_fits_are_single_fits(table):
    _, rows = table
    fits = bt.walk_forward_fits({"base": NAMES[:2], "wide": NAMES}, NAMES, (5, 21), 160, 100, 25)
    assert len(fits) == 12
    grown = bt.grow(rows, fits, 3, trees=3, depth=2, least=600, leaf=20)
    got = bt.scores(rows, fits, grown, 3).toPandas()
    frame = rows.toPandas()
    seen = 0
    for fit in fits:
        for p in ("a", "b"):
            want = numpy_scores(frame[frame.panel_id == p].reset_index(drop=True), fit, 3, 2, bt.RATE, 20, 600)
            own = got[(got.panel_id == p) & (got.variant == fit.variant) & (got.horizon == fit.horizon) & (got.fold == fit.fold)]
            assert len(own) == (0 if want is None else len(want))
            if want is not None:
                seen += 1
                both = own.merge(want, on=["session", "instrument"])
                assert len(both) == len(own) and np.allclose(both.score_x, both.score_y, atol=1e-12)
    assert seen > 12


def test_no_label_after_the_refit_counts(spark, table):
    raw, rows = table
    fits = bt.walk_forward_fits({"wide": NAMES}, NAMES, (5,), 160, 100, 60)
    later = rows.withColumn("label_5", F.when(F.col("sess_no") >= fits[0].train_end, 9.0).otherwise(F.col("label_5")))
    base, moved = (bt.scores(t, fits, bt.grow(t, fits, 3, trees=2, depth=2, leaf=20), 3).select(
        "panel_id", "instrument", "session", "score").toPandas().sort_values(["panel_id", "session", "instrument"])
        for t in (rows, later))
    assert len(base) and base.score.tolist() == moved.score.tolist()
    # edges come from the sessions before the first refit only
    bent = raw.withColumn("f1", F.when(F.col("sess_no") >= 100, F.col("f1") * 1000).otherwise(F.col("f1")))
    early = bt.binned(bent, NAMES, (5, 21), F.col("sess_no") < 100).where("sess_no < 100").select("panel_id", "session", "instrument", "x")
    assert early.exceptAll(rows.where("sess_no < 100").select("panel_id", "session", "instrument", "x")).count() == 0


def test_gated_trials_promote_by_the_gate_alone(spark):
    rng = np.random.default_rng(2)
    rows = []
    for v, mean in (("good", 0.02), ("bad", 0.0)):
        for h in (5, 21):
            for i in range(120):
                rows.append(("p", v, h, day(i), i, float(mean + 0.01 * rng.normal())))
    pnls = spark.createDataFrame(rows, "panel_id string, variant string, horizon bigint, session date, sess_no int, pnl double")
    got = {(r.variant, r.horizon): r for r in gate.gated_trials(pnls, 4).collect()}
    assert len(got) == 4 and all(r.n_trials == 4 and r.n == 120 for r in got.values())
    for (v, h), r in got.items():
        own = np.array([x[5] for x in rows if x[1] == v and x[2] == h])
        assert r.passes == (r.ratio > 1.645 and r.pbo < 0.5) and r.promoted == (v == "good")
        assert abs(r.mean_pnl - own.mean()) < 1e-12 and r.first_oos == DAY


def test_a_rewritten_fold_changes_nothing_else(spark, tmp_path):
    rows = [("p", day(i), f"n{k}", 0.1 * k, 0.5, 1, h, i // 10) for i in range(30) for k in range(3) for h in (5, 21)]
    scores = spark.createDataFrame(rows, "panel_id string, session date, instrument string, score double, rank_pct double, "
                                         "lean int, horizon bigint, fold bigint")
    path = str(tmp_path / "scores")
    before = st.export_scores(spark, path, scores).toPandas()
    again = st.export_scores(spark, path, scores.where("fold = 2 AND horizon = 21")).toPandas()
    columns = list(before.columns)
    assert before.sort_values(columns).values.tolist() == again.sort_values(columns).values.tolist()
    moved = st.export_scores(spark, path, scores.where("fold = 2 AND horizon = 21").withColumn("score", F.lit(9.0)))
    assert moved.where("score = 9").count() == 30 and moved.count() == len(rows)
    meta = {r.horizon: r for r in st.export_metadata(moved, 750).collect()}
    assert meta[21].rows == 90 and meta[21].fits == 3 and meta[21].assets == 3 and meta[5].date_end == day(29)


# --- reports ------------------------------------------------------------------------

def test_latest_state_ages_each_input_by_itself(spark):
    now = spark.createDataFrame([("p", day(100)), ("q", day(50))], "panel_id string, now date")
    rows = spark.createDataFrame([("p", day(99), 1.0), ("p", day(100), None), ("p", day(101), 5.0), ("q", day(10), 2.0)],
                                 "panel_id string, session date, vix double")
    block = rp.latest_block(rows, now, "VOLATILITY", "session", rp.cells({"vix": F.col("vix")}, {"name": F.lit("x")}),
                            F.col("vix").isNotNull())
    got = rp.latest_state({"v": block}, now).collect()
    vix = {r.panel_id: (r.value, r.as_of, r.age_days, r.stale) for r in got if r.metric == "vix"}
    assert vix == {"p": (1.0, day(99), 1, False), "q": (2.0, day(10), 40, True)}
    late = {(r.panel_id, r.metric): r.value for r in got if r.block == "STALE INPUTS"}
    assert late["p", "VOLATILITY"] == 0 and late["q", "VOLATILITY"] == 1 and late["p", "LIQUIDITY"] == 1
    assert [r.text for r in got if r.metric == "name"] == ["x", "x"]


def test_logs_find_their_stories_and_keep_the_stored_order(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"2024-01-0{i}", f"2024-02-0{9 - i} 00:00:00", ["A"] if i % 2 else [], ["SPY"], [],
             {"S1": "WEAK"} if i < 5 else {"S2": "HOLDING"}) for i in range(1, 9)]
    spark.createDataFrame(rows, "as_of string, generated_at string, fired array<string>, crowded_long array<string>, "
                                "crowded_short array<string>, stories map<string,string>").write.json(path)
    log = ld.read_log(spark, path)
    report = rp.log_report(log, 3)
    assert report.columns == ["as_of", "S1", "S2", "n_fired", "fired", "crowded_long", "crowded_short"]
    assert [tuple(r) for r in report.collect()][0] == ("2024-01-08", None, "HOLDING", 0, "(none)", "SPY", "(none)")
    assert [r.as_of for r in rp.fire_log(log, 3).collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_panel_product_comes_back_whole_with_coverage_of_any_type(spark, panels, tmp_path):
    stored = st.write_panel(panels, str(tmp_path / "panel"), 1)
    assert stored.columns == panels.columns and stored.exceptAll(panels).count() == 0 and stored.count() == panels.count()
    got = {r["column"]: r for r in rg.coverage(stored.where("panel_id = 'a'"), ["story_state_S", "liq_rare", "liq_flat"]).collect()}
    assert got["story_state_S"].n == 315 and got["liq_rare"].n == 5 and got["liq_rare"].last == day(4)
    assert got["liq_flat"].pct_null == 0


def test_symbol_scan_opens_only_the_first_files(spark, tmp_path):
    for name in ("spy", "abc", "tlt"):
        (tmp_path / f"{name}.csv").write_text(f"session,close\n2024-01-01,{len(name)}.5\n2024-01-02,2\n")
    (tmp_path / "notes.txt").write_text("x")
    schema = "session date, close double"
    whole = ld.read_symbol_files(spark, str(tmp_path), schema)
    assert sorted({r.instrument for r in whole.collect()}) == ["ABC", "SPY", "TLT"] and whole.count() == 6
    first = ld.read_symbol_files(spark, str(tmp_path), schema, limit=2)
    assert sorted({r.instrument for r in first.collect()}) == ["ABC", "SPY"]
    assert len(first.inputFiles()) == 2 and "notes.txt" in child_names(spark, str(tmp_path))


def test_trial_pnls_are_top_less_bottom(spark):
    rows = [("p", f"n{k:02}", day(s), s, 40, "v", h, float(k), float(k) / 100 if s + h < 40 else None)
            for s in range(40) for k in range(17) for h in (5, 21)]
    scored = spark.createDataFrame(rows, "panel_id string, instrument string, session date, sess_no int, n_sessions int, "
                                         "variant string, horizon bigint, score double, label double")
    got = model.trial_pnls(scored, (5, 21), 10).toPandas()
    assert sorted(got[got.horizon == 5].sess_no) == [10, 15, 20, 25, 30] and sorted(got[got.horizon == 21].sess_no) == [10]
    assert np.allclose(got.pnl, 0.09 - 2 * 0.0005)
    assert isinstance(got, pd.DataFrame)


def test_panels_do_not_meet(spark):
    """Rows of one report and asset, and results of one strategy, in two panels."""
    reports = spark.createDataFrame([("a", "099741", "2024-01-02", 5.0, 1.0, 10.0), ("b", "099741", "2024-01-02", 1.0, 5.0, 10.0)],
                                    "panel_id string, code string, report_date string, nc_long double, nc_short double, oi double")
    contracts = spark.createDataFrame([("099741", "EURUSD", 1)], "code string, asset string, sign int")
    got = {r.panel_id: r.net_pct for r in ld.normalise_positions(reports, contracts).collect()}
    assert got == {"a": 0.4, "b": -0.4}
    kind = "panel_id string, strategy string, n long, profit_factor double"
    deep = spark.createDataFrame([("a", "s", 50, 2.0), ("b", "s", 50, 2.0)], kind)
    recent = spark.createDataFrame([("a", "s", 50, 2.0), ("b", "s", 50, 0.5)], kind)
    assert {r.panel_id: r.verdict for r in stg.replication(deep, recent).collect()} == {
        "a": "replicates", "b": "regime-specific"}
