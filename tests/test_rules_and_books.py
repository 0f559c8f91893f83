"""Conditions, verdicts, PnL books, gate arithmetic, streams, folds."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalars as sc
from tidepanel.operators import boosting as bt
from tidepanel.operators import gate, model
from tidepanel.operators import rules as ru
from tidepanel.operators import sections as xs
from tidepanel.operators import strategies as stg
from tidepanel.plans import registry
from tidepanel.streaming import histories as st

DAY = dt.date(2024, 1, 1)


def test_story_states(spark):
    rows = [(0.5, 0.4), (0.2, 0.4), (-0.2, 0.4), (-0.4, -0.3), (0.2, -0.3), (None, 0.4)]
    df = spark.createDataFrame(rows, "c double, t double")
    got = [r.s for r in df.select(sc.story_state("c", "t").alias("s")).collect()]
    assert got == ["HOLDING", "WEAK", "BROKEN", "HOLDING", "BROKEN", "NO_DATA"]


def test_missing_inputs_never_fire(spark):
    cols = ["vix_idx52", "vrp_pct", "n_cluster", "term_ratio", "term_stale_days", "netliq_chg13w_z",
            "skew_pct", "vix_pct", "max_abs_chg4w", "absorption"]
    ddl = ", ".join(f"{c} double" for c in cols)
    quiet = spark.createDataFrame([tuple([None] * 10)], ddl).select(
        *[v.alias(k) for k, v in ru.condition_columns().items()]).first()
    assert not any(quiet)
    loud = spark.createDataFrame([(0.1, 0.2, 3.0, 1.0, 1.0, -2.5, 0.9, 0.1, 0.05, 0.71)], ddl).select(
        *[v.alias(k) for k, v in ru.condition_columns().items()]).first().asDict()
    assert {k for k, v in loud.items() if not v} == {"VOL_RICH"}
    stale = spark.createDataFrame([(None, None, None, 1.2, 2.0) + (None,) * 5], ddl).select(
        ru.condition_columns()["TERM_BACKWARDATION"].alias("x")).first()
    assert not stale.x


def _books(x, f, hold, start, k):
    """Brute force over sessions: the loop the operator replaces."""
    n, prev, out = len(x), {}, []
    for i in range(start, n - hold, hold):
        ok = [j for j in range(x.shape[1]) if not np.isnan(x[i, j])]
        if len(ok) < 2 * k + 1:
            continue
        ranked = sorted(ok, key=lambda j: (-x[i, j], f"n{j:02d}"))
        longs, shorts = ranked[:k], ranked[-k:]
        top = [f[i, j] for j in longs if not np.isnan(f[i, j])]
        bot = [f[i, j] for j in shorts if not np.isnan(f[i, j])]
        if not top or not bot:
            continue
        w = {**{j: 0.5 / k for j in longs}, **{j: -0.5 / k for j in shorts}}
        turn = sum(abs(w.get(j, 0) - prev.get(j, 0)) for j in set(w) | set(prev))
        out.append(0.5 * np.mean(top) - 0.5 * np.mean(bot) - 0.0005 * turn)
        prev = w
    return out


def test_rank_books_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n, m = 90, 7
    x = rng.normal(size=(n, m))
    x[rng.random((n, m)) < 0.2] = np.nan
    f = rng.normal(size=(n, m)) / 100
    f[rng.random((n, m)) < 0.1] = np.nan
    rows = [("p", f"n{j:02d}", DAY + dt.timedelta(days=i), i, n,
             None if np.isnan(x[i, j]) else float(x[i, j]),
             None if np.isnan(f[i, j]) else float(f[i, j])) for i in range(n) for j in range(m)]
    df = spark.createDataFrame(rows, "panel_id string, instrument string, session date, sess_no int, "
                                     "n_sessions int, s double, f double")
    got = stg.rank_long_short(df, "s", "f", 5, 3, k=2).orderBy("sess_no").toPandas().pnl
    np.testing.assert_allclose(got, _books(x, f, 5, 3, 2), atol=1e-12)


def test_signal_turnover_skips_do_not_reset(spark):
    pos = [1.0, None, 1.0, -1.0]
    rows = [("p", DAY + dt.timedelta(days=i), i, 5, p, 0.01) for i, p in enumerate(pos)]
    df = spark.createDataFrame(rows, "panel_id string, session date, sess_no int, n_sessions int, "
                                     "pos double, f double")
    got = stg.signal_pnls(df, "pos", "f", 1, 0).orderBy("sess_no").toPandas().pnl
    np.testing.assert_allclose(got, [0.01 - 0.0005, 0.01, -0.01 - 0.001])


def test_gated_books_pay_once_to_leave(spark):
    n, m = 6, 5
    rows = [("p", f"n{j}", DAY + dt.timedelta(days=i), i, 253 + 21 * n, float(j), 0.01 * j)
            for i in range(253, 253 + 21 * n) for j in range(m)]
    df = spark.createDataFrame(rows, "panel_id string, instrument string, session date, sess_no int, "
                                     "n_sessions int, mom double, fwd21 double")
    opened = {253: True, 274: False, 295: False, 316: True}
    g = df.select("panel_id", "sess_no").distinct().withColumn("open", F.coalesce(
        F.create_map(*[F.lit(v) for kv in opened.items() for v in kv])[F.col("sess_no")],
        F.lit(False)))
    got = stg.gated_momentum(df, g, k=2).orderBy("sess_no").toPandas()
    gross = 0.5 * 0.035 - 0.5 * 0.005
    assert list(got.sess_no) == [253, 274, 316, 337]
    np.testing.assert_allclose(got.pnl, [gross - 0.0005, -0.0005, gross - 0.0005, -0.0005])


def test_gate_arithmetic(spark):
    assert sc.expected_max_z(117) == pytest.approx(2.5854, abs=1e-4)
    assert sc.expected_max_z(1) == 0.0
    rng = np.random.default_rng(0)
    p = rng.normal(0.01, 0.1, 482)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(p)],
                               "strategy string, sess_no int, pnl double")
    r = gate.deflated_sharpe(df, ["strategy"], 117).first()
    sr = p.mean() / p.std(ddof=1)
    z = (p - p.mean()) / p.std()
    sigma = np.sqrt((1 - (z ** 3).mean() * sr + ((z ** 4).mean() - 1) / 4 * sr ** 2) / 481)
    assert r.sr == pytest.approx(sr) and r.sigma_sr == pytest.approx(sigma)
    assert r.ratio == pytest.approx(sr / sigma - sc.expected_max_z(117))
    assert r.sr_star == pytest.approx(sigma * sc.expected_max_z(117))


def test_overfit_probability_bounds(spark):
    rng = np.random.default_rng(0)
    good = [("p", "good", i, 0.05 + float(rng.normal(0, 0.01))) for i in range(100)]
    noise = [("p", f"n{k}", i, float(rng.normal(0, 0.01))) for k in range(5) for i in range(100)]
    df = spark.createDataFrame(good + noise, "panel_id string, strategy string, sess_no int, pnl double")
    r = gate.overfit_probability(df).first()
    assert (r.n_splits, r.pbo) == (252, 0.0)


def test_verdict_reasons(spark):
    df = spark.createDataFrame([(2.0, 0.1), (1.0, 0.1), (2.0, 0.6), (None, None)],
                               "ratio double, pbo double")
    got = gate.gate_verdict(df).collect()
    assert [(r.passes, len(r.reasons)) for r in got][:3] == [(True, 0), (False, 1), (False, 1)]
    assert not got[3].passes


def test_top_bottom_needs_width(spark):
    df = spark.createDataFrame([("p", DAY, f"n{i}", float(i)) for i in range(4)],
                               "panel_id string, session date, instrument string, s double")
    assert xs.top_bottom(df, "s", 2).count() == 0
    assert xs.top_bottom(df, "s", 1).count() == 2


def test_folds_are_purged(spark):
    for h in (5, 21):
        for f in bt.walk_forward_fits({"all": ["x"]}, ["x"], [h], 2500, 750, 126):
            # the label of the last training session is realised by the first scored one
            assert f.train_end - 1 + h < f.score_from


def _hours(spark, days, path, files=6):
    """An event an hour, every tenth twice, in files that follow no order of time."""
    rows = [("a", i * 3600000, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.0)
            for i in range(24 * days)]
    df = spark.createDataFrame(rows + rows[::10],
                               "series_id string, ts_ms bigint, ts timestamp, rate double")
    df.repartition(files).write.parquet(path)
    return df.schema


def test_streams_lose_no_late_or_repeated_row(spark, tmp_path):
    day = F.expr("ts_ms div 86400000")
    schema = _hours(spark, 120, str(tmp_path / "in"))
    events = st.KeyedTable(spark, str(tmp_path / "e"), schema, ["series_id", "ts_ms"], day)
    out = st.daily_totals(spark.createDataFrame([], schema), ["series_id"]).schema
    totals = st.KeyedTable(spark, str(tmp_path / "t"), out, ["series_id", "date"], F.col("date"))
    for _ in range(2):  # the second drain finds nothing new and changes nothing
        stream = st.landed_stream(spark, str(tmp_path / "in"), schema, 1)
        assert st.run_daily_totals(stream, events, totals, ["series_id"], str(tmp_path / "cp")) == 6
        assert events.read().count() == 24 * 120
        assert [(r.n, r.total) for r in totals.read().select("n", "total").distinct().collect()] == [(24, 24.0)]
        assert totals.read().count() == 120


@pytest.fixture(scope="module")
def repeated_events(spark, tmp_path_factory):
    """Events that share a type and millisecond, with equal and other values; odd values, no time."""
    import duckdb
    folder = tmp_path_factory.mktemp("events")
    rows = [(i, f"2024-01-0{1 + i % 3} 05:00:0{i % 4}.00{i % 5}{j}", "ab"[i % 2], v)
            for i in range(12) for j, v in enumerate([3.5 + i, 1.25, 1.25, -2.0])]
    rows += [(90, "2024-01-05 01:00:00", "a", None), (91, "2024-01-05 01:00:00", "a", float("nan")),
             (92, "2024-01-05 01:00:00", "a", 7.0), (93, "2024-01-06 23:59:59.999999", "b", None),
             (94, None, "a", 2.0), (95, None, "a", 4.0), (95, None, "a", 4.0), (96, "2024-01-07 01:00:00", None, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double")
    df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value").write.parquet(
        str(folder / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), lambda name: con.execute(registry.references()[name]).fetchall()


@pytest.mark.parametrize("name", ["h01_stream_dedupe", "h02_stream_daily_totals"])
def test_streams_of_events_that_share_a_millisecond(spark, repeated_events, name):
    folder, wanted = repeated_events
    got, want = registry.plans()[name](spark, folder).collect(), wanted(name)
    assert len(want) > 6
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_older_run_in_a_later_batch_does_not_win(spark, tmp_path):
    schema = "as_of int, run int, v string"
    frame = spark.createDataFrame([], schema)
    table = st.KeyedTable(spark, str(tmp_path / "t"), frame.schema, ["as_of"], F.col("as_of") % 2, ["run"])
    assert table.read().count() == 0 and table.newest() == 0
    table.upsert(spark.createDataFrame([(1, 5, "new"), (2, 1, "x")], schema), 1)
    table.upsert(spark.createDataFrame([(1, 3, "old"), (3, 1, "y")], schema), 2)
    table.upsert(spark.createDataFrame([(1, 3, "old"), (3, 1, "y")], schema), 2)
    assert sorted(map(tuple, table.read().collect())) == [(1, 5, "new"), (2, 1, "x"), (3, 1, "y")]
    import shutil
    shutil.rmtree(tmp_path / "t" / "v=1")
    with pytest.raises(FileNotFoundError):
        table.read()


def test_rows_with_a_null_partition_are_kept(spark, tmp_path):
    schema = "k int, day date, v string"
    table = st.KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["k"], F.col("day"))
    table.upsert(spark.createDataFrame([(1, None, "a"), (2, DAY, "b"), (3, None, "c")], schema), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, None, "a"), (2, DAY, "b"), (3, None, "c")]
    table.upsert(spark.createDataFrame([(1, None, "new")], schema), 2)
    assert sorted(map(tuple, table.read().collect())) == [(1, None, "new"), (2, DAY, "b"), (3, None, "c")]


def test_versions_are_compacted_and_removed(spark, tmp_path):
    schema = "k int, v int"
    table = st.KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["k"], F.col("k") % 7,
                          compact_after=3)
    want = {}
    for version in range(1, 9):
        rows = [(k, version) for k in range(version, version + 3)]
        want.update(rows)
        table.upsert(spark.createDataFrame(rows, schema), version)
        assert dict(map(tuple, table.read().collect())) == want
        assert len(table.manifest(version)[1]) <= 3
    before = dict(map(tuple, table.read(7).collect()))
    table.vacuum(2)
    assert dict(map(tuple, table.read().collect())) == want and dict(map(tuple, table.read(7).collect())) == before
    assert len(list((tmp_path / "t").glob("v=*"))) <= 4 and len(list((tmp_path / "t").glob("m=*"))) == 2
    with pytest.raises(FileNotFoundError):
        table.read(3)


def test_registry_loads_without_a_session():
    """The driver may ask for the reference SQL before it has a session."""
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]


def test_every_query_is_registered_once():
    plans, sql = registry.plans(), registry.references()
    assert set(sql) <= set(plans) and len(plans) > 150
