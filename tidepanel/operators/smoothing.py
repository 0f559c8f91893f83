"""Exponentially weighted means as a two-level scan.

y_t = a_t * y_(t-1) + b_t * x_t is a chain of affine maps. Inside a chunk of sessions
the chain has a closed form over windows; each chunk reduces to one map (A, B), and a
row folds the maps of the chunks before its own. Everything is a window over one
partitioning and one sort: no join, no row-at-a-time Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunk_size(alpha: float) -> int:
    """Sessions per chunk such that the decay inside one stays far from underflow."""
    if alpha >= 1:
        return 1
    return max(1, min(256, int(150 / -log10(1 - alpha))))


def ewm_means(df: DataFrame, specs: dict[str, tuple[Column | str, float]],
              by: Sequence[str] = ("panel_id", "instrument"), number: str = "sess_no",
              ignore_gaps: bool = False, fill: bool = True) -> DataFrame:
    """Recursive means seeded with the first value.

    ``specs`` maps an output name to (input, alpha). A missing input leaves the mean
    unchanged but ages it: its weight decays once per session (set ``ignore_gaps`` to
    number only present values). ``fill`` carries the mean over missing inputs.
    """
    by = list(by)
    chunk = min(_chunk_size(alpha) for _, alpha in specs.values())
    items = list(enumerate(specs.items()))
    inputs = {f"__x{i}": (F.col(x) if isinstance(x, str) else x).cast("double")
              for i, (_, (x, _a)) in items}
    rows = df.withColumns({**inputs, "__chunk": F.floor(F.col(number) / chunk)})
    # (chunk, number) orders like number, and lets both levels share one sort; every
    # step below serves all outputs in one pass
    series = Window.partitionBy(*by).orderBy("__chunk", number)
    sofar = series.rowsBetween(Window.unboundedPreceding, 0)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    cell = Window.partitionBy(*by, "__chunk").orderBy(number)
    inside = cell.rowsBetween(Window.unboundedPreceding, 0)
    after = cell.rowsBetween(1, Window.unboundedFollowing)

    def x(i: int) -> Column:
        return F.col(f"__x{i}")

    def has(i: int) -> Column:
        return x(i).isNotNull()

    def gap(i: int) -> Column:
        if ignore_gaps:
            return F.when(has(i) & (F.count(x(i)).over(before) > 0), F.lit(1))
        seen = F.last(F.when(has(i), F.col(number)), ignorenulls=True).over(before)
        return F.when(has(i), F.col(number) - seen)

    rows = rows.withColumns({
        **{f"__gap{i}": gap(i) for i, _ in items},
        **{f"__head{i}": has(i) & (F.count(x(i)).over(inside) == 1) for i, _ in items},
        **{f"__end{i}": has(i) & (F.count(x(i)).over(after) == 0) for i, _ in items}})
    # the map of a present row; the seed row discards what it is handed
    maps = {}
    for i, (_, (_x, alpha)) in items:
        old = F.pow(F.lit(1.0 - alpha), F.col(f"__gap{i}"))
        seed = has(i) & F.col(f"__gap{i}").isNull()
        maps[f"__a{i}"] = F.when(seed, 0.0).when(has(i), old / (old + alpha))
        maps[f"__b{i}"] = F.when(seed, 1.0).when(has(i), alpha / (old + alpha))
    rows = rows.withColumns(maps)
    # products run from the chunk's first present row, whose own factor is kept apart:
    # it may be 0 (seed) or tiny (a long gap)
    rows = rows.withColumns({
        **{f"__log{i}": F.sum(F.when(has(i), F.when(F.col(f"__head{i}"), 0.0).otherwise(
            F.ln(f"__a{i}")))).over(inside) for i, _ in items},
        **{f"__first{i}": F.max(F.when(F.col(f"__head{i}"), F.col(f"__a{i}"))).over(inside)
           for i, _ in items}})
    rows = rows.withColumns({
        **{f"__A{i}": F.exp(f"__log{i}") * F.col(f"__first{i}") for i, _ in items},
        **{f"__B{i}": F.exp(f"__log{i}") * F.sum(F.when(has(i), F.col(f"__b{i}") * x(i) * F.exp(
            -F.col(f"__log{i}")))).over(inside) for i, _ in items}})
    rows = rows.withColumns({f"__maps{i}": F.collect_list(F.when(F.col(f"__end{i}"), F.struct(
        F.col(f"__A{i}").alias("A"), F.col(f"__B{i}").alias("B")))).over(before)
        for i, _ in items})

    def mean(i: int) -> Column:
        carry = F.aggregate(f"__maps{i}", F.lit(0.0), lambda y, m: m["A"] * y + m["B"])
        return F.when(has(i), F.col(f"__B{i}") + F.col(f"__A{i}") * carry)

    names = [name for _, (name, _s) in items]
    rows = rows.withColumns({name: mean(i) for i, (name, _s) in items})
    if fill:
        rows = rows.withColumns({n: F.last(n, ignorenulls=True).over(sofar) for n in names})
    return rows.select(*df.columns, *names)


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def ema(df: DataFrame, x: str, spans: dict[str, int], **kw) -> DataFrame:
    return ewm_means(df, {name: (x, span_alpha(n)) for name, n in spans.items()}, **kw)


def macd(df: DataFrame, x: str, fast: int = 12, slow: int = 26, signal: int = 9,
         **kw) -> DataFrame:
    out = ema(df, x, {"__fast": fast, "__slow": slow}, **kw)
    out = out.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    out = ema(out, "macd", {"macd_signal": signal}, **kw)
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(df: DataFrame, x: str, n: int = 14, by=("panel_id", "instrument"),
        number: str = "sess_no", **kw) -> DataFrame:
    """Wilder RSI with the edge rules 100 (no losses), 0 (no gains), 50 (neither)."""
    w = Window.partitionBy(*by).orderBy(number)
    out = df.withColumn("__d", F.col(x) - F.lag(x).over(w))
    out = (out.withColumn("__up", F.greatest("__d", F.lit(0.0)))
              .withColumn("__dn", F.greatest(-F.col("__d"), F.lit(0.0))))
    d_null = F.col("__d").isNull()
    out = (out.withColumn("__up", F.when(~d_null, F.col("__up")))
              .withColumn("__dn", F.when(~d_null, F.col("__dn"))))
    out = ewm_means(out, {"__u": ("__up", 1.0 / n), "__l": ("__dn", 1.0 / n)},
                    by=by, number=number, **kw)
    u, low = F.col("__u"), F.col("__l")
    value = (F.when((u == 0) & (low == 0), 50.0).when(u == 0, 0.0).when(low == 0, 100.0)
              .otherwise(100 - 100 / (1 + u / low)))
    return out.withColumn("rsi", F.when(u.isNotNull(), value)).drop(
        "__d", "__up", "__dn", "__u", "__l")
