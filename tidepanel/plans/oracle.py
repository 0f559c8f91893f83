"""Reference SQL: named subqueries composed into one ANSI statement per query."""

from __future__ import annotations

from tidepanel.plans.views import (BRAND_INSTRUMENTS, FLAG_SERIES, PRIORITY_ASSETS,
                                   TYPE_FUNDS)


def _values(mapping: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())


_BRANDS = {f"Brand#{i + 1}": n for i, n in enumerate(BRAND_INSTRUMENTS)}

# name -> (names it reads, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "names": ((), f"SELECT * FROM (VALUES {_values(_BRANDS)}) t(brand, instrument)"),
    "trades": ((), "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "bars": (("names", "trades"), """
        SELECT instrument, CAST(l_shipdate AS DATE) AS session,
          floor(coalesce(avg(CASE WHEN l_linenumber % 2 = 1
                                  THEN l_extendedprice / l_quantity END),
                         avg(l_extendedprice / l_quantity)) * 10000 + 0.5) / 10000.0 AS open,
          floor(max(l_extendedprice / l_quantity) * 10000 + 0.5) / 10000.0 AS high,
          floor(min(l_extendedprice / l_quantity) * 10000 + 0.5) / 10000.0 AS low,
          floor(avg(l_extendedprice / l_quantity) * 10000 + 0.5) / 10000.0 AS close,
          sum(l_quantity) AS volume, round(1 - avg(l_discount), 6) AS factor
        FROM trades JOIN names ON p_brand = brand GROUP BY 1, 2"""),
    "cal": ((), """
        SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INT) AS sess_no
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem)"""),
    "grid": (("bars", "cal"), """
        SELECT i.instrument, c.session, c.sess_no, b.open, b.high, b.low, b.close,
               b.volume, b.factor
        FROM cal c CROSS JOIN (SELECT DISTINCT instrument FROM bars) i
        LEFT JOIN bars b ON b.instrument = i.instrument AND b.session = c.session"""),
    "padded": (("grid",), """
        SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument
                    ORDER BY session ROWS UNBOUNDED PRECEDING) AS ff FROM grid"""),
    "panel": (("padded",), """
        SELECT *, ff / lag(ff, 1) OVER (PARTITION BY instrument ORDER BY session) - 1 AS ret
        FROM padded"""),
    "carried": (("panel",), """
        SELECT instrument, session, sess_no, ret, ff, last_value(open IGNORE NULLS) OVER f AS open,
          last_value(high IGNORE NULLS) OVER f AS high,
          last_value(low IGNORE NULLS) OVER f AS low,
          last_value(close IGNORE NULLS) OVER f AS close,
          last_value(volume IGNORE NULLS) OVER f AS volume,
          last_value(factor IGNORE NULLS) OVER f AS factor
        FROM panel WINDOW f AS (PARTITION BY instrument ORDER BY session
                                ROWS UNBOUNDED PRECEDING)"""),
    "positions": ((), f"""
        SELECT *, round((nc_long - nc_short) / oi, 8) AS net_pct FROM (
          SELECT asset, CAST(date_trunc('week', o_orderdate) AS DATE) + 1 AS report_date,
            round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS nc_long,
            round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS nc_short,
            round(sum(o_totalprice), 2) AS oi
          FROM orders JOIN (VALUES {_values(PRIORITY_ASSETS)}) t(pr, asset)
            ON o_orderpriority = pr GROUP BY 1, 2)"""),
    "feats": (("positions",), """
        SELECT asset, report_date, report_date + 6 AS effective_date, net_pct,
          CASE WHEN count(net_pct) OVER w156 >= 52 THEN
            (net_pct - avg(net_pct) OVER w156) / nullif(stddev_samp(net_pct) OVER w156, 0) END
            AS z156,
          CASE WHEN len(l52) >= 26 THEN
            (len(list_filter(l52, lambda v: v < net_pct))
             + (len(list_filter(l52, lambda v: v = net_pct)) + 1) / 2.0) / len(l52) END AS idx52,
          net_pct - lag(net_pct, 4) OVER w AS chg4w
        FROM (SELECT *, list(net_pct) OVER (PARTITION BY asset ORDER BY report_date
                                            ROWS 51 PRECEDING) AS l52 FROM positions)
        WINDOW w AS (PARTITION BY asset ORDER BY report_date),
               w156 AS (PARTITION BY asset ORDER BY report_date ROWS 155 PRECEDING)"""),
    "posday": (("feats", "cal"), """
        SELECT c.session, c.sess_no, a.asset, f.effective_date, f.z156, f.idx52, f.chg4w
        FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM feats) a
        ASOF LEFT JOIN feats f ON f.asset = a.asset AND c.session >= f.effective_date"""),
    "hourly": ((), """
        SELECT event_type AS series_id, epoch_us(ts) // 1000 AS ts_ms, ts, CAST(ts AS DATE) AS date,
               value AS rate FROM events"""),
    "rates": ((), """
        SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date,
               round(sum(l_tax - 0.04), 6) AS rate FROM lineitem GROUP BY 1, 2"""),
    "levels": ((), f"""
        SELECT series_id, CAST(l_shipdate AS DATE) AS obs_date,
               round(sum(l_extendedprice), 2) AS value
        FROM lineitem JOIN (VALUES {_values(FLAG_SERIES)}) t(flag, series_id)
          ON l_returnflag = flag
        WHERE series_id = 'RRPONTSYD' OR isodow(CAST(l_shipdate AS DATE)) = 3
        GROUP BY 1, 2"""),
    "balances": ((), """
        SELECT CAST(l_shipdate AS DATE) AS record_date,
          CASE WHEN l_linenumber <= 2 THEN 3 WHEN l_linenumber <= 4 THEN 2
               WHEN l_linenumber <= 6 THEN 1 END AS rank,
          round(sum(l_extendedprice), 2) AS value
        FROM lineitem GROUP BY 1, 2"""),
    "tga": (("balances",), """
        SELECT record_date, arg_min(value, rank) AS value, min(rank) AS rank
        FROM balances WHERE rank IS NOT NULL GROUP BY 1"""),
    "snapshots": (("trades",), f"""
        SELECT ticker, date, shares, price,
          CASE WHEN n <= 12 OR n % 7 = 0 THEN NULL WHEN n % 2 = 0 THEN 'ssga'
               ELSE 'ishares' END AS source, shares * 0.005 AS noise_usd
        FROM (SELECT ticker, date, price, sum(issued) OVER w AS shares,
                     row_number() OVER w AS n
              FROM (SELECT ticker, last_day(CAST(l_shipdate AS DATE)) AS date,
                           sum(l_quantity) AS issued, round(avg(p_retailprice), 2) AS price
                    FROM trades JOIN (VALUES {_values(TYPE_FUNDS)}) t(ty, ticker)
                      ON p_type = ty GROUP BY 1, 2)
              WINDOW w AS (PARTITION BY ticker ORDER BY date))"""),
}


def _collect(name: str, seen: list[str]) -> None:
    for dep in PARTS[name][0]:
        _collect(dep, seen)
    if name not in seen:
        seen.append(name)


def sql(reads: str, body: str, recursive: bool = False, **extra: str) -> str:
    """``reads`` names shared subqueries; ``extra`` adds private ones, in order."""
    seen: list[str] = []
    for name in reads.split():
        _collect(name, seen)
    parts = [f"{n} AS ({PARTS[n][1]})" for n in seen] + [f"{n} AS ({b})" for n, b in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
