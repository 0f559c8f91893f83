"""Declared schemas of landed files and stored histories, as DDL text."""

from __future__ import annotations


def names(ddl: str) -> list[str]:
    """Top-level column names of a flat schema."""
    return [part.split()[0] for part in ddl.split(",")]


BARS = ("panel_id string, instrument string, session date, open double, high double, "
          "low double, close double, volume double, factor double")
POSITIONS = ("panel_id string, asset string, report_date date, net_pct double, oi double")
RATES = ("panel_id string, series_id string, date date, ts_ms bigint, rate double")
LEVELS = ("panel_id string, series_id string, obs_date date, value double")
SNAPSHOTS = ("panel_id string, ticker string, date date, shares double, price double, "
               "source string, noise_usd double")
CHART = ("chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<"
           "quote: array<struct<open: array<double>, high: array<double>, low: array<double>, "
           "close: array<double>, volume: array<double>>>, "
           "adjclose: array<struct<adjclose: array<double>>>>>>>")
RATE_RECORDS = ("result array<struct<timestamp: bigint, interest_1h: double>>")
OBSERVATIONS = ("observations array<struct<date: string, value: string>>")
BALANCES = ("data array<struct<record_date: string, account_type: string, "
              "open_today_bal: string, close_today_bal: string>>")
FUND_LIST = ("data struct<funds: struct<etfs: struct<datas: array<struct<"
               "fundTicker: string, nav: array<string>, aum: array<string>, "
               "asOfDate: array<string>>>>>>")
FUND_MAP = ("map<string, struct<localExchangeTicker: string, navAmount: struct<r: double>, "
            "totalNetAssets: struct<r: double>, navAmountAsOf: struct<r: bigint>>>")
STATE_LOG = ("as_of string, generated_at string, fired array<string>, "
               "crowded_long array<string>, crowded_short array<string>, "
               "framework map<string,double>, stories map<string,string>, "
               "story_corr map<string,double>, vix double, vrp double, vrp_pct double, "
               "absorption double, _torn string")
SCORE_DOC = (
    "as_of string, gate map<string, struct<passes: boolean, dsr_ratio: double, pbo: double, "
    "profit_factor: double, n_trades: bigint>>, assets map<string, struct<force: string, "
    "lean: int, conviction: double, horizons: map<string, struct<score: double, "
    "rank_pct: double, lean: int>>>>")
