"""Common table expressions for the SQL twins.

The derived tables are rebuilt here in plain SQL from the raw tables, without
using anything the Spark side produced.
"""

from __future__ import annotations

import math

W = "PARTITION BY ticker ORDER BY date"


def cols(plain: str = "", doubles: str = "") -> str:
    """Final select list: plain columns, and doubles cut to six decimals."""
    parts = plain.split()
    parts += [f"floor({d} * 1e6 + 0.5) / 1e6 AS {d}" for d in doubles.split()]
    return ", ".join(parts)


def full(n: int, agg: str, present: str, w: str = W) -> str:
    """Aggregate over the last n rows, null until n values are present."""
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({present}) OVER {frame} = {n} THEN {agg} OVER {frame} END"


def decayed(x: str, alpha: float, i: str, seed: str | None = None, w: str = W) -> str:
    """Exponential mean by its closed form; ``i`` counts rows from the seed row."""
    lq = repr(math.log(1 - alpha))
    seed = seed or x
    term = f"CASE WHEN {i} = 0 THEN {seed} WHEN {i} > 0 THEN {alpha!r} * ({x}) * exp(-({i}) * ({lq})::DOUBLE) END"
    return f"CASE WHEN {i} >= 0 THEN exp(({i}) * ({lq})::DOUBLE) * sum({term}) OVER ({w}) END"


CTES = {
    "day": (
        [],
        """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc_sum,
        CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax_sum,
        max(CAST(round(l_tax * 100) AS BIGINT)) AS tax_hi, min(CAST(round(l_tax * 100) AS BIGINT)) AS tax_lo,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    ),
    "cents": (
        ["day"],
        f"""SELECT *, 100000 + CAST(sum(CAST(floor(320::DOUBLE * disc_sum / n) AS BIGINT) - 1600) OVER ({W}) AS BIGINT) AS close_c
        FROM day""",
    ),
    "cents2": (
        ["cents"],
        f"""SELECT *, coalesce(lag(close_c) OVER ({W}), 100000) + CAST(floor(160::DOUBLE * tax_sum / n) AS BIGINT) - 640
        + CASE WHEN qty % 97 = 0 THEN 6000 WHEN qty % 89 = 0 THEN 3000 ELSE 0 END AS open_c FROM cents""",
    ),
    "bars": (
        ["cents2"],
        f"""SELECT ticker, date, open_c / 100::DOUBLE AS open,
        (greatest(open_c, close_c) + 150 * tax_hi) / 100::DOUBLE AS high,
        (least(open_c, close_c) - 150 * (8 - tax_lo)) / 100::DOUBLE AS low,
        close_c / 100::DOUBLE AS close, CAST(qty * 1000 AS DOUBLE) AS volume,
        (300 + CAST(floor(8::DOUBLE * qty / n) AS BIGINT)) / 1000::DOUBLE AS prob_up,
        row_number() OVER ({W}) AS seq FROM cents2""",
    ),
    "market": (
        [],
        """SELECT date, (100000 + CAST(sum(CAST(floor(320::DOUBLE * d / n) AS BIGINT) - 1600) OVER (ORDER BY date) AS BIGINT))
        / 100::DOUBLE AS close FROM (SELECT CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY 1)""",
    ),
    "vix": (
        [],
        """SELECT CAST(o_orderdate AS DATE) AS date,
        (1000 + CAST(floor(3000::DOUBLE * count(*) FILTER (WHERE o_orderpriority[1] IN ('1', '2')) / count(*)) AS BIGINT))
        / 100::DOUBLE AS close FROM orders GROUP BY 1""",
    ),
    "rets": (
        ["bars"],
        f"""SELECT *, close / lag(close) OVER ({W}) - 1 AS ret_1d, lag(close) OVER ({W}) AS prev_close FROM bars""",
    ),
    "tr": (
        ["rets"],
        """SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr_skip,
        CASE WHEN prev_close IS NOT NULL THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS tr_null
        FROM rets""",
    ),
    "seed14": (["tr"], f"""SELECT *, {full(14, "avg(tr_skip)", "tr_skip")} AS tr14 FROM tr"""),
    "atrs": (
        ["seed14"],
        f"""SELECT *, {decayed("tr_skip", 1 / 14, "(seq - 14)", "tr14")} AS atr,
        {full(14, "avg(tr_null)", "tr_null")} AS atr_sma FROM seed14""",
    ),
    # last gauge value at or before each bar, with its score over 60 rows
    "vix_z": (
        ["vix"],
        """SELECT date, close AS vix_level,
        CASE WHEN count(*) OVER v >= 30 AND stddev_samp(close) OVER v > 0
             THEN (close - avg(close) OVER v) / stddev_samp(close) OVER v END AS vix_z
        FROM vix WINDOW v AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    ),
    "reg0": (
        ["atrs", "vix_z"],
        """SELECT a.*, v.vix_level, v.vix_z,
        CASE WHEN atr_sma > 0 THEN (high - low) / atr_sma END AS range_atr,
        CASE WHEN atr_sma > 0 THEN abs(open - prev_close) / atr_sma END AS gap_atr
        FROM atrs a ASOF LEFT JOIN vix_z v ON a.date >= v.date""",
    ),
    "reg": (
        ["reg0"],
        """SELECT *, CASE WHEN seq < 20 THEN 'caution' WHEN gap_atr >= 2.5 THEN 'suspended'
        WHEN vix_level >= 35 OR vix_z >= 3 THEN 'suspended'
        WHEN range_atr >= 3 OR gap_atr >= 1.5 OR vix_level >= 25 OR vix_z >= 1.8 THEN 'caution'
        ELSE 'normal' END AS status FROM reg0""",
    ),
    "reg2": (
        ["reg"],
        """SELECT *, CASE status WHEN 'normal' THEN 1::DOUBLE WHEN 'caution' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS position_scale,
        status <> 'suspended' AS trading_allowed FROM reg""",
    ),
    "graded": (
        ["reg2"],
        f"""SELECT *, CASE WHEN prob_up >= 0.55::DOUBLE THEN 'STRONG_BUY' WHEN prob_up >= 0.5::DOUBLE THEN 'BUY'
        WHEN prob_up <= 1::DOUBLE - 0.55::DOUBLE THEN 'STRONG_SELL' ELSE 'SELL' END AS signal,
        CASE WHEN prob_up >= 0.5::DOUBLE THEN 'long' ELSE 'short' END AS side,
        CASE WHEN prob_up >= 0.5::DOUBLE THEN 1 ELSE -1 END AS sgn,
        greatest(prob_up, 1 - prob_up) * 100 AS confidence_pct, abs(prob_up - 0.5) * 200 AS conviction_pct,
        CASE WHEN coalesce(atr, atr_sma) > 0 THEN coalesce(atr, atr_sma) END AS atr_used,
        {full(20, "avg(volume)", "volume")} AS volume_sma FROM reg2""",
    ),
    # stop 1.5 ATR away; the risk exceeds one ATR, so targets sit at 1 and 2 risks
    "signals": (
        ["graded"],
        """SELECT ticker, date, seq, prob_up, signal, side, confidence_pct, conviction_pct, close AS price, atr_used AS atr,
        atr_used / close * 100 AS atr_pct, CASE WHEN atr_used IS NOT NULL THEN close END AS entry,
        close - sgn * 1.5 * atr_used AS stop_loss, close + sgn * 1.5 * atr_used AS tp1, close + sgn * 3.0 * atr_used AS tp2,
        CASE WHEN atr_used IS NOT NULL THEN 2::DOUBLE END AS risk_reward,
        least(100::DOUBLE, 0.01 / (1.5 * atr_used / close) * 100) * position_scale AS position_size_pct,
        status AS regime, trading_allowed, volume / volume_sma AS volume_ratio FROM graded""",
    ),
    "oof": (
        ["bars"],
        f"""SELECT ticker, date, prob_up, seq, target FROM (SELECT *, CAST(lead(close) OVER ({W}) > close AS INTEGER) AS target
        FROM bars) WHERE target IS NOT NULL""",
    ),
    "universe": (
        [],
        """SELECT ticker, ticker AS name, CAST(num % 5 AS VARCHAR) AS sector, CASE WHEN num % 2 = 0 THEN 'NY' ELSE 'SF' END AS exchange
        FROM (SELECT DISTINCT p_brand AS ticker, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS num FROM part)""",
    ),
    "users": (
        [],
        """SELECT c_custkey AS user_id, lower(c_name) || '@x.test' AS email,
        CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS chat_id,
        CASE c_custkey % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'free' ELSE '' END AS tier FROM customer""",
    ),
}


def ctes(*names: str, **extra: str) -> str:
    """``WITH`` clause holding ``names`` and all they need, then ``extra``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = CTES[name]
        for need in needs:
            add(need)
        done[name] = text

    for name in names:
        add(name)
    done.update(extra)
    return "WITH " + ",\n".join(f"{n} AS (\n{t}\n)" for n, t in done.items()) + "\n"
