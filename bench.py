"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# derived tables first, so later queries measure their own work
TABLES = ["bars", "market", "vix", "features", "signals", "oof"]
HEADLINE = [
    "bars_from_ticks", "f_returns", "f_volatility", "f_ema", "f_macd", "f_adx", "f_rsi", "f_obv", "f_ctx_corr", "f_all",
    "cv_panel", "rg_status", "rg_vol_tercile", "sg_pivots", "sg_build", "scr_scan", "st_upsert", "st_latest", "bt_metrics",
    "bt_trade_metrics", "bt_regime_metrics", "ex_block_match", "ex_path_first_touch", "ex_one_position", "ex_max_concurrent",
    "ex_sweep", "ex_per_year", "pt_resolve", "pt_performance", "cal_isotonic", "cal_threshold_table", "xp_top_factors",
    "al_fanout", "ac_events_fold",
]

# streams, timed beside the headline and not part of its total
BESIDE = ["ss_resolve", "ss_alert_dedup", "ss_scan_upsert"]


def main() -> None:
    from pyspark.sql import SparkSession

    from barweave.plans.registry import load_all
    from barweave.sources.fixtures import Inputs

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    inputs = Inputs(spark, sf_dir)
    spark.range(1).count()  # session start is not part of any query
    for table in TABLES:
        timed(f"table_{table}", lambda table=table: getattr(inputs, table).count())
    for name in HEADLINE:
        timed(name, lambda name=name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    for name in BESIDE:
        timed(f"beside_{name}", lambda name=name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    beside = {name: times.pop(f"beside_{name}") for name in BESIDE}
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "beside": beside, "sf": scale}))


if __name__ == "__main__":
    main()
