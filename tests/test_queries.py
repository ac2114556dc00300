"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from barweave.plans.registry import load_all

TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = [
    "dedup_keep_last", "src_fmp_json", "session_date", "f_macd", "f_obv", "f_ctx_corr", "f_chart_overlays", "t_return_5", "split_temporal",
    "cv_coverage", "rg_status", "rg_vol_tercile", "sg_build", "sg_cluster_zones", "scr_top", "st_upsert", "wl_add", "bt_trades",
    "bt_regime_metrics", "ex_path_first_touch", "ex_one_position", "ex_max_concurrent", "ex_sweep", "pt_performance",
    "cal_isotonic", "cal_threshold_table", "diag_confidence_matrix", "xp_summary", "al_fanout", "ac_status", "ss_bars",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    q = load_all()[name]
    df = q(spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    rel = con.sql(q.sql)
    assert sorted(rel.columns) == names
    want = sorted(rel.select(*[f'"{n}"' for n in names]).fetchall(), key=_key)
    assert got == want


def test_every_sql_twin_parses(con):
    missing = []
    for name, q in load_all().items():
        if q.sql is None:
            missing.append(name)
        else:
            con.execute(f"EXPLAIN {q.sql}")
    assert all(n.startswith(("ml_", "sc_", "xp_contributions")) for n in missing)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries())
