"""A sample of registered queries against DuckDB; check.py runs all of them."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["strategy_open_maker_base", "json_timeline_flatten", "filter_asof_cutoff", "math_rules", "arr_shortest_interval", "asof_nearest",
          "join_bracket_range", "agg_minute_gaps", "agg_station_city_gap", "agg_auc", "win_smart_ffill", "win_meteo_advanced", "win_position_limits",
          "edge_signal", "param_sweep", "view_decision_points", "stream_minute_candles", "stream_fill_matching", "parity_check"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, db, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = db.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = norm([[r[names.index(c)] for c in cols] for r in cur.fetchall()])
    assert norm([[r[c] for c in cols] for r in df.collect()]) == want


def test_every_oracle_has_a_query_and_parses(db):
    assert set(oracle_sql()) <= set(queries()) and len(queries()) >= 240
    for sql in oracle_sql().values():
        db.execute("EXPLAIN " + sql)


def test_entry(spark):
    assert entry(spark).count() == 5


def test_every_snapshot_has_training_rows(spark):
    keys = ["city", "day", "us"]
    rows, edges = (queries()[n](spark, SF) for n in ("edge_training_rows", "edge_signal"))
    assert rows.count() == edges.count() and edges.join(rows.where("ev_100 is not null or ev_10 is null"), keys, "left_anti").count() == 0


def test_all_components_reach_the_class_shares(tables):
    row = tables.embeddings.join(tables.probs, "vec_id").first()
    want = [sum(abs(x) for x in row.embedding[k::7]) for k in range(7)]
    assert row.p == pytest.approx([w / sum(want) for w in want])
