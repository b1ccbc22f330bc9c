"""A few registered queries against their SQL in DuckDB, and the registry itself."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["A6_robust_stats", "A11_groups_at", "A18_config_spread", "B6_pyramid", "B9_read_blocks", "J9_asof_join", "J11_overlay", "S5_ingest", "U1_merge_workspaces", "W1_twema", "T8_live_seqs", "T1_follow", "T6_feed_updates", "T8_losses", "T10_claims", "S12_journal_stream", "A26_line_density", "U1_merge_folders"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["O1_sort_all_runs", "O2_sort_ui_all", "S12_replay_ops", "S15_sniff_pages", "S15_sniff", "P7_flatten", "J13_diff_fields", "P10_natural_order", "A16_group_sort_value", "A12_keys_report"])
def test_query_whole(spark, name):
    test_query(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sorts_place_every_run(spark):
    runs = spark.read.parquet(f"{DATA}/customer.parquet").count()
    for name in ("O1_sort_all_runs", "O2_sort_ui_all"):
        assert sorted(r["place"] for r in entry.queries()[name](spark, DATA).collect()) == list(range(1, runs + 1))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_replay_gets_the_whole_log(spark, monkeypatch):
    from tideline.sources import tables

    seen = []
    monkeypatch.setattr(tables, "replay_ops", lambda ops: seen.append(ops.count()) or ops)
    entry.queries()["S12_replay_ops"](spark, DATA)
    assert seen == [spark.read.parquet(f"{DATA}/events.parquet").count()]


def test_rounds_as_the_sql_does(spark):
    import duckdb

    from tideline import queries

    ties = [(37 * i + 10**7 + 0.5) / 1e6 for i in range(2000)]
    values = [math.nextafter(t, to) for t in ties for to in (0.0, t, math.inf)] + [-130.6593385, 1e305, 0.0]
    df = spark.createDataFrame([(x,) for x in values], "mean double").withColumn("median", queries.rounded("mean", 6))
    got = queries.shown(df, "median", mean="mean").collect()
    want = [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    assert sorted(r["mean"] for r in got) == sorted(r["median"] for r in got) == sorted(want)


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
