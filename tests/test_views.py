"""The benchmark views on small tables with the keys that larger ones have."""

import datetime

import pytest

from trajlake.checks import files
from trajlake.operators.blocks import KEYS
from trajlake.plans.q_checks import order_recording

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def order_tables(spark, tmp_path):
    """Tables of orders ``(key, customer, status, priority, lines)``; returns their folder."""

    def write(orders, balances):
        spark.createDataFrame(
            [(k, c, st, 10.0, DAY, pr) for k, c, st, pr, _ in orders],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        ).write.parquet(f"{tmp_path}/orders.parquet")
        lines = [(k, 1, 1, i, 1.0, 5.0, 0.1, 0.0, "A", "O", DAY) for k, _, _, _, n in orders for i in range(n)]
        spark.createDataFrame(
            lines,
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        ).write.parquet(f"{tmp_path}/lineitem.parquet")
        spark.createDataFrame(
            [(c, f"c{c}", 0, bal, "MACHINERY") for c, bal in balances.items()],
            "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        ).write.parquet(f"{tmp_path}/customer.parquet")
        return str(tmp_path)

    return write


def test_videos_of_chunks_over_999_are_found(spark, order_tables):
    sf = order_tables([(999_999, 7, "O", "1-URGENT", 2), (1_234_567, 7, "O", "1-URGENT", 2), (1_234_568, 7, "O", "5-LOW", 2)], {7: 10.0})
    rec = order_recording(spark, sf)
    expected = files.video_paths(rec.episodes, rec.infos, rec.features)
    missing = files.missing_videos(expected, rec.inventory).select(*KEYS, "path").collect()
    # The priority 5-LOW has no video; the others have, whatever the digits of their chunk.
    assert [tuple(r) for r in missing] == [("7", 1_234_568, "videos/observation.images.top/chunk-1234/file-1234568.mp4")]


def test_info_queries_number_no_frames(spark, order_tables, monkeypatch):
    from trajlake.plans import q_checks, q_sources, views

    def refused(*_):
        raise AssertionError("frames are numbered for a query that reads none of them")

    monkeypatch.setattr(views, "build_order_frames", refused)
    sf = order_tables([(1, 7, "O", "2-HIGH", 2), (2, 7, "F", "5-LOW", 3), (3, 8, "O", "1-URGENT", 1)], {7: 10.0, 8: -10.0})
    assert q_checks.missing_keys(spark, sf).count() == 0
    totals = q_sources.dataset_info(spark, sf).select("dataset", "total_episodes").collect()
    assert sorted(tuple(r) for r in totals) == [("7", 2), ("8", 2)]
    lengths = views.order_episodes(spark, sf).select("episode_index", "length").collect()
    assert sorted(tuple(r) for r in lengths) == [(1, 3), (2, 3), (3, 1)]
    assert q_sources.parquet_listing(spark, sf).count() == 4
