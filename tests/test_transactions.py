"""p(x|d) of order lines."""

from thema.plans import fitted


def test_every_line_has_its_part(spark, tmp_path):
    rows = [(1, 1, 1, "A", "F"), (1, 1, 51, "A", "F"), (2, 1, 51, "R", "F"), (2, 2, 101, "N", "O"), (3, 1, 1, "N", "O")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fitted.transactions(spark, str(tmp_path)).collect()
    assert sorted((r["item_id"], r["line"], r["line_number"]) for r in got) == [(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 2), (3, 0, 1)]
    assert all(0 <= r["p"] <= 1 for r in got)
    # part 51 shares no row of Phi with part 1: an order of equal parts would give equal shares to both lines
    p = {(r["item_id"], r["line"]): r["p"] for r in got}
    assert p[1, 0] != p[1, 1]
