import gzip
import io
import os
import random

import pytest

from thema.llm.warc import pages_from_warc, read_range, read_warc, record, records, write_warc
from thema.storage import shared_dir


@pytest.mark.parametrize("split", [7, 100, 5000, 10**7])
@pytest.mark.parametrize("block", [64, 1 << 20])
def test_every_split_owns_its_records(split, block):
    """With magic bytes inside payloads, junk between members, and a member cut short."""
    r = random.Random(0)
    made = [record({"X-Page-ID": str(i)}, os.urandom(r.choice([0, 10, 3000, 20_000])) + b"\x1f\x8b\x08" * 3) for i in range(30)]
    blob = b"junk\x1f\x8b\x08" + made[0] + b"garbage" + gzip.compress(b"no record") + b"".join(made[1:20]) + made[20][:50] + b"".join(made[21:])
    got = [h["x-page-id"] for s in range(0, len(blob), split) for _, h, _ in read_range(io.BytesIO(blob), len(blob), s, s + split, block)]
    assert got == [str(i) for i in range(30) if i != 20]


def test_records_of_one_member():
    two = gzip.decompress(record({"A": "1"}, b"x\r\n\r\ny")) + gzip.decompress(record({"A": "2", "B": "li\r\nne", "C": None}, b""))
    got = list(records(two))
    assert [(h["a"], p) for h, p in got] == [("1", b"x\r\n\r\ny"), ("2", b"")] and got[1][0]["b"] == "li%0D%0Ane" and "c" not in got[1][0]


@pytest.mark.parametrize("split", [10**9, 20_000])
def test_round_trip_of_a_table(spark, sf_dir, split):
    pages, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark)
    assert write_warc(pages.repartition(3), path) == pages.count()
    got = pages_from_warc(read_warc(spark, path, split))
    assert got.count() == pages.count() and pages.select(got.columns).exceptAll(got).count() == 0


def test_edges(spark):
    rows = [(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1), (1, "u", "é\r\n\r\nx", 1), (2, "u", None, 1), (3, "v", "z" * 3_000_000, 1)]
    path = shared_dir(spark)
    assert write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), path) == 6
    got = pages_from_warc(read_warc(spark, path, 1000)).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(str(r[:3]) for r in rows)
    path = shared_dir(spark)
    os.makedirs(path.removeprefix("file://"))
    assert write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path) == 0 and read_warc(spark, path).collect() == []


def test_query_splits_inside_files(spark, sf_dir):
    """The query's ranges are several to a file where files are larger than the least range."""
    path = f"{shared_dir(spark)}"
    pages = spark.createDataFrame([(i, f"u{i}", os.urandom(4000).hex()) for i in range(300)], "page_id long, url string, html string")
    assert write_warc(pages.coalesce(1), path) == 300
    own = read_warc(spark, path)
    assert own.rdd.getNumPartitions() > 1 and len([f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".gz")]) == 1
    assert pages_from_warc(own).exceptAll(pages).count() == 0 and own.count() == 300
