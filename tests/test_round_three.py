"""Ties, sums and samples that the reviewer's third round found at larger sizes."""

import datetime as dt
import os
import shutil
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect
from panelloom.llm import neardup, toxicity
from panelloom.plans import fixtures, load_registry
from panelloom.sources import prices as prices_src

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_validated_prices_take_the_first_of_tied_lines(spark, tmp_path):
    for name in os.listdir(SF):
        shutil.copy(os.path.join(SF, name), tmp_path / name)
    lines = pq.read_table(f"{SF}/lineitem.parquet").slice(0, 600)
    twice = pa.concat_tables([lines.set_column(lines.schema.get_field_index("l_extendedprice"), "l_extendedprice", pa.array([by * (x + 1) for x in range(len(lines))], pa.float64())) for by in (2.0, 1.0, 3.0)])
    (tmp_path / "lineitem.parquet").chmod(0o644)
    pq.write_table(twice, tmp_path / "lineitem.parquet")
    line = compare(spark, connect(str(tmp_path)), load_registry()["prices_validate"], str(tmp_path))
    assert line.startswith("OK"), line


def test_validated_prices_do_not_depend_on_the_order_of_tied_rows(spark):
    day = dt.date(2024, 1, 2)
    rows = [("A", day, 5.0, 1), ("A", day, 4.0, 1), ("A", day, 6.0, 1), ("A", day, 1.0, 2), ("A", day, 2.0, None), ("A", dt.date(2024, 1, 3), 7.0, 3)]
    for dealt in (rows, rows[::-1]):
        got = prices_src.validate_prices(spark.createDataFrame(dealt, "ticker string, date date, close double, batch long").coalesce(1))
        assert sorted(r["close"] for r in got.collect()) == [4.0, 7.0]


def test_toxicity_brings_little_to_the_driver(spark):
    draw = np.random.default_rng(3)
    words = ["".join(map(chr, draw.integers(97, 123, 6))) for _ in range(400)]
    texts = [(i, " ".join(words[w] for w in draw.integers(0 if i % 2 else 60, 400, 300))) for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.fit_toxicity(docs, labels)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert model.learnt and np.count_nonzero(model.weight) == toxicity.FEATURES
    # 17 when written; with rows and counts as Python objects it was more than this
    assert peak < 25, peak


def test_books_read_the_lines_once(spark, tmp_path):
    """Closes of all lines are read again from where they are stored."""
    sf = str(tmp_path / "sf")
    shutil.copytree(SF, sf)
    for book in (fixtures.stock_prices, fixtures.proxy_prices, fixtures.benchmark_prices):
        book(spark, sf)
        assert not any("lineitem" in f for f in book(spark, sf).inputFiles()), book.__name__
    assert not any("lineitem" in f for f in fixtures.month_end_dates(spark, sf).inputFiles())
    part = fixtures.stock_prices(spark, sf, fixtures.table(spark, sf, "lineitem").where("l_orderkey % 2 = 0"))
    assert any("lineitem" in f for f in part.inputFiles())


def test_settled_groups_are_left_out_of_the_last_round(spark, tmp_path, monkeypatch):
    """Group 1 is one class, group 2 falls into twenty; the last round reads no table that still holds group 1."""
    rows = [(1, i, b"x", 1) for i in range(40)] + [(2, 100 + i, bytes([i // 2]), 1) for i in range(40)]
    path = str(tmp_path / "members")
    spark.createDataFrame(rows, "grp long, doc long, payload binary, one long").write.parquet(path)
    read, run = [], neardup.linked_in_blocks

    def noted(members, *args):
        read.append((members.inputFiles(), members.select("grp").distinct().count()))
        return run(members, *args)

    monkeypatch.setattr(neardup, "linked_in_blocks", noted)
    equal = lambda left, right: np.nonzero(np.array([[a == b for b in right] for a in left]))
    got = neardup.linked_components(spark.read.parquet(path), "one", 8, equal)
    assert {(r["doc"], r["comp"]) for r in got.collect()} == {(i, 0) for i in range(40)} | {(100 + i, 100 + i // 2 * 2) for i in range(40)}
    assert [groups for _, groups in read] == [2, 1, 1]
    assert not any(path in f for f in read[2][0])
