"""Sums that don't depend on how rows are dealt over tasks."""

from __future__ import annotations

import math
from itertools import permutations, product

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonagrid.functions.sums import rounded_sum
from sonagrid.operators import composites, statistics
from sonagrid.plans import catalog
from tests.compare import assert_same


def test_sums_do_not_depend_on_the_order(spark):
    """Four numbers in all orders have one sum; nulls and odd values are as in a sum."""
    cells = [(k, a) for k, order in enumerate(permutations((0.1, 0.7, 0.35, 0.900000001))) for a in order]
    rows = spark.createDataFrame([*cells, (90, None), (91, None), (91, 2.0), (92, float("inf")), (93, 1e300), (94, -3.25), (95, float("nan"))], "note long, amp double").repartition(7)
    got = {r.note: r.s for r in rows.groupBy("note").agg(rounded_sum(F.col("amp")).alias("s")).collect()}
    assert {got[k] for k in range(24)} == {2.050000001} and math.isnan(got.pop(95))
    assert {k: got[k] for k in range(90, 95)} == {90: None, 91: 2.0, 92: math.inf, 93: 1e300, 94: -3.25}


def test_notes_of_equal_components_are_tied(spark):
    """The sum of these square roots lies on the edge of its ninth decimal: on which side depends on their order."""
    edge = (0.23796462709189137, 0.5442292252959519, 0.36995516653398797)
    assert {a + b + c for a, b, c in permutations(map(math.sqrt, edge))} == {1.8337745144999997, 1.8337745145}
    notes = [*permutations(edge), (0.5, 0.5, 0.5), (0.9, 0.2), (0.3,)]
    rows = spark.createDataFrame([(k, a) for k, note in enumerate(notes) for a in note], "note long, amp double").coalesce(1)
    values = [(math.fsum(note), math.fsum(map(math.sqrt, note))) for note in notes]
    want = statistics.spearman(spark.createDataFrame([(round(x, 9), round(y, 9)) for x, y in values], "x double, y double"), "x", "y").first()
    found = composites.phi_stability(rows, ("linear", "sqrt")).first()
    assert found.n == len(notes) and found.rho == pytest.approx(want.rho, abs=1e-12)


def test_discounts_are_added_up_in_the_order_of_the_table(spark, tmp_path):
    """Line items in three files of falling and rising size: discounts that add up to 0.2 fall on the side on which SQL has them, on one thread."""
    cents = [c for c in product(range(11), repeat=4) if sum(c) == 20]
    items = [(None if k == 7 else k, i, c / 100) for k, note in enumerate(cents) for i, c in enumerate(note)] + [(-1, 0, None), (-2, 1, 0.3)]
    path = tmp_path / "lineitem.parquet"
    path.mkdir()
    con = duckdb.connect(config={"threads": 1})
    for name, places, copies in (("a", (0,), 1), ("b", (1, 2), 40), ("c", (3,), 3)):
        rows = [r for r in items if r[1] in places] + [(-3, 0, 0.01)] * (500 * copies)
        con.register("part", pa.table({"l_orderkey": pa.array([r[0] for r in rows], pa.int64()), "l_discount": pa.array([r[2] for r in rows], pa.float64())}))
        con.sql(f"COPY (SELECT *, 'N' AS l_returnflag, 0.01 AS l_tax, random()::VARCHAR AS l_comment FROM part) TO '{path}/{name}.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql("SELECT count(*) FILTER (WHERE l <= 0.2), count(*) FROM (SELECT sum(l_discount) AS l FROM lineitem WHERE l_orderkey >= 0 GROUP BY l_orderkey)").fetchall()[0]
    assert 0 < want[0] < want[1] == len(cents) - 1
    assert_same(catalog.queries()["quality_grade"](spark, str(tmp_path)), con, catalog.oracle_sql()["quality_grade"])
