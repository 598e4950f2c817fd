"""Derived profiles hold every order and line item."""

import os

import pytest
from pyspark.sql import functions as F

from profilerank.plans import derived

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_nothing_is_cut(spark):
    table = lambda name: derived.table(spark, SF, name)
    customers = table("customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = table("orders").join(customers, "o_custkey", "left_semi")
    lines = table("lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    got = derived.profiles(spark, SF)
    sizes = got.agg(F.sum(F.greatest(F.size("career_history"), F.lit(0))), F.sum(F.greatest(F.size("skills"), F.lit(0))),
                    F.count("profile.summary")).first()
    assert tuple(sizes) == (orders.count(), lines.count(), table("documents").filter("text is not null").count())
    text = derived.profiles(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text


def test_skills_and_tests_of_line_items(spark, tmp_path):
    """What is collected holds the keys of a line item once; names, levels and tests follow from them."""
    tables = {
        "orders": ([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long"),
        "part": ([(1, "red gizmo", 9), (21, "never said", 5), (2, "unused", 4), (10, "red gizmo", 3)], "p_partkey long, p_name string, p_size int"),
        "lineitem": ([(1, 1, 1, 5, 30.0), (1, 2, 21, 5, 2.0), (2, 1, 2, 6, 4.0), (2, 2, 10, 6, 8.0), (1, 1, 1, 5, 30.0), (3, 1, 21, 5, 1.0)],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = derived.skills(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_") == 1, "every line item is collected once"
    got = {r.o_custkey: ([(s["name"], s["proficiency"], s["duration_months"], s["endorsements"]) for s in r.skills], r.tests)
           for r in found.collect()}
    ndcg, none = derived.SKILLS[1], derived.SKILLS[2]
    assert got[7] == ([(none, "advanced", 4, 4), ("red gizmo", "beginner", 3, 8), ("red gizmo", "intermediate", 9, 30),
                       ("red gizmo", "intermediate", 9, 30), (ndcg, None, 0, 0)], {"red gizmo": 13.0, none: 26.0, ndcg: 71.0})
    assert got[8] == ([(ndcg, None, 0, 0)], {ndcg: 71.0})
