"""What grows with the rows: no plan broadcasts a table that its own steps have multiplied, and none does work twice."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tabclone.functions import rng
from tabclone.operators import audit, copula, profile
from tabclone.operators.ranking import hash_index

SEED = "11"


def plan(df) -> str:
    """The plan that ran, after its stages' sizes were known."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("by", [None, ["g"]])
def test_copula_of_few_values_broadcasts_no_positions(spark, by):
    df = spark.range(20_000).select("id", (F.col("id") % 2).cast("string").alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("v"))
    table = copula.order_table(df.withColumn("all", F.lit(1)), "v", by or ["all"])
    assert table.count() < 2000
    new = copula.resimulate(df, ["v"], "id", SEED, by=by)
    assert "SortMergeJoin" in plan(new)
    # each drawn value is the one at its row's position among the sorted values of its group
    rows = df.withColumn("u", rng.uniform(SEED, "copula:v", F.col("id"))).collect()
    held = {}
    for r in rows:
        if r["v"] is not None:
            held.setdefault(r["g"] if by else 1, []).append(r["v"])
    held = {k: sorted(x) for k, x in held.items()}
    want = {}
    for r in rows:
        x = held[r["g"] if by else 1]
        want[r["id"]] = None if r["v"] is None else x[max(1, min(len(x), math.ceil(len(x) * r["u"] - 4 * 2.220446049250313e-16))) - 1]
    assert {r["id"]: r["v"] for r in new.collect()} == want


def test_draws_broadcast_no_multiplied_rows(spark):
    ids = spark.range(300).select(F.col("id").alias("__rid"), (F.col("id") % 3).cast("string").alias("o|a"), (F.col("id") % 5).alias("o|b"), F.lit("f").alias("o|f"))
    drawn = audit._draw(ids, ["a", "b"], {"b": ["a"]}, 4, ["a", "f"])
    told = plan(drawn)
    assert "SortMergeJoin" in told and not re.search(r"BroadcastHashJoin \[[^\]]*__(rid|k)", told)
    rows = drawn.collect()
    assert len(rows) == 1200 and {(r["__draw"], r["__rid"]) for r in rows} == {(d, i) for d in range(1, 5) for i in range(300)}
    assert all(r["o|a"] == str(r["__rid"] % 3) and r["o|f"] == "f" for r in rows)
    assert sorted(r["p|b"] for r in rows if r["__draw"] == 1 and r["o|a"] == "0") == sorted(i % 5 for i in range(0, 300, 3))


def test_profile_deals_labels_out(spark):
    df = spark.range(500).select((F.col("id") % 40).cast("string").alias("a"), F.when(F.col("id") > 9, F.col("id").cast("string")).alias("b"), (F.col("id") % 2 == 0).alias("c"), "id").coalesce(1)
    assert profile.label_counts(df, ["a", "b", "c"]) == {"a": 40, "b": 490, "c": 2} and profile.label_counts(df, []) == {}
    found = {p.col: p for p in profile.profile(df)}
    assert (found["a"].distinct, found["b"].distinct, found["b"].missing, found["id"].distinct) == (40, 490, 10, None)


def test_index_carries_bytes_and_leaves_out_what_only_its_digest_needs(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = hash_index(df, F.md5(F.col("id").cast("string")), "k", ["g"], without=["id"])
    assert got.columns == ["g", "v", "k"]
    for g in (0, 1):
        want = sorted(range(g, 200, 2), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [r["v"] for r in got.where(f"g = {g}").orderBy("k").collect()] == want
