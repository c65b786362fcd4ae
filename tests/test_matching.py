"""Balance, allocation and tier rules."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from attnstrata.operators import matching
from attnstrata.operators.positions import hash_segment, with_position
from attnstrata.functions import ids
from workloads import matching as match_queries

SCHEMA = "event_id string, bin_id string, cem_stratum_id string, is_fail boolean"


def pool(spark, cells, bin_id="B1"):
    rows = []
    for stratum, (fails, controls) in cells.items():
        rows += [(f"{bin_id}-{stratum}-f{i}", bin_id, stratum, True) for i in range(fails)]
        rows += [(f"{bin_id}-{stratum}-c{i}", bin_id, stratum, False) for i in range(controls)]
    return spark.createDataFrame(rows, SCHEMA)


def test_three_equal_cells(spark):
    matched, strata = matching.cem_match(pool(spark, {s: (5, 5) for s in "abc"}), 10)
    counts = {r["is_fail"]: r["count"] for r in matched.groupBy("is_fail").count().collect()}
    assert counts == {True: 10, False: 10}
    assert [r["n_matched_pairs"] for r in strata.collect()] == [5, 5, 5]


def test_one_sided_cell_gives_nothing(spark):
    matched, _ = matching.cem_match(pool(spark, {"a": (5, 0), "b": (5, 5)}), 5)
    assert {r["cem_stratum_id"] for r in matched.collect()} == {"b"}
    assert matched.count() == 10


def test_short_bin_is_reported_and_empty(spark):
    e = pool(spark, {"a": (1, 1), "b": (1, 1)}).union(pool(spark, {"a": (20, 20)}, "B2"))
    matched, strata = matching.cem_match(e, 10)
    assert {r["bin_id"] for r in matched.collect()} == {"B2"}
    status = {(r["bin_id"], r["requested"], r["achieved"], r["status"]) for r in strata.collect()}
    assert status == {("B1", 10, 2, "short"), ("B2", 10, 20, "matched")}


def test_same_ids_for_any_partitioning(spark):
    e = pool(spark, {s: (9, 7) for s in "abcd"})
    first = {r["event_id"] for r in matching.cem_match(e, 12)[0].collect()}
    again = {r["event_id"] for r in matching.cem_match(e.repartition(13), 12)[0].collect()}
    assert first == again


def loop_allocation(pairs, target):
    """The allocation rule as a loop over cells."""
    order = sorted(((s, p) for s, p in pairs.items() if p), key=lambda c: (-c[1], c[0]))
    total = sum(p for _, p in order)
    out = {s: target * p // total for s, p in order}
    left = target - sum(out.values())
    while left:
        for s, p in order:
            if left and out[s] < p:
                out[s] += 1
                left -= 1
    return out


def test_allocation_equals_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for case in range(300):
        pairs = {f"s{i}": rng.randint(0, 30) for i in range(rng.randint(1, 9))}
        total = sum(pairs.values())
        if total == 0:
            continue
        target = rng.randint(1, total)
        bin_id = f"{case}:{target}"
        rows += [(bin_id, s, p) for s, p in pairs.items()]
        want |= {(bin_id, s): n for s, n in loop_allocation(pairs, target).items()}
    cells = spark.createDataFrame(rows, "bin_id string, cem_stratum_id string, n_matched_pairs bigint")
    target = F.split("bin_id", ":")[1].cast("bigint")
    got = {
        (r["bin_id"], r["cem_stratum_id"]): r["n_take"]
        for r in matching.allocate(cells, target).collect()
    }
    assert got == want


def test_yield_report(spark):
    y = matching.match_yield(matching.cell_counts(pool(spark, {"a": (4, 2), "b": (0, 6), "c": (4, 0)}))).first()
    assert (y["n_strata"], y["n_strata_with_matches"], y["total_matched_pairs"]) == (3, 1, 2)
    assert y["yield_pct"] == 25.0 and y["is_compromised"]


def test_tiers(spark):
    healthy = pool(spark, {s: (15, 15) for s in "abcd"}, "B1")
    thin = pool(spark, {"a": (5, 300)}, "B2")
    report = {
        r["bin_id"]: r
        for r in matching.cem_match_tiered(healthy.union(thin), 20)[2].collect()
    }
    assert report["B1"]["oversample_factor"] == 1.5 and report["B1"]["status"] == "matched"
    assert report["B2"]["oversample_factor"] == 3.0 and report["B2"]["status"] == "needs_review"
    matched = matching.cem_match_tiered(healthy.union(thin), 20)[0]
    assert {(r["bin_id"], r["count"]) for r in matched.groupBy("bin_id").count().collect()} == {("B1", 40)}


def test_positions_by_segment_equal_plain_ones(spark):
    df = spark.range(5000).select(
        (F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("k"), "id",
        ids.order_key("x", F.col("id")).alias("h"),
    )
    plain = with_position(df, ["k"], ["h"])
    cut = with_position(df, ["k"], ["h"], segment=hash_segment("h"))
    assert plain.exceptAll(cut.select(plain.columns)).count() == 0
    few = with_position(df, ["k"], ["h"], segment=hash_segment("h"), limit=10)
    assert plain.filter("position < 10").exceptAll(few.select(plain.columns)).count() == 0
    assert few.count() == plain.filter("position < 10").count()


def test_null_keys_are_refused(spark):
    e = pool(spark, {"a": (3, 3)}).withColumn("bin_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="group key bin_id is null"):
        matching.cem_match(e, 2)[0].collect()


def test_handcheck_takes_all_of_a_small_set(spark):
    e = pool(spark, {"a": (3, 3)})
    assert matching.handcheck_sample(e, 50).count() == 6
    assert matching.handcheck_sample(e, 4).count() == 4


def test_sampled_lines_are_joined_once(spark, tmp_path):
    rng = random.Random(3)
    orders = [(k, rng.choice(["1-URGENT", "5-LOW"])) for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(rng.randrange(60), i, i % 7, 1, 5.0, 0.02, 10.0 * i, "O", rng.choice("RA")) for i in range(400)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double"
    spark.createDataFrame(lines, f"{names}, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = match_queries.w03(spark, str(tmp_path))
    # what is counted and sampled is stored: neither table is read again
    assert not [f for f in out.inputFiles() if "lineitem" in f or "orders" in f]
    found = collections.Counter((r["bin_id"], r["is_fail"]) for r in out.collect())
    pools = collections.Counter((dict(orders)[x[0]], x[-1] == "R") for x in lines)
    for b in ("1-URGENT", "5-LOW"):
        assert found[b, True] == found[b, False] == min(pools[b, True], pools[b, False]) // 2
