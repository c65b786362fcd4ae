"""Nested attention graphs, the sweep over k, and the bootstrap in one pass, against plain computations."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attnstrata.functions import digests
from attnstrata.functions import fixed_values as fixed
from attnstrata.operators import compare, documents, graph, statistics


def attention(spark, n_events=6, n=7, seed=1):
    rng = random.Random(seed)
    rows = [
        (f"e{e}", s, d, rng.choice([rng.random(), 0.5, 1e-6]))
        for e in range(n_events) for s in range(n) for d in range(n) if rng.random() < 0.9
    ]
    return spark.createDataFrame(rows, "event_id string, src int, dst int, w double")


def test_nested_graphs_are_those_of_each_k(spark):
    attn = attention(spark).cache()
    ks = (5, 1, 3, 3)
    edges, nodes = graph.nested_graphs(attn, ["event_id"], ks)
    curved = {(r["event_id"], r["k"]): r["forman_ricci"] for r in graph.nested_curvature(attn, ["event_id"], ks).collect()}
    assert len(curved) == 18
    for k in set(ks):
        alone, alone_nodes = graph.attention_graph(attn, ["event_id"], k)
        both = edges.filter(F.col("k") == k).drop("k")
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.select(both.columns).collect()))
        assert sorted(map(tuple, nodes.filter(F.col("k") == k).drop("k").collect())) == sorted(map(tuple, alone_nodes.collect()))
        for r in graph.attention_graph_curvature(attn, ["event_id"], k).collect():
            assert curved[r["event_id"], k] == pytest.approx(r["forman_ricci"], nan_ok=True)


def test_sweep_from_attention(spark):
    """Labels follow the curvature, so adding it gains; bins with an @ in their name are bins like others."""
    attn = attention(spark, 80, 6, 3)
    curved = graph.nested_curvature(attn, ["event_id"], (2, 4)).filter("k = 4").select("event_id", "forman_ricci").toPandas()
    middle = np.nanmedian(curved["forman_ricci"])
    rng = random.Random(2)
    rows = [(r.event_id, f"B@{k % 2}", bool(r.forman_ricci > middle), rng.random()) for k, r in enumerate(curved.itertuples())]
    events = spark.createDataFrame(rows, "event_id string, bin_id string, is_fail boolean, noise double")
    gains, winner = compare.k_sweep(
        events.drop("noise"), events.select("event_id", "noise"), attn, features=["noise"], bins=["B@0", "B@1", "none"],
        replicates=20, candidates=(2, 4), min_rows=20,
    )
    found = {(r["k"], r["bin_id"]): r["gain"] for r in gains.collect()}
    assert set(found) == {(k, b) for k in (2, 4) for b in ("B@0", "B@1", "none")}
    assert found[4, "none"] is None and found[2, "none"] is None
    assert max(found[4, "B@0"], found[4, "B@1"]) > 0.1
    assert winner.first()["winner_k_attn"] in (2, 4)


@pytest.mark.parametrize("segments", [1, 7])
def test_bootstrap_matches_one_replicate_at_a_time(spark, segments):
    rng = random.Random(5)
    rows = [(f"{k}", "ab"[k % 3 == 0], rng.random() < 0.4, rng.choice([float(rng.randrange(12)), rng.random(), float("inf"), float("nan")])) for k in range(150)]
    rows += [("x", "one", True, 1.0), ("y", "one", True, 2.0), ("z", "n", True, None), ("u", "n", False, 0.0), ("v", "n", False, float("-inf"))]
    df = spark.createDataFrame(rows, "event_id string, bin_id string, is_fail boolean, s double")
    replicates = 260  # more than one block
    got = {r["bin_id"]: r for r in statistics.bootstrap_auroc_ci(
        df, ["bin_id"], "is_fail", "s", id_col="event_id", replicates=replicates, segments=segments
    ).collect()}
    indexed, draws = statistics.bootstrap_weights(df, ["bin_id"], id_col="event_id", replicates=replicates)
    at = {(r["bin_id"], r["_i"]): r for r in indexed.collect()}
    drawn = {}
    for r in draws.collect():
        drawn.setdefault((r["bin_id"], r["replicate"]), []).append((at[r["bin_id"], r["_i"]], r["weight"]))
    aurocs = {}
    place = lambda x: (-1, 0) if x is None else (2, 0) if x != x else (0, x)
    for (name, _), picked in drawn.items():
        won = pairs = 0.0
        for a, wa in picked:
            for b, wb in picked:
                if a["is_fail"] and not b["is_fail"]:
                    pairs += wa * wb
                    x, y = place(a["s"]), place(b["s"])
                    won += wa * wb * (1.0 if x > y else 0.5 if x == y else 0.0)
        if pairs:
            aurocs.setdefault(name, []).append(won / pairs)
    for name, values in aurocs.items():
        if name == "n":
            continue  # null and -inf tie
        values.sort()
        m = len(values)
        assert got[name]["n_replicates"] == m
        assert got[name]["auroc_ci_lower"] == pytest.approx(values[int(np.floor(m * 0.025))])
        assert got[name]["auroc_ci_upper"] == pytest.approx(values[int(np.floor(m * 0.975)) - 1])
    assert got["one"]["n_replicates"] == 0 and np.isnan(got["one"]["auroc_ci_lower"])


def test_bootstrap_spreads_draws_over_tasks(spark, monkeypatch):
    """Tasks are dealt by draws, not by the bytes of the rows that make them; many blocks and ranges give what one gives."""
    rng = random.Random(6)
    rows = [(f"{k}", "ab"[k % 3 == 0], rng.random() < 0.4, float(rng.randrange(9))) for k in range(240)]
    df = spark.createDataFrame(rows, "event_id string, bin_id string, is_fail boolean, s double")

    def run(name):
        spark.sparkContext.setJobGroup(name, name)
        found = statistics.bootstrap_auroc_ci(df, ["bin_id"], "is_fail", "s", id_col="event_id", replicates=30).orderBy("bin_id").collect()
        spark.sparkContext.setJobGroup("rest", "rest")
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
        return found, max(s.numTasks for s in stages if s)

    whole, _ = run("whole")
    monkeypatch.setattr(statistics, "TASK_DRAWS", 120, raising=False)
    monkeypatch.setattr(statistics, "HELD_DRAWS", 60, raising=False)
    monkeypatch.setattr(statistics, "INDEX_BLOCK", 16, raising=False)
    monkeypatch.setattr(statistics, "RANGE_ROWS", 20, raising=False)
    monkeypatch.setattr(statistics, "REPLICATE_BLOCK", 7)
    parts, tasks = run("parts")
    assert parts == whole
    assert tasks == 60  # 240 rows x 30 replicates / 120


def test_distractors_read_their_pairs_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(x):
        calls.add(1)
        return x

    pairs = spark.createDataFrame([(q, c) for q in range(5) for c in range(8)], "q int, c int")
    found = documents.take_distractors(pairs.withColumn("c", seen.asNondeterministic()("c")), keys=["q"], candidate="c", n=3)
    assert found.groupBy("q").count().where("count = 3").count() == 5
    assert calls.value == 40


def test_lexical_pairs_with_several_common_tokens(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(12)]
    text = lambda: " ".join(["everywhere", "always", *rng.choices(words, k=rng.randrange(6))])
    q = spark.createDataFrame([(i, text()) for i in range(30)] + [(30, None), (31, "")], "q int, text string")
    c = spark.createDataFrame([(i, text()) for i in range(20)] + [(20, None), (21, "always")], "c int, text string")
    sets = lambda df: {r[0]: set((r[1] or "").split()) for r in df.collect()}
    for least in (1, 2, 3, 4):
        wanted = sorted((i, j, len(a & b)) for i, a in sets(q).items() for j, b in sets(c).items() if len(a & b) >= least)
        got = documents.lexical_pairs(q, c, question_id="q", candidate_id="c", at_least=least)
        assert sorted(map(tuple, got.collect())) == wanted


def test_small_comparisons(spark):
    a = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "event_id int, x int")
    b = spark.createDataFrame([(1, 5), (3, 6)], "event_id int, x int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(compare.found_again(a, b)) == [(1, 5), (1, 6)]
    assert rows(compare.shared_ids(a, b)) == [(1,)] and rows(compare.missing_ids(a, b)) == [(2,)]
    assert rows(compare.pooled({"p": a, "q": b})) == [(1, 5, "p"), (1, 5, "q"), (1, 6, "p"), (2, 7, "p"), (3, 6, "q")]
    votes = spark.createDataFrame([("k", 1, 4), ("k", 2, 9), ("k", 3, 9), ("l", 4, 0)], "g string, name int, total int")
    assert rows(compare.largest(votes, ["g"], "total", "name")) == [("k", 2), ("l", 4)]
    s = spark.createDataFrame([(1, 0, "a b", 2), (1, 1, "c", 1), (1, 2, "", 0), (2, 5, "d", 1)], "doc_id int, pos int, sentence string, words int")
    assert rows(documents.running_words(s, ["doc_id"], "pos").select("doc_id", "pos", "placed")) == [(1, 0, 0), (1, 1, 2), (1, 2, 3), (2, 5, 0)]
    assert rows(documents.shuffle_tail(s, ["doc_id"], -F.col("pos"))) == [(1, " c a b"), (2, "d")]
    assert fixed.SWEEP_K


def test_draws_are_hashed_in_whole_arrays_as_one_by_one(monkeypatch):
    first, second = np.arange(0, 1100, 9), np.array([0, 9, 10, 123456, 99, 100000, 7])
    # heads of one block of the hash, at its border, and beyond it
    for head in (b"bootstrap:en|", b"", "straße|".encode(), b"x" * 44, b"x" * 45, b"x" * 60):
        wanted = [[int(hashlib.sha1(head + f"{r}|{i}".encode()).hexdigest()[:16], 16) for r in first] for i in second]
        for held in (1, 200, 1 << 15):
            assert digests.pair_numbers(head, first, second, held).tolist() == wanted
    # texts of one block make no object for each
    monkeypatch.setattr(digests.hashlib, "sha1", None)
    assert digests.pair_numbers(b"bootstrap:en|", first, second).shape == (len(second), len(first))


def test_bootstrap_hashes_no_draw_by_itself(spark, monkeypatch):
    rows = pa.table({"g": ["a"] * 50, "_i": pa.array(range(50), pa.int64()), "_n": pa.array([50] * 50, pa.int64()), "_text": ["a|"] * 50})
    monkeypatch.setattr(hashlib, "sha1", None)
    packed = pa.Table.from_batches(statistics._packed_draws(["g"], 20, "bootstrap")(iter(rows.to_batches())))
    assert sum(len(x) for x in packed["_offsets"].to_pylist()) == 50 * 20 * 2
