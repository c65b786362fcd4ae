"""Graphs, curvature, matrices and spine curves against closed forms and numpy."""

import itertools
import math

import numpy as np
import pytest

from attnstrata.operators import graph, matrices, spine

EDGE = "gid string, lo int, hi int, w double"
NODE = "gid string, node int"


def graphs(spark, spec):
    edges = [(g, a, b, w) for g, (_, es) in spec.items() for a, b, w in es]
    nodes = [(g, n) for g, (ns, _) in spec.items() for n in ns]
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)


K3 = (range(3), [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)])
C4 = (range(4), [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0)])
STAR = (range(5), [(0, i, 1.0) for i in range(1, 5)])


@pytest.mark.parametrize("method,want", [("1d", (0, 0, -1)), ("augmented", (3, 0, -1))])
def test_curvature_of_known_graphs(spark, method, want):
    edges, nodes = graphs(spark, {"k3": K3, "c4": C4, "star": STAR})
    got = {r["gid"]: r["forman_ricci"] for r in graph.forman_curvature(edges, nodes, ["gid"], method).collect()}
    assert [got[g] for g in ("k3", "c4", "star")] == pytest.approx(want)


def test_degenerate_graphs_are_nan(spark):
    edges, nodes = graphs(spark, {"isolated": (range(4), K3[1]), "bare": (range(3), []), "pair": (range(2), [(0, 1, 0.5)])})
    got = {r["gid"]: r["forman_ricci"] for r in graph.forman_curvature(edges, nodes, ["gid"]).collect()}
    assert math.isnan(got["isolated"]) and math.isnan(got["bare"])
    assert got["pair"] == pytest.approx(2.0)


def brute_curvature(edges, method):
    w = {frozenset(e[:2]): e[2] for e in edges}
    near = {}
    for e in w:
        a, b = e
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for e, we in w.items():
        u, v = sorted(e)
        common = near[u] & near[v]
        around = [
            (x, y) for x in (u, v) for y in near[x]
            if y not in (u, v) and not (method == "augmented" and y in common)
        ]
        s = sum(1 / math.sqrt(we * w[frozenset(p)]) for p in around)
        t = len(common)
        out[(u, v)] = 2 - we * s if method == "1d" else we * (t * we + 2 / we - s)
    return out


@pytest.mark.parametrize("method", ["1d", "augmented"])
def test_curvature_equals_brute_force(spark, method):
    rng = np.random.default_rng(3)
    spec = {}
    for g in range(12):
        density = rng.uniform(0.2, 0.9)
        es = [(a, b, float(rng.uniform(0.05, 2))) for a, b in itertools.combinations(range(16), 2) if rng.random() < density]
        es += [(0, b, 1.0) for b in range(1, 16) if (0, b) not in {e[:2] for e in es}]  # a hub
        spec[str(g)] = (range(16), es)
    edges, _ = graphs(spark, spec)
    got = {(r["gid"], r["lo"], r["hi"]): r["curvature"] for r in graph.forman_edges(edges, ["gid"], method).collect()}
    want = {(g, *e): c for g, (_, es) in spec.items() for e, c in brute_curvature(es, method).items()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("weak", [1e-20, 1e-30, 1e-42])
@pytest.mark.parametrize("method", ["1d", "augmented"])
def test_weak_neighbours_cancel_exactly(spark, method, weak):
    """A triangle of one strong and two weak edges, and strong edges at its ends."""
    spec = {0: (range(5), [(0, 1, 0.5), (0, 2, weak), (1, 2, weak), (0, 3, 0.3), (1, 4, 0.2)])}
    edges, _ = graphs(spark, spec)
    got = {(r["lo"], r["hi"]): r["curvature"] for r in graph.forman_edges(edges, ["gid"], method).collect()}
    want = brute_curvature(spec[0][1], method)
    assert got[0, 1] == pytest.approx(want[0, 1], rel=1e-9)
    assert got[0, 3] == pytest.approx(want[0, 3], rel=1e-6)


def test_attention_graph_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    a = rng.random((8, 8)) ** 3
    a /= a.sum(axis=1, keepdims=True)
    attn = spark.createDataFrame(
        [(0, i, j, float(a[i, j])) for i in range(8) for j in range(8)], "gid int, src int, dst int, w double"
    )
    want = {}
    for i in range(8):
        order = sorted((j for j in range(8) if j != i), key=lambda j: -a[i, j])[:3]
        for j in order:
            e = (min(i, j), max(i, j))
            want[e] = max(want.get(e, 0), (a[i, j] + a[j, i]) / 2)
    edges, nodes = graph.attention_graph(attn, ["gid"], 3)
    got = {(r["lo"], r["hi"]): r["w"] for r in edges.collect()}
    assert got == pytest.approx(want) and nodes.count() == 8
    few, _ = graph.attention_graph(attn.filter("src < 2 and dst < 2"), ["gid"], 32)
    assert few.count() == 1


def matrix_table(spark, named):
    rows = [(n, i, [float(x) for x in r]) for n, m in named.items() for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "name string, row_idx int, row array<double>").repartition(5)


def test_spectral_closed_forms(spark):
    named = {f"eye{n}": np.eye(n) for n in (4, 16, 96)}
    named["rank1"] = np.outer(np.arange(1, 9), np.arange(2, 10))
    named["zero"] = np.zeros((8, 8))
    got = {r["name"]: r for r in matrices.spectral_features(matrix_table(spark, named), ["name"], 4).collect()}
    for n in (4, 16, 96):
        assert got[f"eye{n}"]["stable_rank"] == pytest.approx(n)
        assert got[f"eye{n}"]["spectral_entropy"] == pytest.approx(math.log(n))
        assert got[f"eye{n}"]["grassmannian"] == pytest.approx(0, abs=1e-10)
    assert got["rank1"]["stable_rank"] == pytest.approx(1)
    assert got["rank1"]["spectral_entropy"] == pytest.approx(0, abs=1e-9)
    assert got["zero"]["stable_rank"] == 0 and got["zero"]["spectral_entropy"] == 0


def test_decompose_refuses_bad_k(spark):
    m = matrix_table(spark, {"a": np.eye(4)})
    with pytest.raises(ValueError):
        matrices.decompose(m, ["name"], 0)
    with pytest.raises(Exception, match="exceeds"):
        matrices.decompose(m, ["name"], 5).collect()


def projector(m, k):
    u = np.linalg.svd(m)[0][:, :k]
    return u @ u.T


def test_features_and_pairs_equal_numpy(spark):
    rng = np.random.default_rng(11)
    heads = {h: rng.normal(size=(12, 12)) for h in range(6)}
    heads[5] = heads[2].copy()
    rows = [("e", h, i, [float(x) for x in r]) for h, m in heads.items() for i, r in enumerate(m)]
    table = spark.createDataFrame(rows, "event_id string, head int, row_idx int, row array<double>")
    got = {(r["h_i"], r["h_j"]): r["dist"] for r in matrices.grassmann_pairs(table, ["event_id"], k=4).collect()}
    assert list(sorted(got)) == list(itertools.combinations(range(6), 2))
    for (i, j), d in got.items():
        want = np.linalg.norm(projector(heads[i], 4) - projector(heads[j], 4))
        assert d == pytest.approx(want, abs=1e-9)
    assert got[(2, 5)] == pytest.approx(0, abs=1e-10)
    f = {r["head"]: r for r in matrices.spectral_features(table, ["event_id", "head"], 4).collect()}
    for h, m in heads.items():
        s = np.linalg.svd(m, compute_uv=False)
        p = s**2 / (s**2).sum()
        assert f[h]["stable_rank"] == pytest.approx((s**2).sum() / s[0] ** 2)
        assert f[h]["spectral_entropy"] == pytest.approx(-(p * np.log(p)).sum())
        axes = np.diag((np.arange(12) < 4) * 1.0)
        assert f[h]["grassmannian"] == pytest.approx(np.linalg.norm(projector(m, 4) - axes))


def test_gram_and_context_equal_numpy(spark):
    rng = np.random.default_rng(2)
    q, k, v = (rng.normal(size=(2, 30, 5)) for _ in range(3))
    a = rng.random((2, 30, 30)) * (rng.random((2, 30, 30)) < 0.4)
    qkv = spark.createDataFrame(
        [(g, t, q[g, t].tolist(), k[g, t].tolist(), v[g, t].tolist()) for g in range(2) for t in range(30)],
        "gid int, token int, q array<double>, k array<double>, v array<double>",
    ).repartition(4)
    attn = spark.createDataFrame(
        [(g, i, j, float(a[g, i, j])) for g in range(2) for i in range(30) for j in range(30) if a[g, i, j]],
        "gid int, src int, dst int, w double",
    )
    got = {(r["gid"], r["row_idx"]): r["row"] for r in matrices.gram(qkv, ["gid"], "q", "k").collect()}
    for g in range(2):
        assert np.allclose([got[(g, i)] for i in range(5)], q[g].T @ k[g])
    context = matrices.weighted_context(attn, qkv, ["gid"], block=7)
    rows = {(r["gid"], r["src"]): r["context"] for r in context.collect()}
    for g in range(2):
        assert np.allclose([rows[(g, i)] for i in range(30)], a[g] @ v[g])


def test_spine_curve_equals_numpy(spark):
    rng = np.random.default_rng(8)
    n, layers = 6, 3
    pairs = list(itertools.combinations(range(n), 2))
    d = rng.random((layers, len(pairs)))
    edges = spark.createDataFrame(
        [("e", "qkt_grassmannian", l, i, j, float(d[l, p])) for l in range(layers) for p, (i, j) in enumerate(pairs)],
        "event_id string, edge_type string, layer int, h_i int, h_j int, dist double",
    )
    ricci = [[1.0, 2.0, math.nan, 4.0, math.nan, math.nan], [math.nan] * 6, [0.5] * 6]
    atomic = spark.createDataFrame(
        [("e", l, h, ricci[l][h]) for l in range(layers) for h in range(n)],
        "event_id string, layer int, head int, forman_ricci_attention_graph double",
    )
    got = {r["layer"]: r for r in spine.spine_curve(edges, atomic).collect()}
    for l in range(layers):
        w = np.zeros((n, n))
        for p, (i, j) in enumerate(pairs):
            w[i, j] = w[j, i] = 1 / (1 + d[l, p])
        gap = np.linalg.eigvalsh(np.diag(w.sum(axis=1)) - w)[1]
        assert got[l]["mean_grassmannian"] == pytest.approx(d[l].mean())
        assert got[l]["spectral_gap"] == pytest.approx(gap)
        assert got[l]["modularity"] == pytest.approx(d[l].std() / d[l].mean())
    assert got[0]["mean_forman_ricci"] == pytest.approx(7 / 3)
    assert math.isnan(got[1]["mean_forman_ricci"])
    curve = {r["layer"]: r["mean_distance"] for r in spine.layer_curve(edges, n_heads=n).collect()}
    for l in range(layers):
        assert curve[l] == pytest.approx(d[l].sum() * 2 / n**2)


def test_dense_form_and_validation(spark):
    edges = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 2, 0.7), (1, 1, 2, 0.9)], "g int, h_i int, h_j int, dist double")
    got = {(r["i"], r["j"]): r["v"] for r in matrices.edges_to_dense(edges, ["g"]).collect()}
    assert len(got) == 9 and got[(2, 1)] == 0.9 and got[(1, 1)] == 0.0
    ragged = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [1.0])], "g int, row_idx int, row array<double>")
    assert not matrices.validate_matrices(ragged, ["g"]).first()["is_valid"]
    wide = spark.createDataFrame([(1, 0, [1.0, 2.0])], "g int, row_idx int, row array<double>")
    assert matrices.validate_matrices(wide, ["g"]).first()["is_valid"]
    assert not matrices.validate_matrices(wide, ["g"], square=True).first()["is_valid"]


def test_missing_summary_is_an_error(spark):
    events = spark.createDataFrame([("a", "B1", True), ("b", "B1", False)], "event_id string, bin_id string, is_fail boolean")
    summary = spark.createDataFrame([("a", 0, 0, "stable_rank_qkt", 1.0)], "event_id string, layer int, head int, feature string, mean double")
    with pytest.raises(Exception, match="no tensor summary for event b"):
        spine.event_feature_matrix(events, summary).collect()
    assert [r[0] for r in spine.missing_events(events, summary).select("event_id").collect()] == ["b"]
