"""The Merkle manifest against trees built in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from attnstrata.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, node string, deal int"


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "t", 4, "n", 9) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def whole_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[k : k + 3])) for k in range(0, len(low), 3)])
    return levels


def path(levels, place):
    """Runs from a leaf to the root, and the place in each."""
    out = []
    for nodes in levels[:-1]:
        begin = place // 3 * 3
        out.append((nodes[begin : begin + 3], place - begin))
        place //= 3
    return out


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_of(*r), k) for k, r in enumerate(rows) if r[3] == s))
        trees[s] = whole_tree([x[2] for x in own]), {x[3]: place for place, x in enumerate(own)}
    top = whole_tree([trees[s][0][-1][0] for s in sources])
    out = []
    for k, r in enumerate(rows):
        levels, places = trees[r[3]]
        runs = path(levels, places[k]) + path(top, sources.index(r[3]))
        leaf = leaf_of(*r)
        bare = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        folded = leaf_of(r[0], r[1].replace("\n", ""), *r[2:]) if bare else leaf
        for run, at in runs:
            folded = sha("".join(run[:at]) + folded + "".join(run[at + 1 :]))
        proof = sha("".join(x for run, at in runs for j, x in enumerate(run) if j != at))
        out.append((r[0], leaf, levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(3)
    rows = []
    for source, n in (("hot", 100), ("one", 1), ("two", 2), (None, 5), ("", 3), ("é", 9), ("z\U0001f600", 10), ("～", 4), ("b", 28)):
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "line\n\nline é", "plain", "x" * 4000, f"{rng.random()}\n"])
            rows.append((rng.choice([None, rng.randrange(-50, 10**12), rng.randrange(60)]), text, rng.choice([None, "en", "é"]), source, rng.choice([None, 7])))
    rows += [rows[0], rows[0], rows[105]]
    return rows


@pytest.mark.parametrize("levels, partition_leaves", [(1, 4), (2, 30), (7, 20_000)])
def test_manifest_matches_plain_trees(spark, levels, partition_leaves):
    rows = tables()
    given = mm.prove(documents(spark, rows), levels, partition_leaves).withColumnRenamed("leaf", "given_leaf").collect()
    want = brute(rows)
    assert sorted((r["given_leaf"], r["subroot"], r["root"], sha("".join(r["proof"]))) for r in given) == sorted((w[1], w[2], w[3], w[4]) for w in want)
    for r in given:
        assert mm.fold(r["given_leaf"], r["proof"], (r["place"], r["leaves"]), (r["source_place"], r["sources"])) == r["root"]
    if levels == 7:
        assert sorted(map(tuple, mm.op13(documents(spark, rows)).collect()), key=repr) == want


@pytest.mark.parametrize("rows", [[(3, "a\nb", "en", "s", 3)], [(1, "\n", None, None, 1), (2, None, None, None, None)], [(k, "\n", "", f"s{k}", 1) for k in range(5)]])
def test_small_tables(spark, rows):
    assert sorted(map(tuple, mm.op13(documents(spark, rows)).collect()), key=repr) == brute(rows)


def test_an_empty_table(spark):
    assert mm.op13(documents(spark, tables()).limit(0)).collect() == []


def test_multiproofs_lack_as_little_as_possible():
    rng = random.Random(5)
    for size in (1, 2, 3, 4, 9, 10, 28, 40):
        leaves = [f"{k}" for k in range(size)]
        levels, sizes = whole_tree(leaves), mm.heights(size)
        assert [len(x) for x in levels] == sizes
        for _ in range(20):
            own = set(rng.sample(range(size), rng.randrange(1, size + 1)))
            lacking = mm.lacking(sizes, own)
            # a node is lacking if some proof has it and no leaf of the partition is below it
            needed = {
                (k, run_at) for place in own for k in range(len(sizes) - 1) for run_at in mm.run_of(place // 3**k, sizes[k])
            }
            assert set(lacking) == {(k, p) for k, p in needed if not any(o // 3**k == p for o in own)}
            derived = mm.derive(sizes, {p: leaves[p] for p in own}, {(k, p): levels[k][p] for k, p in lacking})
            for place in own:
                proof = [x for run, at in path(levels, place) for j, x in enumerate(run) if j != at]
                assert mm.expand(sizes, derived, place) == proof
                assert mm.fold(leaves[place], proof, (place, size)) == levels[-1][0]
