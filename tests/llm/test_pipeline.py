"""The pipeline on a small table, stage by stage against brute force."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from attnstrata.llm import byte_bpe, language_crf, pii_spans

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "sto", "fle") for b in ("ba", "do", "fi", "gu", "ta", "pel", "nor")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [prose(20), prose(30)]
    texts = [prose(rng.randrange(30, 90)) for _ in range(40)]
    texts += [texts[3], texts[4].upper(), texts[5] + " more", None, "", "12 34 !?", "one"]
    texts += [f"{prose(9)} {items[0]} {prose(9)}", f"{prose(5)}. {items[1].upper()}", f"{prose(9)} +1 (555) 010-1234 and a.b@c.example {prose(9)}"]
    ids = [*range(len(texts) - 1), None]
    rows = [(i, t, "xx", "s", None if t is None else len(t), 1.5) for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[0])  # a row that repeats
    folder = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, s double"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def grams(text):
    found = [w.lower() for w in (text or "").split()]
    return frozenset(zip(*(found[k:] for k in range(5)), strict=False)) if len(found) > 4 else frozenset([tuple(found)])


def test_each_stage_against_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        if k == 0:  # the only language is learned from the rows themselves
            kept = [r for r in kept if any(map(str.isalpha, r[1] or ""))]
        elif k == 1:
            sets = [(r[0], grams(r[1])) for r in kept if r[0] is not None]
            root = {i: i for i, _ in sets}
            for _ in sets:
                for i, a in sets:
                    for j, b in sets:
                        if 100 * len(a & b) >= 80 * len(a | b):
                            root[i] = root[j] = min(root[i], root[j])
            kept = [r for r in dict.fromkeys(kept) if r[0] is None or root[r[0]] == r[0]]
        elif k == 2:
            kept = [r for r in kept if r[0] is None or not any(" ".join(i.split()[1:]) in (r[1] or "").lower() for i in items)]
        elif k == 3:
            clean = {}
            model = None
            for r in kept:
                text = r[1]
                base, added = pii_spans.find(text, model)
                for kind, a, b in sorted(base + added, key=lambda s: -s[1]):
                    text = text[:a] + f"<{pii_spans.KINDS[kind].upper()}>" + text[b:]
                clean[r] = text
            kept = [(r[0], clean[r], *r[2:4], len(clean[r]), r[5]) for r in kept]
        if k < 4:
            assert found.columns == docs.columns, name
            assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr), name
            path = f"{folder}/stage{k}-{name.replace(' ', '-')}.parquet"
            found.write.parquet(path)
            docs = spark.read.parquet(path)
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(), special_tokens={}).encode_ordinary
    want = []
    for r in kept:
        ids = encode(r[1])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha(r[1].encode())))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(want, key=repr)


def test_near_copies_by_five_words(spark):
    rng = random.Random(7)
    base = [f"{rng.choice(VOCABULARY)}{k}" for k in range(200)]
    texts = {0: base}
    for doc_id, changes in ((1, (20, 70, 120, 170)), (2, (20, 60, 100, 140, 180)), (3, (199,)), (4, range(0, 200, 9))):
        texts[doc_id] = [f"new{doc_id}" if k in changes else w for k, w in enumerate(base)]
    texts[5], texts[6] = base[:4], [*base[:4], "x"]
    sets = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)} for i, w in texts.items()}
    root = {i: i for i in texts}
    for _ in texts:
        for i, a in sets.items():
            for j, b in sets.items():
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert root[1] == 0
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    kept = corpus_pipeline.join_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i in texts if root[i] == i]


def test_an_empty_table_stays_empty(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
    assert language_crf.train(docs) is None
