"""Assembly and injection: placement, policies, catalogue blocks, grading."""

import collections
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.functions import ids
from attnstrata.operators import documents


@pytest.fixture(scope="module")
def catalogue(spark):
    templates = spark.createDataFrame(
        [
            ("home", "Where does {subject} live today?", "{subject} lives in {object}."),
            ("job", "What work does {subject} do today?", "{subject} works as a {object}."),
        ],
        "template_id string, question_form string, statement_form string",
    )
    rows = [(i, "home", f"person{i}", f"town{i % 7}") for i in range(40)]
    rows += [(100 + i, "job", f"person{i}", f"trade{i % 5}") for i in range(40)]
    facts = spark.createDataFrame(rows, "fact_id bigint, template_id string, subject string, object string")
    return templates, facts


@pytest.fixture(scope="module")
def plan(spark):
    rows = [(i, "home", f"person{i % 40}", f"town{i % 40 % 7}", 20 * i, (i % 11) / 10) for i in range(33)]
    return spark.createDataFrame(
        rows,
        "plan_id bigint, template_id string, subject string, object string, target_words int, distractor_density double",
    )


def test_evidence_is_placed_after_the_target(spark, catalogue, plan):
    out = documents.assemble_documents(plan, *catalogue).collect()
    assert len(out) == 33
    for r in out:
        evidence = f"{plan_subject(r)} lives in {r['gold_answer']}."
        head, _, tail = r["document"].partition(evidence)
        n = max(1, int(r["distractor_density"] * 40))
        sentences = r["document"].count("works as a")
        assert sentences == n and "lives in" not in head + tail
        words = len(head.split())
        assert r["target_reached"] == (words >= r["target_words"])
        if r["target_reached"]:
            assert words - 4 < r["target_words"] or r["target_words"] == 0
        assert r["evidence_position_token_idx"] == words + len(evidence.split())
        prompt_tail = len(tail.split()) + len(r["question"].split()) + 3
        assert r["evidence_distance_tokens"] == prompt_tail
        assert r["gold_answer_length_tokens"] == 1 and r["cem_stratum_id"].startswith("home|")


def plan_subject(r):
    return r["question"].split()[2]


def test_blocks_do_not_change_the_result(spark, catalogue, plan):
    cols = ["event_id", "document", "plan_id"]
    one = documents.assemble_documents(plan, *catalogue).select(*cols)
    many = documents.assemble_documents(plan, *catalogue, block_facts=9).select(*cols)
    assert one.exceptAll(many).count() == 0 and many.count() == 33


def test_repeated_rows_survive_any_number_of_blocks(spark, catalogue, plan):
    cols = ["event_id", "document", "plan_id"]
    twice = plan.unionByName(plan)
    same_id = twice.unionByName(plan.withColumn("target_words", F.lit(0)))
    one = documents.assemble_documents(same_id, *catalogue).select(*cols)
    many = documents.assemble_documents(same_id, *catalogue, block_facts=3).select(*cols)
    assert one.count() == many.count() == 99
    assert one.exceptAll(many).count() == 0


def test_repeated_events_survive_any_number_of_blocks(spark, catalogue, plan):
    e = events(spark, catalogue, plan).withColumn("event_id", F.lit("same"))
    e = e.unionByName(e)
    one = documents.inject_distractors(e, *catalogue).select("plan_id", "document", "event_id")
    many = documents.inject_distractors(e, *catalogue, block_facts=3).select("plan_id", "document", "event_id")
    assert one.count() == many.count() == 66 and one.exceptAll(many).count() == 0


def test_unknown_templates_are_errors(spark, catalogue, plan):
    templates, facts = catalogue
    lost = plan.withColumn("template_id", F.lit("nowhere"))
    with pytest.raises(Exception, match="unknown template: nowhere"):
        documents.assemble_documents(lost, templates, facts).collect()
    with pytest.raises(Exception, match="unknown template: "):
        documents.fact_sentences(templates.limit(0), facts).collect()


def test_ungraded_events_stay(spark):
    e = spark.createDataFrame([("a", "Paris"), ("b", "Rome")], "event_id string, gold_answer string")
    g = spark.createDataFrame([("a", "Paris")], "event_id string, generation string")
    graded = documents.grade(e, g)
    assert {r["event_id"]: r["is_fail"] for r in graded.collect()} == {"a": False, "b": None}
    assert tuple(documents.ungraded(graded).first()) == (2, 1)


def test_many_blocks_use_salts(spark, catalogue, plan, monkeypatch):
    cols = ["event_id", "document", "plan_id"]
    one = documents.assemble_documents(plan, *catalogue).select(*cols)
    monkeypatch.setattr(documents, "BROADCAST_BLOCKS", 2)
    many = documents.assemble_documents(plan, *catalogue, block_facts=9).select(*cols)
    assert one.exceptAll(many).count() == 0 and many.count() == 33


def events(spark, catalogue, plan):
    e = documents.assemble_documents(plan, *catalogue)
    policy = F.element_at(F.array(*[F.lit(p) for p in fixed.POLICIES]), (F.col("plan_id") % 4 + 1).cast("int"))
    return e.withColumn("adversariality_policy", policy)


@pytest.mark.parametrize("block", [10_000, 9])
def test_policies(spark, catalogue, plan, block):
    before = {r["plan_id"]: r for r in events(spark, catalogue, plan).collect()}
    out = documents.inject_distractors(events(spark, catalogue, plan), *catalogue, block_facts=block).collect()
    assert len(out) == len(before)
    for r in out:
        old = before[r["plan_id"]]
        extra = r["document"][len(old["document"]):]
        policy = r["adversariality_policy"]
        assert r["document"].startswith(old["document"])
        if policy == "none":
            assert extra == "" and r["event_id"] == old["event_id"]
        elif policy == "sibling_entity":
            assert extra.count("lives in") == 3 == r["n_injected"]
            assert f"in {r['gold_answer']}." not in extra
        elif policy == "self_contradiction":
            assert extra.count("lives in") == 1 and f"in {r['gold_answer']}." not in extra
        if r["n_injected"]:
            assert r["event_id"] != old["event_id"]


def test_injected_ids_follow_from_the_text(spark, catalogue, plan):
    out = documents.inject_distractors(events(spark, catalogue, plan), *catalogue)
    assert ids.bad_id_count(out).first()["n_bad_ids"] == 0


def test_lexical_distractors_share_tokens(spark, catalogue):
    templates, facts = catalogue
    e = spark.createDataFrame(
        [("id", "home", "Where does person3 works today, person3?", "town3", "doc", "lexical")],
        "event_id string, question_template_id string, question string, gold_answer string, document string, adversariality_policy string",
    )
    out = documents.inject_distractors(e, templates, facts).first()
    assert out["document"] == "doc person3 works as a trade3." and out["n_injected"] == 1


def test_unknown_policy_is_an_error(spark, catalogue, plan):
    bad = events(spark, catalogue, plan).withColumn("adversariality_policy", F.lit("loud"))
    with pytest.raises(Exception, match="unknown policy: loud"):
        documents.inject_distractors(bad, *catalogue).collect()


def test_siblings_first_fact_and_foreign_facts(spark, catalogue, plan):
    templates, facts = catalogue
    rows = facts.collect()
    for r in documents.sibling_facts(plan, facts).collect():
        want = sum(
            f["template_id"] == r["template_id"] and f["subject"] != r["subject"] and f["object"] != r["object"]
            for f in rows
        )
        assert r["n_siblings"] == want
    asked = spark.createDataFrame([("home", "town3"), ("home", "nowhere")], "question_template_id string, gold_answer string")
    got = {r["gold_answer"]: r["fact_subject"] for r in documents.first_fact(asked, facts).collect()}
    assert got == {"town3": "person3", "nowhere": "nowhere"}
    foreign = documents.other_template_facts(templates, facts)
    assert foreign.count() == 80 and foreign.filter("for_template = template_id").count() == 0


def test_grading(spark):
    e = spark.createDataFrame([("a", "Paris"), ("b", "Rome")], "event_id string, gold_answer string")
    g = spark.createDataFrame([("a", "  The Paris.\nmore"), ("b", "Rome Rome<|end|>")], "event_id string, generation string")
    got = {r["event_id"]: (r["model_generation"], r["is_fail"]) for r in documents.grade(e, g).collect()}
    assert got == {"a": ("  The Paris.", False), "b": ("Rome Rome", True)}


@pytest.mark.parametrize("rows", [2_000_000, 0])
@pytest.mark.parametrize("at_least", [1, 2, 3])
def test_lexical_pairs_equal_brute_force(spark, monkeypatch, rows, at_least):
    """By broadcast lists and by shuffle, with a word that every text has."""
    monkeypatch.setattr(documents, "LIST_ROWS", rows)
    monkeypatch.setattr(documents, "TOKEN_SHARE", 40)
    words = "alpha beta gamma delta omega tiny a of".split()
    docs = [(i, " ".join(["common", *(words[j] for j in range(8) if (i * 37 >> j) & 1)])) for i in range(30)]
    q = spark.createDataFrame([*docs, (98, None), (99, "")], "q int, text string").repartition(3)
    c = spark.createDataFrame([*docs, (98, None), (99, "")], "c int, text string")
    sets = {i: {w for w in t.split() if len(w) > 3} for i, t in docs}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if len(sets[a] & sets[b]) >= at_least}
    got = documents.lexical_pairs(q, c, question_id="q", candidate_id="c", at_least=at_least).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_lexical_pairs_of_empty_tables(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "q int, text string")
    c = q.withColumnRenamed("q", "c")
    for a, b in ((q.limit(0), c), (q, c.limit(0))):
        assert documents.lexical_pairs(a, b, question_id="q", candidate_id="c").count() == 0


def test_a_word_of_all_candidates_lists_nobody(spark):
    """The rarer tokens are listed, and a frequent token of the shuffled join lies in several parts."""
    c = spark.createDataFrame([(i, f"common word{i % 7} name{i}") for i in range(200)], "c int, text string")
    lists = documents._token_lists(c, "c", "text", 2)
    assert lists.where("token = 'common'").count() == 0 and lists.count() == 400
    asked = c.selectExpr("c as _q", "explode(split(text, ' ')) as token")
    parts = documents._frequent(asked, "parts").collect()
    assert max(r["parts"] for r in parts) > 100 and len(parts) <= documents.TOKEN_SHARE


def test_lexical_distractors_are_the_first_in_order(spark):
    c = spark.createDataFrame([(i, f"common shared name{i}") for i in range(20)], "c int, text string")
    q = spark.createDataFrame([(7, "common shared other")], "q int, text string")
    got = documents.lexical_distractors(q, c, question_id="q", candidate_id="c", n=3).collect()
    order = sorted(range(20), key=lambda i: hashlib.sha256(f"adversarial:7|{i}".encode()).hexdigest())
    assert {r["c"] for r in got} == set(order[:3]) and {r["n_shared"] for r in got} == {2}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_listed_pairs_are_counted_where_a_question_is_read(spark, monkeypatch, most):
    """No pair is shuffled, whatever number of listed candidates is held at once."""
    monkeypatch.setattr(documents, "MEETINGS", most, raising=False)
    words = "alpha beta gamma delta omega tiny".split()
    docs = [(i, " ".join(["common", *(words[j] for j in range(6) if (i * 37 >> j) & 1)])) for i in range(30)]
    q = spark.createDataFrame([*docs, (98, None), (99, "")], "q int, text string").repartition(3)
    c = spark.createDataFrame([(f"name{i}", t) for i, t in docs] + [("none", None)], "c string, text string")
    found = documents.lexical_pairs(q, c, question_id="q", candidate_id="c")
    assert "Exchange" not in plan_of(found).split("MapInArrow")[0]
    sets = {i: {w for w in t.split() if len(w) > 3} for i, t in docs}
    want = {(a, f"name{b}", len(sets[a] & sets[b])) for a in sets for b in sets if len(sets[a] & sets[b]) >= 2}
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_questions_of_one_task_are_spread(spark, monkeypatch):
    """A table that one task reads is spread, one that all tasks read is not; rows stay."""
    monkeypatch.setattr(documents, "SPREAD_ROWS", 50, raising=False)
    rows = spark.range(60).selectExpr("cast(id as int) as q", "concat('alpha beta name', id) as text")
    c = spark.createDataFrame([(1, "alpha beta")], "c int, text string")
    for parts, shuffles in ((1, 1), (2 * spark.sparkContext.defaultParallelism, 0)):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/one-task-{parts}"
        rows.repartition(parts).write.parquet(path)
        found = documents.lexical_pairs(spark.read.parquet(path), c, question_id="q", candidate_id="c")
        assert plan_of(found).count("Exchange") == shuffles
        assert sorted(r["q"] for r in found.collect()) == list(range(60))


@pytest.mark.parametrize("few", [100_000, 0])
def test_rows_of_one_question_id_are_summed(spark, monkeypatch, few):
    """Ids that come once, several times or are null; the common tokens of a pair count once."""
    monkeypatch.setattr(documents.broadcast_if_small, "__defaults__", (few,))
    texts = [(1, "alpha beta"), (2, "alpha gamma"), (2, "gamma delta"), (None, "alpha"), (None, "alpha beta"), (3, "omega"), (4, None), (4, "beta")]
    q = spark.createDataFrame(texts, "q int, text string")
    c = spark.createDataFrame([(7, "alpha beta gamma"), (8, "delta gamma"), (None, "beta")], "c int, text string")
    want = collections.Counter()
    for a, t in texts:
        for b, u in c.collect():
            want[a, b] += len({*(t or "").split()} & {*u.split()})
    got = documents.lexical_pairs(q, c, question_id="q", candidate_id="c", at_least=1).collect()
    assert sorted(map(str, got)) == sorted(str(Row(q=a, c=b, n_shared=n)) for (a, b), n in want.items() if n)
    q = spark.createDataFrame([(1, "alpha beta everywhere")] * 2 + [(2, "alpha everywhere")], "q int, text string")
    c = spark.createDataFrame([(5, "alpha beta everywhere"), (6, "gamma everywhere")], "c int, text string")
    got = documents.lexical_pairs(q, c, question_id="q", candidate_id="c").collect()
    assert {tuple(r) for r in got} == {(1, 5, 5), (2, 5, 2)}


@pytest.mark.parametrize("n", [3, 1001])
def test_tasks_keep_the_first_of_each_group_before_a_shuffle(spark, n):
    """Few rows of a large group leave a task; null keys are no group, and positions count from 0."""
    rows = [(q, c, f"{q}:{c}") for q in (1, 2, None) for c in range(40)]
    pairs = spark.createDataFrame(rows, "note_q int, c int, note string").repartition(4).select("note", F.col("note_q").alias("q"), "c")
    found = documents.take_distractors(pairs, keys=["q"], candidate="c", n=n)
    assert found.columns == ["q", "note", "c", "position"] and found.schema["position"].dataType.typeName() == "long"
    assert (n > 1000) or "WindowGroupLimit" in plan_of(found)
    want = set()
    for q in (1, 2):
        order = sorted(range(40), key=lambda c: hashlib.sha256(f"distractor:{q}|{c}".encode()).hexdigest())
        want |= {(q, f"{q}:{c}", c, i) for i, c in enumerate(order[:n])}
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_batch_keeps_what_may_be_first():
    """By all keys, with rows of equal digits kept, as many as there are."""
    digits = ["00000003", "0000000a", "00000001", "0000000a", "0000000a", "00000002", "ffffffff", "00000000"]
    batch = pa.record_batch({"k": [1, 1, 1, 1, 1, 2, 1, 1], "u": [*"aaaaaaab"], "c": list(range(8)), "_first": digits})
    run = documents._first_of_batches(["k", "u"], 3)
    got = [r for b in run([batch, batch.slice(0, 0), batch.slice(2)]) for r in b.column("c").to_pylist()]
    assert got == [0, 1, 2, 3, 4, 5, 7] + [2, 3, 4, 5, 7]


def test_a_word_of_all_texts_is_looked_up_for_pairs_that_met(spark):
    """Packed lists hold the common word once, not for each candidate; rows of counters are those that met by a rarer word."""
    c = spark.createDataFrame([(i, f"name{i} side{i % 5} everywhere") for i in range(50)], "c int, text string")
    packed = documents._packed_lists(documents._token_lists(c, "c", "text", 2))
    at = packed["vocabulary"].to_pylist().index("everywhere")
    assert packed["starts"][at] == packed["starts"][at + 1] and len(packed["listed"]) == 100
    assert packed["names"] == 1 and (packed["commons"] == packed["common_of"][at]).all()
    q = spark.createDataFrame([(i, f"name{i} everywhere other{i}") for i in range(60)] + [(99, "everywhere")], "q int, text string")
    got = documents.lexical_pairs(q, c, question_id="q", candidate_id="c").collect()
    assert {tuple(r) for r in got} == {(i, i, 2) for i in range(50)}


def test_words_of_the_document_are_those_of_its_sentences(spark, catalogue, plan, monkeypatch):
    """Words are counted per fact, not again in each long document; odd spaces and letters included."""
    counted = []
    count = documents.text.count_word_tokens
    monkeypatch.setattr(documents.text, "count_word_tokens", lambda c: counted.append(str(c)) or count(c))
    odd = ["a b", " ", "", "ß\x1fü", "x\u0085y", "  two  words ", "日本　語", "plain"]
    facts = spark.createDataFrame(
        [(200 + i, "job", s, odd[-i - 1]) for i, s in enumerate(odd)] + [(300, "job", None, "clerk")], catalogue[1].schema
    )
    plain = plan.where("plan_id % 3 = 0").withColumn("subject", F.concat(F.lit("a b\u0085 "), "subject"))
    out = documents.assemble_documents(plain, catalogue[0], catalogue[1].where("template_id = 'home'").unionByName(facts)).collect()
    assert len(out) == 11 and not [c for c in counted if "document" in c]
    for r in out:
        words = len(r["document"].split()) + len(r["question"].split()) + 3
        if r["evidence_distance_tokens"] is not None:
            assert r["evidence_distance_tokens"] == words - r["evidence_position_token_idx"]
    assert sum(r["evidence_distance_tokens"] is not None for r in out) >= 5
