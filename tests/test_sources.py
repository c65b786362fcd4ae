"""Round trips, tampering, provenance; and the flows end to end."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnstrata.functions import bins, ids
from attnstrata.functions import fixed_values as fixed
from attnstrata.operators import documents
from attnstrata.plans import study
from attnstrata.sources import catalogue, dataset, reports, tensors
from attnstrata.session import broadcast_if_small, fits_broadcast, scratch_path


def event_rows(spark, n=3):
    base = spark.range(n).select(
        F.concat(F.lit("doc"), "id").alias("document"), F.lit("q?").alias("question"),
        F.concat(F.lit("g"), "id").alias("gold_answer"), F.lit("t").alias("question_template_id"),
        F.lit(5).alias("evidence_position_token_idx"), F.lit(200).alias("evidence_distance_tokens"),
        F.lit("B1").alias("bin_id"), F.lit(0.5).alias("distractor_density"),
        F.lit("med").alias("distractor_density_coarsening"), F.lit(1).alias("gold_answer_length_tokens"),
        F.lit("1").alias("gold_answer_length_coarsening"), F.lit("t|med|1").alias("cem_stratum_id"),
        F.lit("none").alias("adversariality_policy"), F.lit("x").alias("model_generation"),
        F.lit("x").alias("model_generation_normalized"), F.lit("g").alias("gold_answer_normalized"),
        F.lit(True).alias("is_fail"),
    )
    e = ids.with_event_id(base).withColumn("per_event_seed", ids.derive_seed("event", F.col("event_id")))
    return e.select(*[F.col(c).cast(t).alias(c) for c, t in fixed.EVENT_COLUMNS])


def header_row(spark):
    schema = ", ".join(f"{c} {t}" for c, t in fixed.HEADER_COLUMNS)
    values = {"string": "v", "int": 8, "bigint": 5_000_000_000, "array<string>": ["a", "b"],
              "map<string,string>": {"B1": "none"}, "map<string,bigint>": {"B1": 7}}
    return spark.createDataFrame([tuple(values[t] for _, t in fixed.HEADER_COLUMNS)], schema)


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_dataset_round_trip(spark, fmt):
    e, path = event_rows(spark), scratch_path(spark, "d")
    dataset.write_dataset(e, header_row(spark), path, fmt)
    header, back = dataset.read_dataset(spark, path, fmt)
    assert back.exceptAll(e).count() == 0 and back.count() == 3
    h = header.first()
    assert h["split_seed"] == 5_000_000_000 and h["feature_layout"] == ["a", "b"] and len(h["events_sha256"]) == 64
    index = dataset.read_event_index(spark, f"{path}/index", fmt)
    assert "document" not in index.columns and index.columns == sorted(index.columns)


@pytest.mark.parametrize("part", ["text", "index"])
def test_tampering_names_the_table(spark, part):
    path = scratch_path(spark, "d")
    dataset.write_dataset(event_rows(spark), header_row(spark), path)
    read = dataset.read_event_text if part == "text" else dataset.read_event_index
    field = "question" if part == "text" else "bin_id"
    changed = read(spark, f"{path}/{part}").withColumn(field, F.lit("B2")).collect()
    schema = read(spark, f"{path}/{part}").schema
    spark.createDataFrame(changed, schema).write.mode("overwrite").parquet(f"{path}/{part}")
    with pytest.raises(dataset.DatasetIntegrityError, match=f"{part} table"):
        dataset.read_dataset(spark, path)


def test_header_without_a_field(spark):
    path = scratch_path(spark, "h")
    dataset.write_header(header_row(spark).drop("k_attn"), path)
    with pytest.raises(dataset.DatasetSchemaError, match="k_attn"):
        dataset.read_header(spark, path)


def test_index_keeps_events_without_text(spark):
    e = event_rows(spark)
    text = dataset.event_text(e).limit(0)
    out = dataset.join_event_text(dataset.event_index(e), text).collect()
    assert len(out) == 3 and all(r["document"] == "" and r["model_generation"] == "" for r in out)


def test_catalogue_keeps_repeated_facts(spark):
    t = spark.createDataFrame([("a", "q", "s")], catalogue.TEMPLATES_SCHEMA)
    f = spark.createDataFrame([(0, "a", "x", "y"), (1, "a", "x", "y")], catalogue.FACTS_SCHEMA)
    paths = scratch_path(spark, "t"), scratch_path(spark, "f")
    catalogue.write_catalogue(t, f, *paths)
    assert catalogue.read_catalogue(spark, *paths)[1].count() == 2


def atomic(spark, n=2):
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"))
    df = df.withColumn("rel_pos", F.explode(F.sequence(F.lit(-3), F.lit(0))))
    df = df.withColumn("layer", F.lit(0)).withColumn("head", F.lit(1))
    return df.withColumns({f: F.lit(1 / 3) for f in fixed.FEATURES})


def test_tensor_round_trip_and_pruning(spark):
    path = scratch_path(spark, "a")
    tensors.write_atomic(atomic(spark), path)
    back = tensors.read_atomic(spark, path)
    assert back.count() == 8 and back.schema["stable_rank_qkt"].dataType.simpleString() == "float"
    assert back.first()["stable_rank_qkt"] == np.float32(1 / 3)
    one = back.first()["event_id"]
    only = tensors.read_atomic(spark, path, [one])
    assert only.count() == 4
    assert "PartitionFilters: [id_prefix" in only._jdf.queryExecution().toString().replace("isnotnull(id_prefix", "id_prefix")
    with pytest.raises(TypeError, match="double"):
        tensors.write_atomic(back, scratch_path(spark, "b"))
    edges = spark.createDataFrame(
        [("ab", 0, 0, "qkt_grassmannian", i, j, 0.5) for i in range(3) for j in range(3)],
        "event_id string, lookback_j int, layer int, edge_type string, h_i int, h_j int, dist double",
    )
    tensors.write_head_edges(edges, path + "-e")
    assert tensors.read_head_edges(spark, path + "-e").count() == 3


def test_provenance(spark):
    df = atomic(spark)
    header = tensors.provenance(
        spark, "atomic", manifest_sha256="m", code_commit_sha="c", tensor_shape=(4, 1, 1, 7), k_attn=16
    )
    ok = dict(table_name="atomic", expected_digest="m")
    assert tensors.check_provenance(df, header, rows_expected=4, k_attn=16, **ok).count() == 8
    with pytest.raises(tensors.StaleTensorError):
        tensors.check_provenance(df, header, table_name="atomic", expected_digest="other")
    with pytest.raises(tensors.ConfigDriftError, match="k_attn"):
        tensors.check_provenance(df, header, k_attn=8, **ok)
    with pytest.raises(tensors.TensorSchemaError, match="5 rows"):
        tensors.check_provenance(df, header, rows_expected=5, **ok)
    with pytest.raises(tensors.TensorSchemaError, match="one header row"):
        tensors.check_provenance(df, header, table_name="other", expected_digest="m")
    assert tensors.with_provenance(df, header, "atomic").first()["manifest_sha256"] == "m"


def test_handcheck_file_has_an_empty_judgment(spark):
    path = scratch_path(spark, "hc")
    reports.write_handcheck_sample(event_rows(spark), path)
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    lines = [json.loads(x) for f in files for x in open(os.path.join(path, f))]
    assert len(lines) == 3 and all(x["human_judgment"] is None for x in lines)


def test_broadcast_is_checked(spark):
    df = spark.range(100)
    assert fits_broadcast(df, 100) and not fits_broadcast(df, 99)
    assert "ResolvedHint" not in broadcast_if_small(df, 99)._jdf.queryExecution().toString()


def small_study(spark):
    """Two bins of events whose captured vectors depend weakly on the label."""
    rng = np.random.default_rng(12)
    events, qkv, attn = [], [], []
    for i in range(80):
        b, y = f"B{1 + i % 2}", bool(rng.integers(0, 2))
        events.append((f"e{i:03d}", b, "t|med|1", y))
        for layer in range(2):
            for head in range(3):
                for t in range(5):
                    shift = 0.7 * y
                    q, k, v = (rng.normal(size=4) + shift * np.r_[1, 0, 0, 0] for _ in range(3))
                    qkv.append((f"e{i:03d}", layer, head, t, q.tolist(), k.tolist(), v.tolist()))
                w = rng.random((5, 5))
                attn += [(f"e{i:03d}", layer, head, a, c, float(w[a, c])) for a in range(5) for c in range(5)]
    head = "event_id string, layer int, head int"
    return (
        spark.createDataFrame(events, "event_id string, bin_id string, cem_stratum_id string, is_fail boolean").withColumns(
            {"question": F.lit("q"), "gold_answer": F.lit("g"), "model_generation": F.lit("m"),
             "document": F.lit("d")}
        ),
        spark.createDataFrame(qkv, head + ", token int, q array<double>, k array<double>, v array<double>"),
        spark.createDataFrame(attn, head + ", src int, dst int, w double"),
    )


def test_pilot_study_and_analysis_end_to_end(spark):
    events, qkv, attn = small_study(spark)
    atomic_df, edges, summary = study.derive_tensors(qkv, attn, k_grass=2, k_attn=2, compute_ricci=True)
    from attnstrata.session import materialize

    edges, summary = materialize(edges, "edges"), materialize(summary, "summary")
    assert atomic_df.count() == 80 * 2 * 3 and edges.count() == 80 * 2 * 3 * 2
    pilot = study.run_pilot(events, summary, target=12, replicates=10, min_rows=20)
    counts = {(r["bin_id"], r["is_fail"]): r["count"] for r in pilot["matched"].groupBy("bin_id", "is_fail").count().collect()}
    assert set(counts.values()) == {12} and len(counts) == 4
    assert pilot["fits"].count() == 2 and pilot["handcheck"].count() == 48
    assert {r["bin_id"] for r in pilot["yield"].collect()} == {"B1", "B2"}
    full = study.run_full_study(events, summary, target=8, replicates=10, min_rows=16)
    assert full["tiers"].count() == 2
    auroc = reports.auroc_report(pilot["fits"])
    curves = edges.join(events.select("event_id"), "event_id")
    out = study.run_analysis(
        events, curves, summary, auroc, n_heads=3, replicates=10, min_rows=20
    )
    assert {(r["bin_id"], r["edge_type"]) for r in out["functional"].collect()} == {
        (b, t) for b in ("B1", "B2") for t in fixed.EDGE_TYPES
    }
    assert out["beta"].count() == 2 * 2 * 2 and out["head_graph_comparison"].count() == 6
    for name in ("auroc_verdict", "pooled_verdict", "depth_verdict"):
        assert out[name].count() == 1


def test_build_events_and_regenerate(spark):
    templates = spark.createDataFrame(
        [("home", "Where does {subject} live?", "{subject} lives in {object}."), ("job", "What does {subject} do?", "{subject} is a {object}.")],
        catalogue.TEMPLATES_SCHEMA,
    )
    facts = spark.createDataFrame(
        [(i, "home" if i % 2 else "job", f"s{i}", f"o{i % 9}") for i in range(200)], catalogue.FACTS_SCHEMA
    )
    plan = spark.range(40).select(
        F.col("id").alias("plan_id"), F.lit("home").alias("template_id"), F.concat(F.lit("s"), F.col("id") * 2 + 1).alias("subject"),
        F.concat(F.lit("o"), (F.col("id") * 2 + 1) % 9).alias("object"), (F.col("id") * 8).cast("int").alias("target_words"),
        F.lit(0.9).alias("distractor_density"),
    )
    inside, outside = study.build_events(plan, templates, facts, policies={"B1": "sibling_entity"})
    assert inside.count() + outside.count() == 40 and inside.count() > 0 < outside.count()
    assert {r["bin_id"] for r in outside.collect()} == {None}
    b1 = inside.filter("bin_id = 'B1'").collect()
    assert all(r["adversariality_policy"] == "sibling_entity" and r["n_injected"] == 3 for r in b1)
    original = documents.assemble_documents(plan, templates, facts)
    check = study.regenerate(original, plan, templates, facts).first()
    assert check["agreement_pct"] == 100.0 and check["passes"]
    assert bins.bin_table(spark).count() == 6
