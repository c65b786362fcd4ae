"""The study's flows: each is one lineage over all bins, from tables to tables.

Model inference is not part of them: generations and captured vectors are inputs.
Wide intermediate results (head operators, matched events) are written once to the
shared scratch folder where several later steps read them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.functions import ids
from attnstrata.operators import compare, documents, graph, matching, matrices, spine, statistics
from attnstrata.operators.composite import fit_composite
from attnstrata.operators.functional import fit_functional_logistic
from attnstrata.operators.pooled_control import fit_pooled_control
from attnstrata.session import materialize
from attnstrata.sources import reports

HEAD_KEYS = ("event_id", "layer", "head")


def build_events(
    plan: DataFrame,
    templates: DataFrame,
    facts: DataFrame,
    *,
    policies: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): assembled documents, with distractors injected in the bins
    that ask for a policy. Events outside every bin are quarantined, not dropped.
    """
    events = documents.assemble_documents(plan, templates, facts)
    if policies:
        asked = F.coalesce(
            *[F.when(F.col("bin_id") == b, F.lit(p)) for b, p in policies.items()], F.lit("none")
        )
        events = documents.inject_distractors(
            events.withColumn("adversariality_policy", asked), templates, facts
        ).withColumn("per_event_seed", ids.derive_seed("event", F.col("event_id")))
    return (
        events.filter(F.col("bin_id").isNotNull()),
        events.filter(F.col("bin_id").isNull()),
    )


def head_operators(qkv: DataFrame, attn: DataFrame) -> DataFrame:
    """Both d x d operators of every (event, layer, head), as one matrix table.

    ``qkv`` has the head keys, ``token`` and the vectors q, k, v; ``attn`` the head keys
    and (src, dst, w).
    """
    qkt = matrices.gram(qkv, HEAD_KEYS, "q", "k")
    context = matrices.weighted_context(attn, qkv, HEAD_KEYS)
    avwo = matrices.gram(context, HEAD_KEYS, "context")
    return qkt.withColumn("kind", F.lit("qkt")).unionByName(
        avwo.withColumn("kind", F.lit("avwo"))
    )


def derive_tensors(
    qkv: DataFrame,
    attn: DataFrame,
    *,
    k_grass: int = 8,
    k_attn: int = 16,
    compute_ricci: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atomic, head edges, summary). One row per head stands for all its lookback
    positions, which share the pass-level operators; ``broadcast_positions`` expands it. Such
    a row is that of position 0, so stored tables read back as they are here.
    """
    operators = materialize(head_operators(qkv, attn), "operators")
    curvature = (
        graph.attention_graph_curvature(attn, HEAD_KEYS, k_attn) if compute_ricci else None
    )
    atomic = matrices.atomic_features(operators, HEAD_KEYS, k=k_grass, curvature=curvature)
    edges = matrices.grassmann_pairs(operators, ["event_id", "layer", "kind"], k=k_grass)
    edges = edges.withColumn("edge_type", F.concat("kind", F.lit("_grassmannian"))).drop("kind")
    edges = edges.withColumn("lookback_j", F.lit(0))
    atomic = atomic.withColumn("rel_pos", F.lit(0))
    summary = statistics.summarize(atomic, HEAD_KEYS, fixed.FEATURES)
    return atomic, edges, summary


def run_pilot(
    events: DataFrame, summary: DataFrame, *, target: int, replicates: int = 1000,
    min_rows: int = fixed.MIN_ROWS_PER_FIT,
) -> dict[str, DataFrame]:
    """Match, fit per bin and report. ``events`` are graded and inside the bins."""
    matched, strata = matching.cem_match(events, target)
    matched = materialize(matched, "matched")
    fits = fit_composite(
        spine.event_feature_matrix(matched, summary), replicates=replicates, min_rows=min_rows
    )
    return {
        "matched": matched,
        "strata": strata,
        "yield": matching.match_yield(strata),
        "fits": fits,
        "handcheck": reports.handcheck_table(matched),
    }


def run_full_study(
    pool: DataFrame,
    summary: DataFrame,
    *,
    target: int,
    template_sha: str = ids.PROMPT_TEMPLATE_SHA256,
    replicates: int = 1000,
    min_rows: int = fixed.MIN_ROWS_PER_FIT,
) -> dict[str, DataFrame]:
    """Tiered matching over the labelled pool, per-bin fits, and the id check."""
    matched, strata, report = matching.cem_match_tiered(pool, target)
    matched = materialize(matched, "matched")
    return {
        "matched": matched,
        "strata": strata,
        "tiers": report,
        "yield": matching.match_yield(strata),
        "fits": fit_composite(
            spine.event_feature_matrix(matched, summary), replicates=replicates, min_rows=min_rows
        ),
        "bad_ids": ids.bad_id_count(matched, template_sha),
    }


def run_analysis(
    events: DataFrame,
    edges: DataFrame,
    summary: DataFrame,
    auroc: DataFrame,
    *,
    n_heads: int,
    replicates: int = 1000,
    min_rows: int = fixed.MIN_ROWS_PER_FIT,
    bins: Sequence[str] = fixed.BIN_IDS,
) -> dict[str, DataFrame]:
    """Functional fits per (bin, head graph), the pooled control and all verdicts."""
    curves = spine.spine_curves_by_bin(events, edges, n_heads=n_heads)
    fits, beta = fit_functional_logistic(
        curves, ("bin_id", "edge_type"), replicates=replicates, bins=bins, min_rows=min_rows
    )
    fitted = fits.filter(F.col("status").isin("fitted", "not_converged"))
    pooled = fit_pooled_control(
        spine.event_feature_matrix(events, summary), replicates=replicates
    )
    return {
        "functional": fits,
        "beta": beta,
        "pooled": pooled,
        "auroc_verdict": compare.per_bin_verdict(auroc),
        "pooled_verdict": compare.pooled_verdict(pooled),
        "depth_verdict": compare.depth_verdict(fitted, bins),
        "head_graph_comparison": compare.head_graph_comparison(fitted, bins),
    }


def regenerate(
    original: DataFrame, plan: DataFrame, templates: DataFrame, facts: DataFrame
) -> DataFrame:
    """Rebuild the events from their plan and compare ids with the stored ones."""
    rebuilt = documents.assemble_documents(plan, templates, facts)
    return compare.reproducibility_check(original, rebuilt, label=None)
