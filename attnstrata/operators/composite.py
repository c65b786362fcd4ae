"""Per-bin composite fits: all bins are fitted in one job, each on its own rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnstrata.functions import bins as binning
from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.moments import fit_logistic
from attnstrata.operators.positions import key_join
from attnstrata.operators.statistics import (
    auroc,
    bootstrap_auroc_ci,
    impute_median,
    rows_per_group_at_least,
    stratified_split,
)
from attnstrata.session import materialize


def fit_and_score(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    label: str,
    *,
    id_col: str,
    l2: float,
    holdout: float,
    replicates: int,
    seed: str,
) -> DataFrame:
    """Impute, split, fit, and score the held-out rows of every group.

    The feature matrix, the split rows and the held-out scores are written to the shared
    scratch folder: every Newton pass and every replicate reads them, and a lost executor
    costs a re-read instead of the whole lineage. A group whose training rows have one class
    is not fitted: it stays, with ``status`` single_class and no coefficients.
    """
    spark = df.sparkSession
    matrix = materialize(df.select(*keys, id_col, label, *features), "features")
    prepared = impute_median(matrix, keys, features)
    split = stratified_split(
        prepared, keys, label, id_col=id_col, fraction=holdout, seed=seed
    ).select(
        *keys,
        id_col,
        F.col(label).cast("int").alias("y"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        "held_out",
    )
    split = materialize(split, "split")
    sizes = split.groupBy(*keys).agg(
        F.count_if(~F.col("held_out")).alias("n_events_train"),
        F.count_if(~F.col("held_out") & (F.col("y") == 1)).alias("_positive"),
        F.count_if("held_out").alias("n_events_held_out"),
    )
    groups = [
        tuple(r[k] for k in keys) for r in sizes.collect() if 0 < r["_positive"] < r["n_events_train"]
    ]
    train = split.filter(~F.col("held_out"))
    fitted, still_open = fit_logistic(train, keys, len(features), [(*g, 0) for g in groups], l2=l2)
    schema = T.StructType(
        [
            *[split.schema[k] for k in keys],
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("_converged", T.BooleanType()),
        ]
    )
    models = spark.createDataFrame(
        [
            (*g, float(m[0][0]), [float(v) for v in m[0][1:]], (*g, 0) not in still_open)
            for g, m in fitted.items()
        ],
        schema,
    )
    linear = F.col("intercept") + F.aggregate(
        F.zip_with("coefficients", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    scored = key_join(split.filter("held_out"), models, keys).select(
        *keys, id_col, "y", (1 / (1 + F.exp(-linear))).alias("score")
    )
    scored = materialize(scored, "scored")
    out = key_join(sizes, models, keys, "left").withColumn(
        "status",
        F.when(F.col("_converged").isNull(), "single_class")
        .when(F.col("_converged"), "fitted")
        .otherwise("not_converged"),
    )
    out = key_join(
        out, auroc(scored, keys, "y", "score").select(*keys, "auroc"), keys, "left"
    )
    interval = bootstrap_auroc_ci(
        scored, keys, "y", "score", id_col=id_col, replicates=replicates, seed=seed
    ).drop("n_replicates")
    return key_join(out, interval, keys, "left").select(
        *keys,
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        "coefficients",
        "intercept",
        "auroc",
        "auroc_ci_lower",
        "auroc_ci_upper",
        "n_events_train",
        "n_events_held_out",
        "status",
    )


def fit_composite(
    df: DataFrame,
    *,
    features: Sequence[str] = fixed.FEATURES,
    label: str = "is_fail",
    id_col: str = "event_id",
    bin_col: str = "bin_id",
    bins: Sequence[str] | None = fixed.BIN_IDS,
    per: Sequence[str] = (),
    l2: float = 1.0,
    holdout: float = 0.2,
    replicates: int = 1000,
    min_rows: int = fixed.MIN_ROWS_PER_FIT,
) -> DataFrame:
    """One L2 logistic fit per bin, and per value of further columns, with its held-out AUROC and 95 % interval.

    Rows must carry a single known bin each (``bins=None`` accepts any non-null name);
    bins with fewer than ``min_rows`` rows are left out.
    """
    checked = df if bins is None else binning.require_bins(df, bin_col, bins)
    enough = rows_per_group_at_least(checked, [*per, bin_col], min_rows)
    return fit_and_score(
        enough,
        [*per, bin_col],
        features,
        label,
        id_col=id_col,
        l2=l2,
        holdout=holdout,
        replicates=replicates,
        seed="composite",
    )


def auroc_report(fits: DataFrame, bin_col: str = "bin_id") -> DataFrame:
    return fits.select(
        bin_col,
        "auroc",
        "auroc_ci_lower",
        "auroc_ci_upper",
        "n_events_train",
        "n_events_held_out",
    )
