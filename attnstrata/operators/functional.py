"""Functional PCA, functional logistic regression and long-line change points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnstrata.functions import bins as binning
from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.moments import fit_logistic, unpack, weighted_moments
from attnstrata.operators.positions import key_join
from attnstrata.operators.series import cusum, first_alarm, long_line_series
from attnstrata.operators.statistics import bootstrap_weights, islands, pointwise_band
from attnstrata.session import materialize

_FLAT = 1e-13


def cumulative_variance(
    shares: DataFrame, keys: Sequence[str], *, threshold: float = 0.95, max_fpcs: int = 32
) -> DataFrame:
    """Smallest number of components reaching the threshold, capped.

    ``shares`` has (keys, component, share), one row per component.
    """
    running = Window.partitionBy(*keys).orderBy("component").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        shares.withColumn("_cum", F.sum("share").over(running))
        .groupBy(*keys)
        .agg(
            F.least(
                F.count_if(F.col("_cum") < threshold) + 1, F.lit(max_fpcs), F.count(F.lit(1))
            ).alias("n_fpcs")
        )
    )


def _decompose_moments(
    moments: DataFrame, keys: Sequence[str], *, threshold: float, max_fpcs: int
) -> DataFrame:
    """FPCA of every (group, model) from its moment sums."""
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [
            *[moments.schema[k] for k in keys],
            T.StructField("model", T.IntegerType()),
            T.StructField("n_curves", T.LongType()),
            T.StructField("n_positive", T.LongType()),
            T.StructField("n_fpcs", T.IntegerType()),
            T.StructField("mean", doubles),
            T.StructField("components", T.ArrayType(doubles)),
            T.StructField("shares", doubles),
        ]
    )
    names = list(keys)

    def eigen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False):
                *key, model, sums = values
                sums = np.asarray(sums)
                d1 = int((np.sqrt(8 * (len(sums) - 1) + 1) - 1) / 2)
                m = unpack(sums[1:], d1)
                n = m[0, 0]
                mean = m[0, 1:] / n
                scatter = m[1:, 1:] - n * np.outer(mean, mean)
                value, vector = np.linalg.eigh(scatter)
                value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1].T
                total, scale = value.sum(), np.trace(m[1:, 1:])
                if total <= _FLAT * scale or total <= 0:
                    kept, shares = 0, np.empty(0)
                else:
                    shares = value / total
                    need = int((np.cumsum(shares) < threshold).sum()) + 1
                    kept = min(need, max_fpcs, int(min(n, d1 - 1)))
                parts = vector[:kept]
                top = np.abs(parts).argmax(axis=1) if kept else np.empty(0, int)
                sign = np.sign(parts[np.arange(kept), top]) if kept else np.empty(0)
                out.append(
                    (
                        *key,
                        int(model),
                        int(round(n)),
                        int(round(sums[0])),
                        kept,
                        mean,
                        list(parts * sign[:, None]),
                        shares[:kept],
                    )
                )
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return moments.select(*names, "model", "sums").mapInPandas(eigen, schema)


def fit_fpca(
    df: DataFrame,
    keys: Sequence[str],
    curve: str = "curve",
    *,
    threshold: float = 0.95,
    max_fpcs: int = 32,
) -> DataFrame:
    """Per group: mean curve, components (largest entry positive), variance shares.

    Flat groups keep 0 components. Scores are separate, see ``fpca_scores``.
    """
    rows = df.select(*keys, F.col(curve).cast("array<double>").alias("x"), F.lit(0).alias("y"))
    fitted = _decompose_moments(
        weighted_moments(rows, keys), keys, threshold=threshold, max_fpcs=max_fpcs
    )
    return fitted.drop("model", "n_positive")


def fpca_scores(
    df: DataFrame, fit: DataFrame, keys: Sequence[str], curve: str = "curve"
) -> DataFrame:
    """``scores``: each curve's coefficient on every component of its group."""
    centred = F.zip_with(F.col(curve).cast("array<double>"), F.col("mean"), lambda a, b: a - b)
    scores = F.transform(
        "components",
        lambda c: F.aggregate(
            F.zip_with(c, "_centred", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
        ),
    )
    return (
        key_join(df, fit.select(*keys, "mean", "components"), keys)
        .withColumn("_centred", centred)
        .withColumn("scores", scores)
        .drop("_centred", "mean", "components")
    )


def fit_functional_logistic(
    df: DataFrame,
    keys: Sequence[str] = ("bin_id", "edge_type"),
    *,
    curve: str = "curve",
    label: str = "is_fail",
    id_col: str = "event_id",
    bins: Sequence[str] | None = fixed.BIN_IDS,
    threshold: float = 0.95,
    max_fpcs: int = 32,
    replicates: int = 1000,
    l2: float = 1.0,
    salts: int | None = None,
    min_rows: int = fixed.MIN_ROWS_PER_FIT,
) -> tuple[DataFrame, DataFrame]:
    """(fits, beta): per group the number of components, their shares, the coefficient
    curve, its pointwise 95 % band and the layer intervals whose band excludes 0;
    ``beta`` has the same curve and band one row per layer. Every group stays in ``fits``:
    ``status`` tells those that could not be fitted (too_few_rows, no_variance,
    single_class) or did not converge.

    Each replicate refits components and regression on its own n-of-n draw. A
    replicate draws by weights on the rows: no sample is copied out, and all groups
    and replicates share each pass over the rows.
    """
    spark = df.sparkSession
    if bins is not None:
        df = binning.require_bins(df, keys[0], bins)
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "groups")
    enough = counts.filter(F.col("_rows") >= min_rows).drop("_rows")
    df = key_join(df, enough, keys, "left_semi")
    indexed, draws = bootstrap_weights(
        df.select(
            *keys,
            F.col(id_col).alias("_id"),
            F.col(curve).cast("array<double>").alias("x"),
            F.col(label).cast("int").alias("y"),
        ),
        keys,
        id_col="_id",
        replicates=replicates,
        seed="functional",
    )
    pair = F.struct((F.col("replicate") + 1).cast("int").alias("m"), "weight")
    drawn = draws.groupBy(*keys, "_i").agg(F.collect_list(pair).alias("_d")).select(
        *keys,
        "_i",
        F.transform("_d", lambda p: p["m"]).alias("reps"),
        F.transform("_d", lambda p: p["weight"].cast("int")).alias("cnts"),
    )
    rows = materialize(
        key_join(indexed, drawn, [*keys, "_i"], "left")
        .select(*keys, "_i", "x", "y", "reps", "cnts")
        .repartition(*keys, F.pmod(F.xxhash64("_i"), F.lit(salts))),
        "replicates",
    )
    n_models = replicates + 1
    bases = materialize(
        _decompose_moments(
            weighted_moments(rows, keys, n_models), keys, threshold=threshold, max_fpcs=max_fpcs
        ),
        "bases",
    )
    usable = bases.filter(
        (F.col("n_fpcs") > 0)
        & (F.col("n_positive") > 0)
        & (F.col("n_positive") < F.col("n_curves"))
    )
    names = list(keys)
    start = [
        (*[r[k] for k in names], r["model"]) for r in usable.select(*keys, "model").collect()
    ]
    grid = rows.select(F.size("x")).first()
    n_grid = grid[0] if grid else 0
    fitted, still_open = fit_logistic(
        rows,
        keys,
        n_grid,
        start,
        l2=l2,
        n_models=n_models,
        bases=usable.select(*keys, "model", "mean", "components"),
    )
    groups = {g for g in fitted if 0 in fitted[g]}
    curves = spark.createDataFrame(
        [
            (*g, m, [float(v) for v in fitted[g].get(m, fitted[g][0])[1:]])
            for g in groups
            for m in range(n_models)
        ],
        T.StructType(
            [
                *[df.schema[k] for k in keys],
                T.StructField("model", T.IntegerType()),
                T.StructField("beta", T.ArrayType(T.DoubleType())),
            ]
        ),
    )
    long = curves.select(*keys, "model", F.posexplode("beta").alias("layer", "beta"))
    point = long.filter(F.col("model") == 0).drop("model")
    band = pointwise_band(
        long.filter(F.col("model") > 0), [*keys, "layer"], "beta", "beta_"
    )
    beta = key_join(point, band, [*keys, "layer"])
    runs = islands(
        beta, keys, "layer", (F.col("beta_ci_lower") > 0) | (F.col("beta_ci_upper") < 0)
    ).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("discriminative_depth_intervals")
    )
    per_layer = F.array_sort(
        F.collect_list(F.struct("layer", "beta", "beta_ci_lower", "beta_ci_upper"))
    )
    whole = beta.groupBy(*keys).agg(per_layer.alias("_b")).select(
        *keys,
        F.transform("_b", lambda b: b["beta"]).alias("beta_function"),
        F.transform("_b", lambda b: b["beta_ci_lower"]).alias("beta_ci_lower"),
        F.transform("_b", lambda b: b["beta_ci_upper"]).alias("beta_ci_upper"),
    )
    shares = bases.filter(F.col("model") == 0).select(
        *keys, "n_fpcs", F.col("shares").alias("fpc_variance_explained"), "n_positive", "n_curves"
    )
    open_groups = spark.createDataFrame(
        [(*s[:-1], True) for s in still_open if s[-1] == 0],
        T.StructType([*[df.schema[k] for k in keys], T.StructField("_open", T.BooleanType())]),
    )
    status = (
        F.when(F.col("n_fpcs").isNull(), "too_few_rows")
        .when(F.col("n_fpcs") == 0, "no_variance")
        .when(F.col("n_positive").isin(0) | (F.col("n_positive") == F.col("n_curves")), "single_class")
        .when(F.col("_open"), "not_converged")
        .otherwise("fitted")
    )
    fits = key_join(key_join(counts, shares, keys, "left"), whole, keys, "left")
    fits = key_join(key_join(fits, runs, keys, "left"), open_groups, keys, "left")
    fits = fits.withColumn("status", status).withColumn(
        "discriminative_depth_intervals",
        F.coalesce(
            "discriminative_depth_intervals", F.array().cast("array<struct<lo:int,hi:int>>")
        ),
    ).drop("_rows", "_open", "n_positive", "n_curves")
    return fits, beta


def long_lines(
    atomic: DataFrame,
    feature: str = "grassmannian_qkt",
    *,
    keys: Sequence[str] = ("layer", "head"),
    threshold: float = 5.0,
) -> DataFrame:
    """Per (layer, head): FPCA of the over-token series of all events, then the first
    CUSUM alarm on the leading component; -1 without alarm. Groups with one series or
    without variation are left out.
    """
    series = long_line_series(atomic, feature, ["event_id", *keys])
    fit = fit_fpca(series, keys, "curve", threshold=0.95, max_fpcs=5).filter(
        (F.col("n_curves") >= 2) & (F.col("n_fpcs") > 0)
    )
    leading = fit.select(
        *keys, F.posexplode(F.get("components", F.lit(0))).alias("position", "loading")
    )
    return first_alarm(cusum(leading, keys, ["position"], "loading", threshold=threshold), keys)
