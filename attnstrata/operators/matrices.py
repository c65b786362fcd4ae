"""Tables of small matrices: Gram products, decompositions, subspace distances.

A matrix table has its keys, ``row_idx`` and ``row`` (array<double>). Products over
tokens are summed inside each input batch with numpy and finished by aggregates over
the entries, so only d x d partial sums are shuffled, never token rows. Decompositions
see one matrix each, stacked into Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.positions import key_join

_TINY = 1e-300
_HELD_MATRICES = 256


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def summed_arrays(parts: DataFrame, keys: Sequence[str], part: str, out: str) -> DataFrame:
    """Element-wise sums of the arrays of each group, one row a group.

    Elements are added position by position, so partial sums combine before the shuffle and no
    task ever holds more than one finished array of a group, however many parts it has.
    """
    cells = (
        parts.select(*keys, F.posexplode(part).alias("_at", "_value"))
        .groupBy(*keys, "_at").agg(F.sum("_value").alias("_value"))
    )
    whole = F.array_sort(F.collect_list(F.struct("_at", "_value")))
    return cells.groupBy(*keys).agg(whole.alias("_cells")).select(
        *keys, F.transform("_cells", lambda c: c["_value"]).alias(out)
    )


def gram(df: DataFrame, keys: Sequence[str], x: str, y: str | None = None) -> DataFrame:
    """Sum over rows of the outer product x yT per key, as a matrix table."""
    y = y or x
    schema = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("row_idx", T.IntegerType()),
            T.StructField("_part", T.ArrayType(T.DoubleType())),
        ]
    )
    names = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [
                (*key, i, m[i]) for key, m in held.items() for i in range(m.shape[0])
            ]
            held.clear()
            return pd.DataFrame(rows, columns=[*names, "row_idx", "_part"])

        for batch in batches:
            for key, part in batch.groupby(names, sort=False, dropna=False):
                product = np.stack(part["_x"].to_numpy()).T @ np.stack(part["_y"].to_numpy())
                held[key] = held[key] + product if key in held else product
                if len(held) >= _HELD_MATRICES:
                    yield flush()
        if held:
            yield flush()

    parts = df.select(
        *keys,
        F.col(x).cast("array<double>").alias("_x"),
        F.col(y).cast("array<double>").alias("_y"),
    ).mapInPandas(partial, schema)
    return summed_arrays(parts, [*keys, "row_idx"], "_part", "row")


def weighted_context(
    attn: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    *,
    v: str = "v",
    block: int = 256,
) -> DataFrame:
    """The product A V: for each key and source token, the attention-weighted sum of
    the value vectors. ``attn`` has (src, dst, w), ``values`` has (token, v).

    Source tokens are cut into blocks and the value vectors are sent once to each
    block, so a task multiplies at most ``block`` rows of attention and no vector is
    repeated per attention entry.
    """
    schema = T.StructType(
        [
            *_key_fields(attn, keys),
            attn.schema["src"],
            T.StructField("context", T.ArrayType(T.DoubleType())),
        ]
    )
    names = list(keys)
    blocked = attn.select(
        *keys, F.expr(f"src div {block}").alias("_block"), "src", "dst", F.col("w").cast("double")
    )
    wanted = blocked.select(*keys, "_block").distinct()
    right_keys = [f"_r{i}" for i in range(len(names) + 1)]
    spread = key_join(
        wanted, values.select(*keys, "token", F.col(v).cast("array<double>").alias("_v")), keys
    ).select(
        *[F.col(k).alias(r) for k, r in zip([*names, "_block"], right_keys)], "token", "_v"
    )

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[left["dst"].isin(right["token"])] if len(right) else left.iloc[:0]
        if left.empty:
            return pd.DataFrame(columns=[*names, "src", "context"])
        at = pd.Index(right["token"]).get_indexer(left["dst"])
        src, row = np.unique(left["src"].to_numpy(), return_inverse=True)
        dense = np.zeros((len(src), len(right)))
        np.add.at(dense, (row, at), left["w"].to_numpy())
        out = dense @ np.stack(right["_v"].to_numpy())
        first = left.iloc[0]
        return pd.DataFrame(
            {**{k: [first[k]] * len(src) for k in names}, "src": src, "context": list(out)}
        )

    left, right = blocked.groupBy(*names, "_block"), spread.groupBy(*right_keys)
    return left.cogroup(right).applyInPandas(multiply, schema)


def edges_to_dense(edges: DataFrame, keys: Sequence[str], value: str = "dist") -> DataFrame:
    """Both triangles and the zero diagonal from rows with h_i < h_j."""
    v = F.col(value).cast("double")
    entries = F.explode(
        F.array(
            F.struct(F.col("h_i").alias("i"), F.col("h_j").alias("j"), v.alias("v")),
            F.struct(F.col("h_j").alias("i"), F.col("h_i").alias("j"), v.alias("v")),
        )
    )
    off = edges.select(*keys, entries.alias("e")).select(*keys, "e.i", "e.j", "e.v")
    diagonal = off.select(*keys, "i").distinct().select(
        *keys, "i", F.col("i").alias("j"), F.lit(0.0).alias("v")
    )
    return off.unionByName(diagonal)


def stack_rows(matrices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per matrix: its rows in order (a matrix is bounded by its size d)."""
    rows = F.array_sort(F.collect_list(F.struct("row_idx", "row")))
    return matrices.groupBy(*keys).agg(F.transform(rows, lambda r: r["row"]).alias("matrix"))


def validate_matrices(matrices: DataFrame, keys: Sequence[str], *, square: bool = False) -> DataFrame:
    """Shape report per matrix; ``is_valid`` needs rows of one length and no null."""
    out = matrices.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("row")).alias("min_cols"),
        F.max(F.size("row")).alias("n_cols"),
        F.count_if(F.exists("row", lambda v: v.isNull())).alias("n_bad_rows"),
    )
    ok = (F.col("min_cols") == F.col("n_cols")) & (F.col("n_bad_rows") == 0)
    if square:
        ok = ok & (F.col("n_rows") == F.col("n_cols"))
    return out.withColumn("is_valid", ok).drop("min_cols", "n_bad_rows")


def frobenius_sq(matrices: DataFrame, keys: Sequence[str]) -> DataFrame:
    row = F.aggregate("row", F.lit(0.0), lambda acc, v: acc + v * v)
    return matrices.groupBy(*keys).agg(F.sum(row).alias("frobenius_sq"))


def decompose(matrices: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """Per matrix: singular values, leading left basis (d rows of length k) and the
    distance of that subspace from the first k axes.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    schema = T.StructType(
        [
            *_key_fields(matrices, keys),
            T.StructField("sigma", T.ArrayType(T.DoubleType())),
            T.StructField("basis", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("axes_distance", T.DoubleType()),
        ]
    )
    names = list(keys)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stacks = [np.stack(m) for m in batch["matrix"]]
            shapes: dict[tuple, list[int]] = {}
            for at, m in enumerate(stacks):
                if k > min(m.shape):
                    raise ValueError(f"k={k} exceeds a matrix of shape {m.shape}")
                shapes.setdefault(m.shape, []).append(at)
            sigma, basis, distance = ([None] * len(stacks) for _ in range(3))
            for shape, members in shapes.items():
                u, s, _ = np.linalg.svd(
                    np.stack([stacks[i] for i in members]), full_matrices=False
                )
                u = u[:, :, :k]
                gap = u @ u.transpose(0, 2, 1) - np.diag((np.arange(shape[0]) < k) * 1.0)
                for j, i in enumerate(members):
                    sigma[i], basis[i] = s[j], list(u[j])
                    distance[i] = float(np.linalg.norm(gap[j]))
            out = batch[names].copy()
            out["sigma"], out["basis"], out["axes_distance"] = sigma, basis, distance
            yield out

    return stack_rows(matrices, keys).mapInPandas(split, schema)


def stable_rank(frob_sq: Column, sigma: Column) -> Column:
    top = F.get(sigma, F.lit(0))
    return F.when(top == 0, F.lit(0.0)).otherwise(frob_sq / (top * top))


def spectral_entropy(sigma: Column) -> Column:
    """Entropy in nats of the squared singular values taken as shares."""
    total = F.aggregate(sigma, F.lit(0.0), lambda acc, s: acc + s * s)
    entropy = F.aggregate(
        sigma,
        F.lit(0.0),
        lambda acc, s: acc
        - F.when(s * s / total > _TINY, (s * s / total) * F.ln(s * s / total)).otherwise(0.0),
    )
    return F.when(total <= _TINY, F.lit(0.0)).otherwise(entropy)


def spectral_features(matrices: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """stable_rank, grassmannian (distance to the first k axes) and spectral_entropy."""
    joined = key_join(decompose(matrices, keys, k), frobenius_sq(matrices, keys), keys)
    return joined.select(
        *keys,
        stable_rank(F.col("frobenius_sq"), F.col("sigma")).alias("stable_rank"),
        F.col("axes_distance").alias("grassmannian"),
        spectral_entropy(F.col("sigma")).alias("spectral_entropy"),
    )


def atomic_features(
    matrices: DataFrame,
    keys: Sequence[str],
    *,
    kind: str = "kind",
    k: int = 8,
    curvature: DataFrame | None = None,
) -> DataFrame:
    """The seven columns per key. ``kind`` tells ``qkt`` from ``avwo`` matrices;
    without a curvature table the last column is NaN.
    """
    spectral = spectral_features(matrices, [*keys, kind], k)
    names = ("stable_rank", "grassmannian", "spectral_entropy")
    wide = spectral.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col(kind) == which, F.col(n))).alias(f"{n}_{which}")
            for which in ("qkt", "avwo")
            for n in names
        ]
    )
    if curvature is None:
        wide = wide.withColumn(fixed.RICCI_FEATURE, F.lit(float("nan")))
    else:
        ricci = curvature.select(*keys, F.col("forman_ricci").alias(fixed.RICCI_FEATURE))
        wide = key_join(wide, ricci, keys, "left")
    return wide.select(*keys, *fixed.FEATURES)


def head_pairs(df: DataFrame, keys: Sequence[str], head: str = "head") -> DataFrame:
    """Head pairs (h_i < h_j) per key; a layer has a fixed, small number of heads."""
    heads = F.array_sort(F.collect_set(head))
    pair = F.flatten(
        F.transform(
            "_heads",
            lambda a: F.transform(
                F.filter("_heads", lambda b: b > a),
                lambda b: F.struct(a.alias("h_i"), b.alias("h_j")),
            ),
        )
    )
    return (
        df.groupBy(*keys)
        .agg(heads.alias("_heads"))
        .select(*keys, F.explode(pair).alias("p"))
        .select(*keys, "p.h_i", "p.h_j")
    )


def grassmann_pairs(
    matrices: DataFrame, keys: Sequence[str], member: str = "head", k: int = 8
) -> DataFrame:
    """Subspace distance of every head pair (h_i < h_j) per key.

    Each head is decomposed once; only its d x k basis meets the other heads.
    """
    bases = decompose(matrices, [*keys, member], k).select(*keys, member, "basis")
    heads = F.array_sort(F.collect_list(F.struct(member, "basis")))
    grouped = bases.groupBy(*keys).agg(heads.alias("_heads"))
    schema = T.StructType(
        [
            *_key_fields(matrices, keys),
            T.StructField("h_i", matrices.schema[member].dataType),
            T.StructField("h_j", matrices.schema[member].dataType),
            T.StructField("dist", T.DoubleType()),
        ]
    )
    names = list(keys)

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                *key, heads_of_row = row
                labels = np.array([h[member] for h in heads_of_row])
                u = np.stack([np.stack(h["basis"]) for h in heads_of_row])
                p = u @ u.transpose(0, 2, 1)
                i, j = np.triu_indices(len(labels), 1)
                dist = [
                    np.linalg.norm(p[a + 1:] - p[a], axis=(1, 2)) for a in range(len(labels) - 1)
                ]
                out = pd.DataFrame({n: [v] * len(i) for n, v in zip(names, key)})
                out["h_i"], out["h_j"] = labels[i], labels[j]
                out["dist"] = np.concatenate(dist) if dist else np.empty(0)
                yield out

    return grouped.mapInPandas(distances, schema)
