"""Weighted second moments and logistic Newton steps, summed over partitions.

Rows carry an array ``x``, a label ``y`` and, for bootstrap fits, the replicates
that drew the row with their counts (``reps``, ``cnts``). One pass over the rows
serves every group and every replicate; a task returns sums per (group, model),
never rows, and the sums are added by an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnstrata.operators.matrices import summed_arrays
from attnstrata.operators.positions import key_join

_CHUNK_CELLS = 4_000_000
_HELD_SUMS = 4_096


def upper(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def unpack(values: np.ndarray, d: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    m = np.zeros((d, d))
    i, j = upper(d)
    m[i, j] = values
    m[j, i] = values
    return m


def _weights(part: pd.DataFrame, n_models: int) -> np.ndarray:
    """n x n_models counts; model 0 is the fit on the rows as they are."""
    w = np.zeros((len(part), n_models))
    w[:, 0] = 1.0
    if n_models > 1:
        sizes = part["reps"].map(lambda r: 0 if r is None else len(r)).to_numpy()
        if sizes.sum():
            filled = sizes > 0
            rows = np.repeat(np.arange(len(part)), sizes)
            w[rows, np.concatenate(part["reps"].to_numpy()[filled])] = np.concatenate(
                part["cnts"].to_numpy()[filled]
            )
    return w


def _second_order(x1: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """models x upper-triangle sums of weight * x1 x1T."""
    i, j = upper(x1.shape[1])
    if weights.shape[1] == 1:
        return ((x1 * weights).T @ x1)[i, j][None, :]
    step = max(1, _CHUNK_CELLS // len(i))
    return sum(
        weights[a:a + step].T @ (x1[a:a + step, i] * x1[a:a + step, j])
        for a in range(0, len(x1), step)
    )


Kernel = Callable[[tuple, np.ndarray, np.ndarray, np.ndarray], tuple[Sequence[int], np.ndarray]]


def grouped_sums(
    rows: DataFrame, keys: Sequence[str], kernel: Kernel, n_models: int
) -> DataFrame:
    """(keys, model, sums) with sums added over all rows of the group."""
    schema = T.StructType(
        [
            *[rows.schema[k] for k in keys],
            T.StructField("model", T.IntegerType()),
            T.StructField("_part", T.ArrayType(T.DoubleType())),
        ]
    )
    names = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(
                [(*key, v) for key, v in held.items()], columns=[*names, "model", "_part"]
            )
            held.clear()
            return out

        for batch in batches:
            for key, part in batch.groupby(names, sort=False, dropna=False):
                x = np.stack(part["x"].to_numpy())
                x1 = np.column_stack([np.ones(len(x)), x])
                models, sums = kernel(
                    key, x1, part["y"].to_numpy(dtype=float), _weights(part, n_models)
                )
                for m, s in zip(models, sums):
                    at = (*key, int(m))
                    held[at] = held[at] + s if at in held else s
            if len(held) >= _HELD_SUMS:
                yield flush()
        if held:
            yield flush()

    columns = [*keys, "x", "y"] + (["reps", "cnts"] if n_models > 1 else [])
    parts = rows.select(*columns).mapInPandas(partial, schema)
    return summed_arrays(parts, [*keys, "model"], "_part", "sums")


def weighted_moments(rows: DataFrame, keys: Sequence[str], n_models: int = 1) -> DataFrame:
    """Sums per (group, model): positives, then the upper triangle of [1 x][1 x]T."""

    def kernel(_key, x1, y, w):
        return range(n_models), np.column_stack([w.T @ y, _second_order(x1, w)])

    return grouped_sums(rows, keys, kernel, n_models)


def _log1pexp(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def newton_sums(
    rows: DataFrame, keys: Sequence[str], active: dict[tuple, dict[int, np.ndarray]], n_models: int
) -> DataFrame:
    """Loss, gradient and curvature sums at the current parameters of each model."""

    def kernel(key, x1, y, w):
        models = sorted(active.get(key, {}))
        if not models:
            return [], []
        theta = np.column_stack([active[key][m] for m in models])
        w = w[:, models]
        z = x1 @ theta
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        loss = (w * (_log1pexp(z) - y[:, None] * z)).sum(axis=0)
        gradient = (w * (p - y[:, None])).T @ x1
        return models, np.column_stack([loss, gradient, _second_order(x1, w * p * (1 - p))])

    return grouped_sums(rows, keys, kernel, n_models)


def _solve_schema(rows: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            *[rows.schema[k] for k in keys],
            T.StructField("model", T.IntegerType()),
            T.StructField("objective", T.DoubleType()),
            T.StructField("step", T.ArrayType(T.DoubleType())),
        ]
    )


def fit_logistic(
    rows: DataFrame,
    keys: Sequence[str],
    n_features: int,
    start: Sequence[tuple],
    *,
    l2: float = 1.0,
    n_models: int = 1,
    bases: DataFrame | None = None,
    tol: float = 1e-10,
    max_iter: int = 60,
) -> tuple[dict[tuple, dict[int, np.ndarray]], set[tuple]]:
    """Ridge logistic regression of every group (and replicate) at once.

    Newton iterations: each is one pass over ``rows`` and one small solve per model
    on the executors; only the parameters (models x features, whatever the number of
    rows) travel through the driver. The intercept is not penalized.

    ``start`` lists the (key..., model) pairs to fit. ``bases`` (keys, model, mean,
    components) restricts a model to the span of its components around its mean, the
    penalty then applying to the coefficients on the components. Returns, per group
    and model, the intercept followed by the coefficients in the space of ``x``; and the
    (key..., model) pairs that ``max_iter`` passes did not bring to convergence.
    """
    names = list(keys)
    d1 = n_features + 1
    theta = {tuple(s): np.zeros(d1) for s in start}
    best: dict[tuple, tuple[float, np.ndarray]] = {}
    open_models = set(theta)
    schema = _solve_schema(rows, keys)
    restricted = bases is not None

    for _ in range(max_iter):
        if not open_models:
            break
        active: dict[tuple, dict[int, np.ndarray]] = {}
        for s in open_models:
            active.setdefault(s[:-1], {})[s[-1]] = theta[s]

        def solve(batches, active=active):
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    row = row._asdict() if hasattr(row, "_asdict") else dict(row)
                    key = tuple(row[k] for k in names)
                    m = int(row["model"])
                    current = active[key][m]
                    sums = np.asarray(row["sums"])
                    if restricted:
                        v = np.stack(row["components"])
                        a = np.zeros((len(v) + 1, d1))
                        a[0, 0] = 1.0
                        a[1:, 0] = -v @ np.asarray(row["mean"])
                        a[1:, 1:] = v
                        coef = v @ current[1:]
                    else:
                        a, coef = np.eye(d1), current[1:]
                    penalty = np.full(len(a), l2)
                    penalty[0] = 0.0
                    gradient = a @ sums[1:1 + d1]
                    gradient[1:] += l2 * coef
                    curvature = a @ unpack(sums[1 + d1:], d1) @ a.T + np.diag(penalty)
                    step = np.linalg.lstsq(curvature, -gradient, rcond=None)[0] @ a
                    out.append((*key, m, sums[0] + 0.5 * l2 * float(coef @ coef), step))
                yield pd.DataFrame(out, columns=[*names, "model", "objective", "step"])

        sums = newton_sums(rows, keys, active, n_models)
        if restricted:
            sums = key_join(sums, bases, [*keys, "model"])
        for row in sums.mapInPandas(solve, schema).collect():
            s = (*[row[k] for k in names], row["model"])
            step, value = np.asarray(row["step"]), row["objective"]
            if s in best and value > best[s][0] + 1e-9 * (1 + abs(best[s][0])):
                theta[s] = (theta[s] + best[s][1]) / 2
                continue
            best[s] = (value, theta[s])
            theta[s] = theta[s] + step
            if np.abs(step).max() < tol:
                open_models.discard(s)

    fitted: dict[tuple, dict[int, np.ndarray]] = {}
    for s, values in theta.items():
        fitted.setdefault(s[:-1], {})[s[-1]] = values
    return fitted, open_models
