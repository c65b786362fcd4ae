"""The pooled negative control: one fit across all bins, never mixed with per-bin fits.

Kept in a module of its own; ``composite`` does not import it, and its result table
has a ``control`` column and no bin column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.composite import fit_and_score


def fit_pooled_control(
    df: DataFrame,
    *,
    features: Sequence[str] = fixed.FEATURES,
    label: str = "is_fail",
    id_col: str = "event_id",
    l2: float = 1.0,
    holdout: float = 0.2,
    replicates: int = 1000,
) -> DataFrame:
    pooled = df.select(
        F.lit("pooled_negative_control").alias("control"), id_col, label, *features
    )
    return fit_and_score(
        pooled,
        ["control"],
        features,
        label,
        id_col=id_col,
        l2=l2,
        holdout=holdout,
        replicates=replicates,
        seed="pooled",
    )
