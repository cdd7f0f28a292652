"""k-means over points with and without their scores: the nine sets of features, their regularised twins, and the metrics of all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .clusterings import clusterings, counted
from .metrics import assignment
from .scaling import guarded_log, min_max, quantise


def feature_sets(rows: DataFrame, data: list[str], scores: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """rows with all features as columns, and the columns of each of the nine sets.

    The sets are the scores, raw and scaled; their sum, raw and scaled; the scaled data with the scaled scores, with the last score counted twice, with
    the scaled sum, with the sum's scaled logarithm, and with the sum in 19 levels. All scaling is to 0..1, and a constant column becomes 0."""
    f = rows.withColumns({**{f"d_{c}": F.col(c).cast("double") for c in data}, **{f"s_{c}": F.col(c).cast("double") for c in scores}, "total": sum((F.col(c).cast("double") for c in scores), F.lit(0.0))})
    f = f.withColumn("s_total", F.col("total"))
    f = min_max(f, [*[f"d_{c}" for c in data], *[f"s_{c}" for c in scores], "s_total"])
    f = f.withColumns({"log_total": guarded_log(F.col("s_total")), "twice": F.col(f"s_{scores[-1]}") * 2})
    f = quantise(min_max(f, ["log_total"]), "s_total", 0.0, 1.0)
    d, s = [f"d_{c}" for c in data], [f"s_{c}" for c in scores]
    return f, {
        "scores": list(scores), "scaled scores": s, "sum": ["total"], "scaled sum": ["s_total"], "data, scores": d + s, "data, last score twice": d + s[:-1] + ["twice"],
        "data, sum": [*d, "s_total"], "data, log of sum": [*d, "log_total"], "data, levels of sum": [*d, "level"],
    }


def _measured(table: pd.DataFrame) -> tuple[float, float]:
    """Accuracy by the best one-to-one map of labels, and mutual information over the mean entropy, of rows true, pred, n."""
    m = table.pivot_table(index="pred", columns="true", values="n", aggfunc="sum", fill_value=0).to_numpy(float)
    square = np.zeros((max(m.shape),) * 2)
    square[: m.shape[0], : m.shape[1]] = m
    p, a, b = m / m.sum(), m.sum(1) / m.sum(), m.sum(0) / m.sum()
    mutual = float((p[p > 0] * np.log(p[p > 0] / np.outer(a, b)[p > 0])).sum())
    mean = float(-(a * np.log(a)).sum() - (b * np.log(b)).sum()) / 2
    return assignment(square) / m.sum(), 1.0 if mean <= 0 else mutual / mean


def grouped_agreement(found: DataFrame, by: list[str], n: str | None = None) -> DataFrame:
    """by, accuracy, nmi of clusterings (by, label_true, label_pred): counts come together before a group, which holds labels squared. n: a column of counts."""
    counts = found.groupBy(*by, F.col("label_true").cast("long").alias("true"), F.col("label_pred").cast("long").alias("pred")).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        accuracy, nmi = _measured(frame)
        return frame[by].head(1).assign(accuracy=accuracy, nmi=nmi)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in by)
    return counts.groupBy(*by).applyInPandas(measure, f"{keys}, accuracy double, nmi double")


def agreements(rows: DataFrame, sets: dict[tuple, tuple[list[str], bool]], by: list[str], k: int, label: str = "label", rounds: int = 20, seed: int = 0) -> DataFrame:
    """by, accuracy, nmi of clusterings(): sets are {values of by: (columns, regularised)}, rows have an id."""
    f = written(rows, "features")
    return grouped_agreement(counted(f, clusterings(f, sets, k, rounds=rounds, seed=seed), by, label), by, "n")


def grid(rows: DataFrame, data: list[str], scores: list[str], k: int, label: str = "label", rounds: int = 300, seed: int = 0) -> DataFrame:
    """features, regularised, accuracy, nmi: k-means and regularised k-means over each of feature_sets(), against the label. All 18 go on together, a job a pass."""
    f, sets = feature_sets(rows, data, scores)
    return agreements(f, {(name, regularised): (cols, regularised) for name, cols in sets.items() for regularised in (False, True)}, ["features", "regularised"], k, label, rounds, seed)
