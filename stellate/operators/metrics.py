"""Clustering and ranking metrics. All start from grouped counts; noise (-1) is a label of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def contingency(rows: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    return rows.groupBy(F.col(pred).alias("pred"), F.col(true).alias("true")).agg(F.count(F.lit(1)).alias("n"))


def assignment(weights: np.ndarray) -> float:
    """The largest sum of one entry in each row and column of a square matrix."""
    return float(sum(weights[a, b] for a, b in matched(weights)))


def matched(weights: np.ndarray) -> list[tuple[int, int]]:
    """The row and column of each entry of that sum (Hungarian method with potentials)."""
    cost = weights.max() - weights if weights.size else weights
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, n + 1)]


def accuracy(rows: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """accuracy: the share of rows that the best one-to-one map of labels gets right; 0 without rows.

    The contingency table (labels squared) is one group; the rows are counted before that."""

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index="pred", columns="true", values="n", aggfunc="sum", fill_value=0).to_numpy(float)
        size = max(table.shape)
        square = np.zeros((size, size))
        square[: table.shape[0], : table.shape[1]] = table
        return pd.DataFrame({"accuracy": [assignment(square) / table.sum()]})

    found = contingency(rows, true, pred).groupBy(F.lit(0).alias("one")).applyInPandas(best, "accuracy double")
    return found.agg(F.coalesce(F.max("accuracy"), F.lit(0.0)).alias("accuracy"))


def filtered_accuracy(rows: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """accuracy() over the rows that aren't noise; 0 if all are."""
    return accuracy(rows.where(F.col(pred) != -1), true, pred)


def nmi(rows: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """Mutual information over the mean of both entropies (natural logs); 1 if both are 0."""
    joint = contingency(rows, true, pred)
    by_pred, by_true = joint.groupBy("pred").agg(F.sum("n").alias("a")), joint.groupBy("true").agg(F.sum("n").alias("b"))
    total = joint.agg(F.sum("n").alias("t"))
    entropy = lambda df, c: df.join(F.broadcast(total)).agg(F.sum(-(F.col(c) / F.col("t")) * F.log(F.col(c) / F.col("t"))).alias(f"h_{c}"))  # noqa: E731  a row joined with a row
    mutual = joint.join(by_pred, "pred").join(by_true, "true").join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    mean = (F.col("h_a") + F.col("h_b")) / 2
    return mutual.join(entropy(by_pred, "a")).join(entropy(by_true, "b")).select(F.when(mean <= 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))


def ari(rows: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """Adjusted Rand index by counts of pairs."""
    joint = contingency(rows, true, pred)
    pairs = lambda df, c, out: df.agg(F.sum(F.col(c) * (F.col(c) - 1) / 2.0).alias(out))
    both = pairs(joint, "n", "s").join(pairs(joint.groupBy("pred").agg(F.sum("n").alias("a")), "a", "sa")).join(pairs(joint.groupBy("true").agg(F.sum("n").alias("b")), "b", "sb")).join(joint.agg(F.sum("n").alias("t")))
    expected = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), F.col("t") * (F.col("t") - 1) / 2.0), F.lit(0.0))
    mean = (F.col("sa") + F.col("sb")) / 2
    return both.select(F.when(mean == expected, 1.0).otherwise((F.col("s") - expected) / (mean - expected)).alias("ari"))


def _by_score(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """Positives and negatives of each score, and of all higher ones; sums run over distinct scores, ranges first."""
    grouped = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive).cast("boolean")).cast("long")).alias("n"))
    ranged = written(grouped.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()), "ranges")  # planned twice, ranges may differ
    inner = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("pp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("on"))
    return ranged.join(F.broadcast(offsets), "part").select("s", "p", "n", (F.sum("p").over(inner) + F.col("op")).alias("tp"), (F.sum("n").over(inner) + F.col("on")).alias("fp"))


def roc_auc(rows: DataFrame, positive: str = "positive", score: str = "score") -> DataFrame:
    """Area under the ROC curve; ties count half; null if one class is empty."""
    by = _by_score(rows, positive, score)
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2.0)
    return by.agg(F.try_divide(wins, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def average_precision(rows: DataFrame, positive: str = "positive", score: str = "score") -> DataFrame:
    """Sum over distinct thresholds of the recall gained times the precision there; null without positives."""
    by = _by_score(rows, positive, score)
    return by.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p").cast("double")).alias("average_precision"))


def top_z(rows: DataFrame, z: int, positive: str = "positive", score: str = "score") -> DataFrame:
    """precision, recall, f1 of the z highest scores (ties to the higher id) as the predicted positives."""
    best = rows.orderBy(F.desc(score), F.desc("id")).limit(z).agg(F.sum(F.col(positive).cast("long")).alias("hit"))
    total = rows.agg(F.sum(F.col(positive).cast("long")).alias("all"))
    p, r = F.col("hit") / F.lit(float(z)), F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("all").cast("double")), F.lit(0.0))
    return best.join(total).select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("accuracy"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, weight: rows over (labels times the label's rows)."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))).select(label, (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))


def best_of_grid(grid: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """The row with the highest metric, the first in order on ties."""
    return grid.orderBy(F.desc(metric), *order).limit(1)


def edge_rank(edges: DataFrame, score: str = "p", positive: str = "is_tour") -> DataFrame:
    """The mean rank (from 1, best score first) of true edges among their node's."""
    w = Window.partitionBy("i").orderBy(F.desc(score), "j")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col(positive)).agg(F.avg("rank").alias("mean_rank"))


def top_k_agreement(points: DataFrame, k: int, score: str = "score", eps: float = 0.05, seed: int = 0) -> DataFrame:
    """hit_ratio, accuracy of the k highest scores (ties to the higher id) as centres, against k-means with k clusters.

    The hit ratio is the share of centres within eps of theirs, in the match of centres of least summed distance; the accuracy is that
    of nearest centres against the k-means clusters. Only 2k centres leave the executors."""
    from .centres import k_means
    from .neighbors import nearest_centre

    rows, model = k_means(points, ["x", "y"], k, seed, "label_true")
    top = [(n, r.x, r.y) for n, r in enumerate(points.orderBy(F.desc(score), F.desc("id")).limit(k).select("x", "y").collect())]
    theirs = [tuple(map(float, c)) for c in model.clusterCenters()]
    apart = np.array([[float(np.hypot(x - a, y - b)) for a, b in theirs] for _, x, y in top])
    n = max(apart.shape)
    weights = np.zeros((n, n))
    weights[: apart.shape[0], : apart.shape[1]] = apart.max() + 1 - apart
    hits = sum(bool(apart[a, b] <= eps) for a, b in matched(weights) if a < apart.shape[0] and b < apart.shape[1])
    return accuracy(nearest_centre(rows, top).select("label_true", F.col("centre").alias("label_pred"))).select(F.lit(hits / k).alias("hit_ratio"), "accuracy")


def grouped_ranking(rows: DataFrame, by: list[str], z: int, positive: str = "positive", score: str = "score") -> DataFrame:
    """by, precision, recall, f1 (of the z highest scores, ties to the higher id), auc, average_precision of each group of rows (with id).

    Scores are counted first; sums run over ranges of (group, score), so neither a group nor a score that many rows share has to fit in a task."""
    from .order import running

    rows = written(rows.select(*by, "id", F.col(positive).alias("_p"), F.col(score).alias("_s")), "scored")
    p, n = F.col("_p").cast("long"), 1 - F.col("_p").cast("long")
    counts = rows.groupBy(*by, "_s").agg(F.sum(p).alias("p"), F.sum(n).alias("n"))
    sums = written(running(counts, [*by, F.desc("_s")], {"tp": F.col("p"), "fp": F.col("n")}), "sums")
    first = sums.groupBy(*by).agg(F.min("tp").alias("_tp"), F.min("fp").alias("_fp"), F.sum("p").alias("all"), F.sum("n").alias("none"))
    sums = sums.join(first, by).withColumns({"tp": F.col("tp") - F.col("_tp"), "fp": F.col("fp") - F.col("_fp")})  # of all higher scores
    before, size = F.col("tp") + F.col("fp"), F.col("p") + F.col("n")
    wins = F.sum(F.col("n") * F.col("tp") + F.col("n") * F.col("p") / 2.0)
    steps = F.sum(F.when(F.col("p") > 0, F.col("p") * (F.col("tp") + F.col("p")) / (before + size)).otherwise(0.0))
    ranking = sums.groupBy(*by, "all", "none").agg(F.try_divide(wins, (F.col("all") * F.col("none")).cast("double")).alias("auc"), F.try_divide(steps, F.col("all").cast("double")).alias("average_precision"), F.sum(F.when(before + size <= z, F.col("p")).otherwise(0)).alias("hit"))
    border = sums.where((before < z) & (before + size > z)).select(*by, "_s", (z - before).alias("need"))
    tied = running(rows.join(border, [*by, "_s"]), [*by, F.desc("id")], {"at": F.lit(1)})
    tied = written(tied, "tied")
    start = tied.groupBy(*by).agg(F.min("at").alias("_at"))
    more = tied.join(start, by).where(F.col("at") - F.col("_at") < F.col("need")).groupBy(*by).agg(F.sum(p).alias("more"))
    found = ranking.join(more, by, "left").withColumn("hit", F.col("hit") + F.coalesce("more", F.lit(0)))
    a, r = F.col("hit") / F.lit(float(z)), F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("all").cast("double")), F.lit(0.0))
    return found.select(*by, a.alias("precision"), r.alias("recall"), F.when(a + r > 0, 2 * a * r / (a + r)).otherwise(0.0).alias("f1"), "auc", "average_precision")
