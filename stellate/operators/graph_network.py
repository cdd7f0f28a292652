"""Forward pass of a sparse graph network with given weights: joins gather neighbours, windows make the softmax over a node's edges.

Nodes: id, h (array<double>); edges: i, j, rank, e (array<double>), inv (rank of i among j's edges, null if none)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[float]]


@dataclass(frozen=True)
class Layer:
    """Square matrices: node itself, node's neighbours, edge, edge's source and target, and the inverse edge."""

    u: Matrix
    v: Matrix
    w_edge: Matrix
    w_from: Matrix
    w_to: Matrix
    w_inverse: Matrix


def times(m: Matrix, v: Column) -> Column:
    return F.array(*[F.aggregate(F.zip_with(v, F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in m])


def _plus(*vs: Column) -> Column:
    out = vs[0]
    for v in vs[1:]:
        out = F.zip_with(out, v, lambda a, b: a + b)
    return out


def _relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def forward(nodes: DataFrame, edges: DataFrame, layers: list[Layer], placeholder: list[float]) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after all layers: x' = x + relu(Ux + sum of softmax(We) * Vx over neighbours), e' = e + relu(We + from + to + inverse);
    an edge without inverse takes the placeholder."""
    size = len(placeholder)
    for layer in layers:
        gathered = edges.join(nodes.select(F.col("id").alias("j"), F.col("h").alias("hj")), "j").withColumns({"gate": times(layer.w_edge, F.col("e")), "vx": times(layer.v, F.col("hj"))})
        sums = gathered.groupBy("i").agg(*[F.sum(F.exp(F.col("gate")[k]) * F.col("vx")[k]).alias(f"n{k}") for k in range(size)], *[F.sum(F.exp(F.col("gate")[k])).alias(f"d{k}") for k in range(size)])
        pooled = sums.select(F.col("i").alias("id"), F.array(*[F.col(f"n{k}") / F.col(f"d{k}") for k in range(size)]).alias("pool"))
        back = edges.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("e").alias("e_back"))
        linked = gathered.join(nodes.select(F.col("id").alias("i"), F.col("h").alias("hi")), "i").join(back, ["i", "j"], "left")
        inverse = F.coalesce(F.col("e_back"), F.array(*map(F.lit, placeholder)))
        edges = linked.select("i", "j", "rank", _plus(F.col("e"), _relu(_plus(F.col("gate"), times(layer.w_from, F.col("hi")), times(layer.w_to, F.col("hj")), times(layer.w_inverse, inverse)))).alias("e"))
        zero = F.array(*[F.lit(0.0)] * size)
        nodes = nodes.join(pooled, "id", "left").select("id", _plus(F.col("h"), _relu(_plus(times(layer.u, F.col("h")), F.coalesce("pool", zero)))).alias("h"))
    return nodes, edges
