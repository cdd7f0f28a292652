"""Core points, near squares and border points for density clustering with a radius for each point, without all pairs of near points.

Points (id, x, y, r) lie in squares: a square of a level (the power of two below a radius) has such a side that its points of that level are near one another. So a square
with enough points has core points only, few points are left to be counted, and squares, not points, are the nodes of the graph of clusters. Two squares are near if a pair of
their points is: boxes tell it for most; the others are cut into quarters, level by level, until a box tells it or few places are left to meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from .neighbors import distance

#: A square of this share of a power of two as its side lies within that distance of each of its points; a radius, below twice the power, reaches so many squares on.
SQUARE, REACH = 0.7, 3
#: Radii below have a level of their own, whose squares are places: only copies are near for sure.
TINY = 1e-12
#: Places of a quarter that is not cut further, and levels of quarters.
SMALL, DEEPEST = 128, 26
#: Pairs of places that a task takes, and tasks at most.
MEET, TASKS = 4 << 20, 1024

_KEY = ("l", "cx", "cy", "ax", "ay")


def level(r: Column) -> Column:
    return F.when(r >= TINY, F.floor(F.log2(r))).otherwise(-41)


def squares(rows: DataFrame) -> DataFrame:
    """rows (x, y and l, a level) with their square: _KEY, of which ax and ay tell places apart in the lowest level only."""
    side = F.pow(F.lit(2.0), F.greatest(F.col("l"), F.lit(-40))) * SQUARE
    rows = rows.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    return rows.withColumns({f"a{c}": F.when(F.col("l") == -41, F.col(c)).otherwise(0.0) for c in "xy"})


def _on_levels(rows: DataFrame, levels: list[int]) -> DataFrame:
    """Each row once for each level, with its square there."""
    return squares(rows.withColumn("l", F.explode(F.array(*[F.lit(n).cast("long") for n in levels]))))


def _around(rows: DataFrame) -> DataFrame:
    """Each row once for every square within reach."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-REACH, REACH + 1) for b in range(-REACH, REACH + 1)])
    return rows.withColumn("_s", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("_s.a"), "cy": F.col("cy") + F.col("_s.b")}).drop("_s")


def _levels(rows: DataFrame) -> list[int]:
    return sorted(r.l for r in rows.select("l").distinct().collect())


def rows_of(points: DataFrame) -> DataFrame:
    """id, x, y, r of points that have a place, written; others are near nothing."""
    placed = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy")
    return written(points.where(placed).select("id", "x", "y", F.nanvl(F.col("r").cast("double"), F.lit(float("inf"))).alias("r")), "points")


def cores(rows: DataFrame, min_samples: int, mutual: bool) -> tuple[DataFrame, DataFrame]:
    """Core points (id, rep, l, x, y, r), rep being the smallest id of the core points in their square, and the others (id, x, y, r).

    A point is core if min_samples points, itself included, are within its radius (or, if mutual, within both radii). Only points in squares with fewer are counted,
    so a place meets fewer than min_samples of each square around."""
    queries = rows.where("r >= 0").withColumn("l", level(F.col("r")))
    levels = _levels(queries)
    if not levels:
        return queries.select("id", F.col("id").alias("rep"), "l", "x", "y", "r"), rows
    at = _on_levels(rows.groupBy("x", "y", *(["r"] if mutual else [])).agg(F.count(F.lit(1)).alias("w")), levels)
    sure = at.where((F.col("r") >= 0) & (level(F.col("r")) >= F.col("l"))) if mutual else at
    dense = sure.groupBy(*_KEY).agg(F.sum("w").alias("_w")).where(F.col("_w") >= min_samples).select(*_KEY, F.lit(True).alias("dense"))
    marked = written(squares(queries).join(dense, list(_KEY), "left"), "marked")
    limit = F.least("q.r", "c.r") if mutual else F.col("q.r")
    near = _around(marked.where("dense is null")).alias("q").join(at.alias("c"), ["l", "cx", "cy"]).where(distance("q", "c") <= limit)
    counted = near.groupBy(F.col("q.id").alias("id")).agg(F.sum("w").alias("_w")).where(F.col("_w") >= min_samples).select("id", F.lit(True).alias("counted"))
    told = written(rows.select("id", "x", "y", "r").join(marked.select("id", *_KEY, "dense"), "id", "left").join(counted, "id", "left"), "told")
    discard(marked)
    core = told.where("dense or counted")
    reps = core.groupBy(*_KEY).agg(F.min("id").alias("rep"))
    return written(core.join(reps, list(_KEY)).select("id", "rep", "l", "cx", "cy", "x", "y", "r"), "cores"), told.where("not coalesce(dense or counted, false)").select("id", "x", "y", "r")


def _boxes(places: DataFrame, *by: str) -> DataFrame:
    """The box, the number of places and the greatest radius of each group."""
    of = {"n": F.count(F.lit(1)), "x1": F.min("x"), "x2": F.max("x"), "y1": F.min("y"), "y2": F.max("y"), "r": F.max("r")}
    return places.groupBy(*by).agg(*[v.alias(k) for k, v in of.items()])


def _least() -> Column:
    gap = lambda c: F.greatest(F.col(f"b.{c}1") - F.col(f"a.{c}2"), F.col(f"a.{c}1") - F.col(f"b.{c}2"), F.lit(0.0))
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y"))


def _most() -> Column:
    span = lambda c: F.greatest(F.abs(F.col(f"b.{c}2") - F.col(f"a.{c}1")), F.abs(F.col(f"a.{c}2") - F.col(f"b.{c}1")))
    return F.sqrt(span("x") * span("x") + span("y") * span("y"))


def _limit(mutual: bool) -> Column:
    return F.least("a.r", "b.r") if mutual else F.col("a.r")


def _places(points: DataFrame, node: str) -> DataFrame:
    """node, x, y, r: the places of each node, each with the greatest radius there."""
    return points.groupBy(F.col(node).alias("node"), "x", "y").agg(F.max("r").alias("r"))


def _quartered(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Places of the given nodes with qx and qy, where they lie in the square around their node's places; written."""
    box = _boxes(places.join(nodes, "node", "left_semi"), "node").withColumn("_e", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    at = lambda c: F.when(F.col("_e") > 0, F.least(F.floor((F.col(c) - F.col(f"{c}1")) / F.col("_e") * (1 << DEEPEST)), F.lit((1 << DEEPEST) - 1))).otherwise(0).cast("long")
    return written(places.join(box.select("node", "x1", "y1", "_e"), "node").select("node", "x", "y", "r", at("x").alias("qx"), at("y").alias("qy")), "quartered")


def _quarter(depth: int) -> Column:
    """The number of the quarter at a depth in which a place lies; at 0, and above, the whole node is one."""
    return F.shiftleft(F.shiftright("qx", DEEPEST - depth), 32) + F.shiftright("qy", DEEPEST - depth) if depth > 0 else F.lit(0).cast("long")


def _reached(pairs: DataFrame, a: DataFrame, b: DataFrame, mutual: bool) -> DataFrame:
    """The pairs (i, j; written) of nodes of which a place of node i (in a: node, x, y, r) has a place of node j (in b) within its radius, or within both radii."""
    if pairs.isEmpty():
        return pairs
    left, depth, hits = pairs.select("i", "j", F.lit(0).cast("long").alias("iu"), F.lit(0).cast("long").alias("ju")), 0, []
    while True:
        cells = [_boxes(side.withColumns({"q": _quarter(depth), "up": _quarter(depth - 1)}), "node", "q", "up") for side in (a, b)]
        met = left.join(cells[0].withColumnsRenamed({"node": "i", "q": "iq", "up": "iu"}).alias("a"), ["i", "iu"]).join(cells[1].withColumnsRenamed({"node": "j", "q": "jq", "up": "ju"}).alias("b"), ["j", "ju"])
        told = F.when(_most() <= _limit(mutual), "near").when((F.greatest("a.n", "b.n") <= SMALL) | F.lit(depth == DEEPEST), "small").otherwise("open")
        met = met.where(_least() <= _limit(mutual)).select("i", "j", "iq", "jq", told.alias("is"), (F.col("a.n") * F.col("b.n")).alias("meet"), *[F.col(f"b.{c}") for c in ("x1", "x2", "y1", "y2")], F.col("b.r").alias("most"))
        met = written(met, "met")
        work = {r["is"]: r.n for r in met.groupBy("is").agg(F.sum("meet").alias("n")).collect()}
        near = met.where("is = 'near'").select("i", "j").distinct()
        if "small" in work:
            few = met.where("is = 'small'").join(near, ["i", "j"], "left_anti")
            near = near.union(_met(few, a, b, depth, mutual, min(TASKS, 1 + work["small"] // MEET))).distinct()
        hits.append(written(near, "near"))
        before, left = left, met.where("is = 'open'").select("i", "j", F.col("iq").alias("iu"), F.col("jq").alias("ju")).join(hits[-1], ["i", "j"], "left_anti")
        if "open" in work:
            left = written(left, "open")
        discard(before, met)
        if "open" not in work or left.isEmpty():
            discard(a, b, left)
            return reduce(DataFrame.union, hits).distinct()
        if depth == 0:  # only now some nodes are to be cut
            nodes = [left.select(F.col(c).alias("node")) for c in "ij"]
            a, b = [_quartered(a, nodes[0].union(nodes[1]))] * 2 if a is b else [_quartered(side, n) for side, n in zip((a, b), nodes, strict=True)]
        depth += 1


def _met(pairs: DataFrame, a: DataFrame, b: DataFrame, depth: int, mutual: bool, tasks: int) -> DataFrame:
    """i, j of the pairs of quarters (iq, jq, with the box and the greatest radius of jq) of which two places are near: only places that reach the box meet others.

    The number of tasks follows from the work: pairs are few bytes, so Spark would put them into a task or two."""
    at = lambda side, name, cell: side.select(F.col("node").alias(name), _quarter(depth).alias(cell), "x", "y", "r")
    gap = lambda c: F.greatest(F.col(f"{c}1") - F.col(c), F.col(c) - F.col(f"{c}2"), F.lit(0.0))
    reach = F.least("r", "most") if mutual else F.col("r")
    rows = pairs.repartition(tasks, "i", "iq").join(at(a, "i", "iq"), ["i", "iq"]).where(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= reach).select("i", "j", "jq", "x", "y", "r")
    return rows.repartition(tasks, "j", "jq").alias("a").join(at(b, "j", "jq").alias("b"), ["j", "jq"]).where(distance("a", "b") <= _limit(mutual)).select("i", "j").distinct()


def near_squares(cores: DataFrame, mutual: bool) -> DataFrame:
    """i, j: squares of core points (by rep) of which i has a point near one of j; if mutual, in one of both orders at least."""
    levels = _levels(cores)
    if not levels:
        return cores.select(F.col("rep").alias("i"), F.col("rep").alias("j"))
    places = written(cores.groupBy("rep", "l", "cx", "cy", "x", "y").agg(F.max("r").alias("r")), "places")
    theirs = _on_levels(places.select("rep", F.col("l").alias("_l"), "x", "y", "r"), levels)
    theirs = _boxes(theirs.where("_l >= l") if mutual else theirs, "l", "cx", "cy", "rep")  # mutual: both are within the smaller radius, and meet on its level
    pairs = _around(_boxes(places, "l", "cx", "cy", "rep")).alias("a").join(theirs.alias("b"), ["l", "cx", "cy"]).where((F.col("a.rep") != F.col("b.rep")) & (_least() <= _limit(mutual)))
    told = written(pairs.groupBy(F.col("a.rep").alias("i"), F.col("b.rep").alias("j")).agg(F.max(_most() <= _limit(mutual)).alias("near")), "told")
    of = _places(places, "rep")
    return told.where("near").select("i", "j").union(_reached(told.where("not near").select("i", "j"), of, of, mutual))


def border(cores: DataFrame, rest: DataFrame, mutual: bool) -> DataFrame:
    """id, root: the least root among the squares of core points (with their root) that reach each point of rest; if not mutual, only roots below the point's id count. Written."""
    levels = _levels(cores)
    theirs = _on_levels(rest, levels) if levels else squares(rest.withColumn("l", F.lit(0).cast("long"))).limit(0)
    theirs = theirs.select("id", "l", "cx", "cy", "r", *[F.col(c).alias(f"{c}{n}") for c in "xy" for n in (1, 2)])
    told = _around(_boxes(cores, "l", "cx", "cy", "rep", "root")).alias("a").join(theirs.alias("b"), ["l", "cx", "cy"]).where(_least() <= _limit(mutual))
    told = told.select("id", "rep", "root", (_most() <= _limit(mutual)).alias("near")).where(F.lit(True) if mutual else F.col("root") < F.col("id"))
    sure = written(told.where("near").groupBy("id").agg(F.min("root").alias("least")), "sure")
    pairs = written(told.where("not near").join(sure, "id", "left").where("least is null or root < least").select(F.col("rep").alias("i"), F.col("id").alias("j")).distinct(), "pairs")
    found = _reached(pairs, _places(cores, "rep"), _places(rest, "id"), mutual).join(cores.select(F.col("rep").alias("i"), "root").distinct(), "i")
    return written(sure.select("id", F.col("least").alias("root")).union(found.select(F.col("j").alias("id"), "root")).groupBy("id").agg(F.min("root").alias("root")), "border")
