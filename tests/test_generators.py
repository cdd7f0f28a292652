"""Generated instances: their bounds, labels and shares."""

import pytest
from pyspark.sql import functions as F

from stellate.functions import generators


@pytest.mark.parametrize("mixed", [False, True])
def test_clustered_instances(spark, mixed):
    got = generators.clustered(spark, 6, 60, 4, 0.07, seed=3, mixed=mixed).toPandas()
    assert len(got) == 6 * 61 and got[["x", "y"]].to_numpy().min() >= 0 and got[["x", "y"]].to_numpy().max() <= 1
    for _, one in got.groupby("sample"):
        assert sorted(one["i"]) == list(range(61)) and (one["label"] == -2).sum() == 1 and (one["label"] == -1).sum() == (28 if mixed else 0)
        centres = one[one["i"].between(1, 4)]
        assert centres[["x", "y"]].to_numpy().min() >= 0.2 and centres[["x", "y"]].to_numpy().max() <= 0.8
        near = one[one["label"] >= 0].merge(centres, on="label")
        assert (((near["x_x"] - near["x_y"]) ** 2 + (near["y_x"] - near["y_y"]) ** 2) ** 0.5).max() < 0.5
    with pytest.raises(ValueError):
        generators.clustered(spark, 1, 4, 4, 0.1)


def test_depot_in_the_middle_and_the_same_on_other_partitions(spark):
    got = generators.clustered(spark, 2, 30, 3, 0.05, seed=1, centre_depot=True)
    rows = got.toPandas()
    for _, one in rows.groupby("sample"):
        rest = one[one["i"] > 0]
        assert one[one["i"] == 0][["x", "y"]].to_numpy()[0] == pytest.approx(rest[["x", "y"]].mean().to_numpy())
    assert sorted(got.where("i > 0").collect()) == sorted(generators.clustered(spark, 2, 30, 3, 0.05, seed=1).where("i > 0").collect())


def test_curriculum(spark):
    got = generators.curriculum(spark, 10, 400, seed=2)
    stats = {r["sample"]: r for r in got.groupBy("sample").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("y").alias("ly"), F.max("y").alias("hy"), F.countDistinct("label").alias("modes"), F.min("label").alias("first")).collect()}
    assert stats[0].first == -1 and 0 < stats[0].lo and stats[0].hi <= 1
    for n, (modes, _) in enumerate(generators.CURRICULUM[1:], 1):
        assert (stats[n].modes, stats[n].lo, stats[n].hi, stats[n].ly, stats[n].hy) == (modes, 0.0, 1.0, 0.0, 1.0)


@pytest.mark.parametrize(("kind", "labels"), [("moons_circles", 4), ("face", 4), ("bowl", 3), ("two_arms", 2), ("nested_blocks", 3)])
def test_shapes(spark, kind, labels):
    got = generators.points(spark, kind, 700, seed=4).toPandas()
    assert sorted(got["label"].unique()) == list(range(labels)) and got["label"].value_counts().min() > 60 and got[["x", "y"]].notna().all().all()
