"""Readers of point sets and routing files; all go through Spark's own sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph_network import Layer
from ..operators.routes import unpacked


def _values(rows: DataFrame, separator: str) -> DataFrame:
    """Lines of numbers as dataset, v (all but the last), label (the last); ids count on in each file's order of reading."""
    parts = F.filter(F.split(F.trim("value"), separator), lambda p: p != "")
    return rows.where(F.trim("value") != "").select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("dataset"), F.monotonically_increasing_id().alias("id"), parts.alias("p")).select("dataset", "id", F.transform(F.slice("p", 1, F.size("p") - 1), lambda s: s.cast("double")).alias("v"), F.element_at("p", -1).cast("double").cast("int").alias("label"))


def read_csv_points(spark: SparkSession, path: str) -> DataFrame:
    """dataset, id, v, label of comma-separated files without a header, the label last."""
    return _values(spark.read.text(path).select("value", "_metadata"), ",")


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    """As read_csv_points(), with white space or commas between the numbers."""
    return _values(spark.read.text(path).select("value", "_metadata"), r"\s+|,")


def read_outlier_points(spark: SparkSession, path: str) -> DataFrame:
    """read_text_points() with is_outlier: rows of the dataset's largest label."""
    rows = read_text_points(spark, path)
    return rows.join(rows.groupBy("dataset").agg(F.max("label").alias("_m")), "dataset").withColumn("is_outlier", F.col("label") == F.col("_m")).drop("_m")


def read_shards(spark: SparkSession, path: str, pattern: str = "*_part_*.parquet", lenient: bool = False) -> DataFrame:
    """All shards of a folder as one, with the columns of a first shard by name. An unreadable shard is an error; if lenient, it is left out, and
    shard_report() names it."""
    return spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", str(lenient).lower()).parquet(path)


def shard_report(spark: SparkSession, path: str, pattern: str = "*_part_*.parquet") -> DataFrame:
    """file, rows, lacking of every shard of a folder: its rows that can be read, and the columns without a value in any of them.

    A shard that can't be read at all, or is empty, has 0 rows; one with other keys lacks all columns that it hasn't. One aggregation over the shards."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("_metadata.file_path").alias("file"))
    rows = read_shards(spark, path, pattern, lenient=True)
    counts = rows.select(F.col("_metadata.file_path").alias("file"), *[F.col(f"`{c}`").isNotNull().alias(f"_{n}") for n, c in enumerate(rows.columns)]).groupBy("file")
    counts = counts.agg(F.count(F.lit(1)).alias("rows"), F.array_compact(F.array(*[F.when(~F.bool_or(f"_{n}"), F.lit(c)) for n, c in enumerate(rows.columns)])).alias("lacking"))
    return listed.join(counts, "file", "left").select("file", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("lacking", F.array(*map(F.lit, rows.columns))).alias("lacking"))


def read_bvecs(spark: SparkSession, path: str) -> DataFrame:
    """file, row, v of vectors of bytes, each behind its length as four bytes; all vectors of a file have the length of its first.

    Files are read as records of a fixed length, in as many splits as Spark's file size for a partition asks for, so a file may be of any size. The
    driver looks at the first four bytes of each file only; an empty file has no rows, and one that ends within a record is an error."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for top in (fs.globStatus(at) or []) for f in (fs.listStatus(top.getPath()) if top.isDirectory() else [top]) if f.isFile()]
    files = [f for f in found if not f.getPath().getName().startswith(("_", "."))]
    size = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    out = spark.createDataFrame([], "file string, row long, v array<int>")
    for f in files:
        if f.getLen() < 4:
            continue
        stream = fs.open(f.getPath())
        try:
            dim = int.from_bytes(bytes(stream.read() for _ in range(4)), "little")
        finally:
            stream.close()
        if f.getLen() % (dim + 4):
            raise ValueError(f"{f.getPath()}: {f.getLen()} bytes are no whole number of records of {dim + 4}")
        name = f.getPath().toString()
        conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(dim + 4), "mapreduce.input.fileinputformat.split.maxsize": str(max(size, dim + 4))}
        records = spark.sparkContext.newAPIHadoopFile(name, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        out = out.unionByName(records.map(lambda r, name=name: (name, int(r[0]), list(r[1][4:]))).toDF("file string, row long, v array<int>"))
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (its path), n, value: numbered lines; a routing file is one small record, so its text is read whole and split."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))


def _sections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Callable]:
    """Lines of routing problems, those that begin with a number as file, section, node (from 0), p (their words), and a function for word k as a type."""
    lines = _lines(spark, path)
    heads = F.when(F.trim("value").rlike("^[A-Z_]+_SECTION|^EOF"), F.regexp_extract(F.trim("value"), "^[A-Z_]+", 0))
    rows = lines.withColumn("section", F.last(heads, ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))).withColumn("p", F.split(F.trim("value"), r"\s+"))
    number = lambda k, t: F.try_element_at("p", F.lit(k)).try_cast(t)
    return lines, rows.where(F.trim("value").rlike("^[0-9]")).select("file", "section", (number(1, "int") - 1).alias("node"), "p"), number


def _header(lines: DataFrame, name: str, pattern: str, kind: str) -> DataFrame:
    """file and the value of a header line, as a column of the name in lower case; of repeated lines the first counts."""
    found = lines.where(F.trim("value").startswith(name)).groupBy("file").agg(F.min_by("value", "n").alias("value"))
    return found.select("file", F.regexp_extract("value", pattern, 1).try_cast(kind).alias(name.lower()))


def read_problem(spark: SparkSession, path: str) -> DataFrame:
    """file, capacity, node (from 0), x, y, demand of routing problems with coordinate and demand sections."""
    lines, inside, number = _sections(spark, path)
    xy = inside.where("section = 'NODE_COORD_SECTION'").select("file", "node", number(2, "double").alias("x"), number(3, "double").alias("y"))
    demand = inside.where("section = 'DEMAND_SECTION'").select("file", "node", number(2, "int").alias("demand"))
    return xy.join(demand, ["file", "node"], "left").join(_header(lines, "CAPACITY", "([0-9]+)", "int"), "file", "left").select("file", "capacity", "node", "x", "y", "demand")


def read_full_problem(spark: SparkSession, path: str) -> DataFrame:
    """read_problem() with type, service_time, window_start, window_end and is_pickup (0 or 1); what a file doesn't have is null.

    The demand of a problem with pickups is what is picked up or delivered at the node. Lines of a section come together by file and node; of
    a node that a section lists twice, the largest values count."""
    lines, inside, number = _sections(spark, path)
    at = lambda section, value: F.max(F.when(F.col("section") == section, value))
    picked, brought = number(6, "int"), number(7, "int")
    rows = inside.where("section IN ('NODE_COORD_SECTION', 'DEMAND_SECTION', 'TIME_WINDOW_SECTION', 'PICKUP_AND_DELIVERY_SECTION')").groupBy("file", "node").agg(
        at("NODE_COORD_SECTION", number(2, "double")).alias("x"), at("NODE_COORD_SECTION", number(3, "double")).alias("y"),
        F.coalesce(at("DEMAND_SECTION", number(2, "int")), at("PICKUP_AND_DELIVERY_SECTION", F.greatest(picked, brought))).alias("demand"),
        at("TIME_WINDOW_SECTION", number(2, "double")).alias("window_start"), at("TIME_WINDOW_SECTION", number(3, "double")).alias("window_end"),
        at("PICKUP_AND_DELIVERY_SECTION", (picked > 0).cast("int")).alias("is_pickup"))
    for one in (_header(lines, "CAPACITY", "([0-9]+)", "int"), _header(lines, "TYPE", r":\s*(\w+)", "string"), _header(lines, "SERVICE_TIME", r":\s*([0-9.]+)", "double")):
        rows = rows.join(one, "file", "left")
    return rows.select("file", "type", "capacity", "service_time", "node", "x", "y", "demand", "window_start", "window_end", "is_pickup")


def read_tour(spark: SparkSession, path: str, n: int) -> DataFrame:
    """file, pos, node of a tour section up to -1: numbers from 1 become nodes from 0, those beyond n the depot 0."""
    lines = _lines(spark, path)
    flag = F.max((F.trim("value") == "TOUR_SECTION").cast("int")).over(Window.partitionBy("file").orderBy("n"))
    stop = F.max((F.trim("value") == "-1").cast("int")).over(Window.partitionBy("file").orderBy("n"))
    rows = lines.withColumns({"inside": flag, "over": stop}).where("inside = 1 and over = 0").where(F.trim("value").rlike("^[0-9]+$"))
    node = F.trim("value").cast("int") - 1
    return rows.select("file", F.col("n").alias("pos"), F.when(node > n, 0).otherwise(node).alias("node"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """file, route (from 1), nodes of `Route #i: a b c` lines."""
    found = _lines(spark, path).where(F.col("value").rlike("^Route #[0-9]+:"))
    nodes = F.transform(F.filter(F.split(F.regexp_extract("value", ":(.*)$", 1), r"\s+"), lambda s: s != ""), lambda s: s.cast("int"))
    return found.select("file", F.regexp_extract("value", "#([0-9]+)", 1).cast("int").alias("route"), nodes.alias("nodes"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """file, trial, objective, seconds of a solver's trial lines."""
    found = _lines(spark, path).where(F.trim("value").startswith("-Trial"))
    numbers = F.regexp_extract_all("value", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    return found.select("file", numbers[0].cast("int").alias("trial"), numbers[1].cast("double").alias("objective"), numbers[2].cast("double").alias("seconds"))


def read_candidates(spark: SparkSession, path: str, scale: float = 1e6) -> DataFrame:
    """file, i, rank, j, d, inverse of lines of triples."""
    lines = _lines(spark, path).withColumn("p", F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))).where(F.size("p") >= 3)
    triple = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int") - 1), lambda k: F.struct(k.alias("rank"), F.element_at("p", 3 * k + 1).cast("int").alias("j"), (F.element_at("p", 3 * k + 2) / scale).alias("d"), F.element_at("p", 3 * k + 3).cast("int").alias("inverse")))
    return lines.select("file", F.col("n").alias("i"), F.explode(triple).alias("t")).select("file", "i", "t.*")


def read_candidate_runtime(spark: SparkSession, path: str) -> DataFrame:
    """file, seconds: the runtime line (a single number) of files of candidates; null where there is none."""
    rows = _lines(spark, path).withColumn("one", F.regexp_extract(F.trim("value"), r"^([0-9]+(?:\.[0-9]+)?)$", 1))
    return rows.groupBy("file").agg(F.max_by("one", F.when(F.col("one") != "", F.col("n"))).cast("double").alias("seconds"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """file, id, score: one number on each line."""
    return _lines(spark, path).where(F.trim("value") != "").select("file", F.col("n").cast("long").alias("id"), F.trim("value").cast("double").alias("score"))


def read_graph_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as sinks.write_graph_features() wrote them; a filter on its partition columns reads those folders only."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_outlier_sets(spark: SparkSession, path: str, most: int = 50_000) -> DataFrame:
    """dataset, id, v, is_outlier (y is 1) of the Parquet rows (dataset, id, v, y); sets of more rows than `most` are passed over, as the sets' definition has it."""
    rows = spark.read.parquet(path)
    kept = rows.groupBy("dataset").count().where(F.col("count") <= most).select("dataset")
    return rows.join(kept, "dataset", "left_semi").select("dataset", "id", "v", (F.col("y") == 1).alias("is_outlier"))


def read_nested_problems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (problem, node, x, y, demand, capacity, and extra columns of an entry a node) and routes (problem, route from 0, nodes, distance).

    The Parquet rows are problems: problem, capacity, distances, routes (each closed by a 0) and arrays with an entry for each node: x, y, demand, others."""
    rows = spark.read.parquet(path)
    per_node = [f.name for f in rows.schema if f.dataType.typeName() == "array" and f.name not in ("routes", "distances")]
    nodes = rows.select("problem", "capacity", F.posexplode(F.arrays_zip(*per_node)).alias("node", "_n")).select("problem", "node", "capacity", *[F.col(f"_n.{c}").alias(c) for c in per_node])
    routes = unpacked(rows.select("problem", F.col("routes").alias("packed")))
    distance = F.try_element_at("distances", (F.col("route") + 1).cast("int"))
    return nodes, routes.join(rows.select("problem", "distances"), "problem").select("problem", "route", "nodes", distance.alias("distance"))


def read_weights(spark: SparkSession, path: str) -> tuple[list[Layer], list[float]]:
    """Layers and placeholder of a graph network as sinks.write_weights() wrote them."""
    found = {(r.layer, r.part): r["values"] for r in spark.read.parquet(path).collect()}  # a few rows for each layer
    parts = [f.name for f in fields(Layer)]
    layers = [Layer(*[found[n, p] for p in parts]) for n in range(sum(p == parts[0] for _, p in found))]
    return layers, found[-1, "placeholder"][0]
