"""File sources: edge lists, matrix-market-like files, LFR output, SQLite extracts, crawl logs, layer folders, binary graphs."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.operators import prep
from netquarry.sources.graphs import canonical


def edge_list(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """A3: white-space separated pairs of string ids; further columns are dropped, comment and short lines too."""
    parts = F.split(F.trim("value"), sep)
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts.alias("p")).where("size(p) >= 2")
    return rows.select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """A2: lines that start with % are comments, commas are spaces; the size line of a real file is a row like others."""
    parts = F.split(F.translate("value", ",", " "), " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("%")).select(parts.alias("p")).where("size(p) >= 2")
    return rows.select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def parquet_graph(spark: SparkSession, path: str) -> DataFrame:
    """A4: a stored graph is a table of edges; untrusted object dumps are never loaded."""
    return spark.read.parquet(path).select(F.col("src").cast("string"), F.col("dst").cast("string"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A1: by extension; then the giant component first, self-loops afterwards."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    rows = matrix_market(spark, path) if ext in ("mtx", "edges") else parquet_graph(spark, path) if ext == "parquet" else edge_list(spark, path)
    loops = rows.where("src = dst").distinct()
    plain = canonical(rows)
    if plain.isEmpty():
        return plain
    return prep.giant_component(plain.union(loops)).where("src <> dst")


def lfr_network(spark: SparkSession, path: str) -> DataFrame:
    """A5: tab separated, every edge twice, ids from 1."""
    return canonical(spark.read.csv(path, sep="\t", schema="src string, dst string").select(F.trim("src").alias("src"), F.trim("dst").alias("dst")))


def lfr_communities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id string, com string").select(F.trim("id").alias("id"), F.trim("com").cast("int").alias("com"))


def keyed_edges(edges: DataFrame, groups: DataFrame, name: str, key: str = "subreddit") -> DataFrame:
    """The edges whose group has the given name; the two first columns only. ``groups(id, name)`` may come from JDBC."""
    own = groups.where(F.col("name") == name).select(F.col("id").alias(key))
    a, b = edges.columns[:2]
    return edges.join(own, key, "left_semi").select(F.col(a).alias("src"), F.col(b).alias("dst"))


def crawl_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with one id column per algorithm; (row_no, algo, node) with quotes, blanks and u-prefixes stripped."""
    lines = spark.read.csv(path, header=True)
    # Row order is the order of the file: one log is one small file.
    rows = lines.coalesce(1).withColumn("row_no", F.monotonically_increasing_id())
    clean = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"u?['\" ]", "").cast("long")
    return rows.select("row_no", *[clean(c).alias(c.strip()) for c in lines.columns])


def trial(log: DataFrame, algo: str, t: int, budget: str = "budget") -> DataFrame:
    """Rows of one trial of one algorithm; a trial is as long as the greatest budget mark."""
    size = log.agg(F.max(budget).alias("size"))
    return log.crossJoin(F.broadcast(size)).where((F.col("row_no") >= F.lit(t) * F.col("size")) & (F.col("row_no") < (F.lit(t) + 1) * F.col("size") - 1)).select((F.col("row_no") - F.lit(t) * F.col("size")).alias("step"), F.col(algo).alias("node"))


def binary_graph(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian uint32: n, n cumulative degrees, links."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                (n,) = struct.unpack_from("<I", data)
                ends = struct.unpack_from(f"<{n}I", data, 4)
                links = struct.unpack_from(f"<{ends[-1] if n else 0}I", data, 4 + 4 * n)
                src = [str(i) for i in range(n) for _ in range(ends[i] - (ends[i - 1] if i else 0))]
                yield pa.record_batch([pa.array(src, pa.string()), pa.array([str(x) for x in links], pa.string())], names=["src", "dst"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src string, dst string")


def layer_folder(spark: SparkSession, path: str, expensive: str | None = None) -> DataFrame:
    """A10: every regular file is a layer; the first by name (or ``expensive``) is layer 0."""
    parts = F.split(F.trim("value"), r"\s+")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    rows = spark.read.text(path).select(name.alias("folder"), parts.alias("p")).where("size(p) >= 2 AND folder <> '.DS_Store'")
    edges = canonical(rows.select("folder", F.col("p")[0].alias("src"), F.col("p")[1].alias("dst")), "src", "dst", "folder")
    first = F.lit(0) if expensive is None else (F.col("folder") != expensive).cast("int")
    order = edges.select("folder").distinct().withColumn("layer", F.row_number().over(Window.orderBy(first, "folder")) - 1)
    return edges.join(F.broadcast(order), "folder").select("layer", "folder", "src", "dst")


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Ids in single quotes; (file, id)."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.explode(F.regexp_extract_all("value", F.lit("'(.*?)'"), F.lit(1))).alias("id"))
