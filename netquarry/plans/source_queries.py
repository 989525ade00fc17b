"""Round trips through the file sources and sinks: a derived table is written, read back and compared with itself."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.cluster import shared_dir
from netquarry.operators import prep
from netquarry.plans.graph_queries import partition_of
from netquarry.plans.sql import GRAPH, over
from netquarry.sources import graphs, readers, sinks

QUERIES, ORACLES = {}, {}


def add(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _place(s: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(s)}/nq-io-{uuid.uuid4().hex}/{name}"


def _put(s: SparkSession, path: str, data: bytes) -> None:
    """A small file in whatever store the path names."""
    jvm = s.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


_EDGES, _PART, _DEG = over(GRAPH, then="SELECT src, dst FROM e"), over(GRAPH, then="SELECT id, com FROM part"), over(GRAPH, then="SELECT id, deg FROM deg")


@add(_EDGES)
def edge_list_round_trip(s, d) -> DataFrame:
    """A3, A17."""
    path = _place(s)
    sinks.edge_list(graphs.event_graph(s, d), path)
    return readers.edge_list(s, path)


@add(_EDGES)
def graph_file(s, d) -> DataFrame:
    """A1: the giant component of a file that also holds a small component and a self-loop."""
    path = _place(s, "graph.txt")
    extra = s.createDataFrame([("zz1", "zz2"), ("zz3", "zz3")], "src string, dst string")
    sinks.edge_list(prep.giant_component(graphs.event_graph(s, d)).union(extra), path)
    return readers.read_graph(s, path)


@add(_EDGES)
def matrix_market_file(s, d) -> DataFrame:
    """A2: comments, and commas for spaces."""
    path = _place(s, "graph.mtx")
    lines = graphs.event_graph(s, d).select(F.concat_ws(",", "src", "dst", F.lit("1")).alias("value"))
    lines.union(s.createDataFrame([("%% a comment",)], "value string")).write.text(path)
    return readers.matrix_market(s, path)


@add(_EDGES)
def parquet_round_trip(s, d) -> DataFrame:
    """A4."""
    path = _place(s, "graph.parquet")
    graphs.event_graph(s, d).write.parquet(path)
    return readers.parquet_graph(s, path)


@add(_EDGES)
def benchmark_network_file(s, d) -> DataFrame:
    """A5: every edge twice, tab separated."""
    path, e = _place(s), graphs.event_graph(s, d)
    e.select("src", "dst").union(e.select("dst", "src")).write.option("sep", "\t").csv(path)
    return readers.lfr_network(s, path)


@add(_PART)
def benchmark_communities_file(s, d) -> DataFrame:
    """A5."""
    path = _place(s)
    partition_of(graphs.event_graph(s, d)).select("id", "com").write.option("sep", "\t").csv(path)
    return readers.lfr_communities(s, path)


@add(over(GRAPH, then="SELECT src, dst FROM pl WHERE layer = 2"))
def keyed_edges(s, d) -> DataFrame:
    """The edges of one named group; the layers are the groups."""
    groups = s.createDataFrame([(0, "purchase"), (1, "click"), (2, "error")], "id int, name string")
    return readers.keyed_edges(graphs.layers(s, d).select("src", "dst", F.col("layer").alias("subreddit")), groups, "error")


@add(over(GRAPH, then="SELECT k - 10 AS step, CAST(id AS BIGINT) AS node FROM (SELECT id, row_number() OVER (ORDER BY CAST(id AS BIGINT)) - 1 AS k FROM deg) WHERE k >= 10 AND k < 19"))
def crawl_log_trial(s, d) -> DataFrame:
    """The second trial of a log whose ids have quotes and prefixes."""
    path = _place(s)
    ids = prep.vertices(graphs.event_graph(s, d)).orderBy(F.col("id").cast("long")).limit(20).coalesce(1)
    rows = ids.withColumn("row_no", F.monotonically_increasing_id())
    rows.select(F.concat(F.lit("u'"), "id", F.lit("' ")).alias("mod"), (F.col("row_no") % 10 + 1).alias("budget")).coalesce(1).write.option("header", True).csv(path)
    return readers.trial(readers.crawl_log(s, path), "mod", 1)


@add("SELECT CAST(i AS VARCHAR) AS src, CAST((i + k) % 100 AS VARCHAR) AS dst FROM range(100) t(i), (VALUES (1), (99)) u(k)")
def binary_graph_file(s, d) -> DataFrame:
    """A ring of 100 nodes."""
    path, n = _place(s, "ring.bin"), 100
    links = [x for i in range(n) for x in ((i + 1) % n, (i + n - 1) % n)]
    _put(s, path, struct.pack(f"<I{n}I{2 * n}I", n, *range(2, 2 * n + 1, 2), *links))
    return readers.binary_graph(s, path)


@add("SELECT CAST(layer AS INTEGER) AS layer, folder, src, dst FROM (VALUES (0, 'b', '1', '3'), (1, 'a', '1', '2'), (1, 'a', '2', '3')) t(layer, folder, src, dst)")
def layer_folder_files(s, d) -> DataFrame:
    """A10: two files, the second named as the expensive layer."""
    path = _place(s)
    _put(s, f"{path}/a", b"1 2\n3 2\n")
    _put(s, f"{path}/b", b"1 3\n")
    return readers.layer_folder(s, path, expensive="b")


@add(over(GRAPH, then="SELECT id FROM deg"))
def saved_nodes_file(s, d) -> DataFrame:
    """A12."""
    path = _place(s)
    quoted = prep.vertices(graphs.event_graph(s, d)).select(F.concat(F.lit("'"), "id", F.lit("'")).alias("q"), (F.crc32("id") % 7).alias("k"))
    quoted.groupBy("k").agg(F.concat(F.lit("set(["), F.concat_ws(", ", F.collect_list("q")), F.lit("])")).alias("value")).select("value").write.text(path)
    return readers.saved_nodes(s, path).select("id")


@add(_PART)
def cached_partition(s, d) -> DataFrame:
    """The second call reads what the first has stored."""
    path = _place(s)
    sinks.cached(s, path, lambda: partition_of(graphs.event_graph(s, d)).select("id", "com"))
    return sinks.cached(s, path, lambda: s.createDataFrame([], "id string, com int"))


@add(_DEG)
def appended_rows(s, d) -> DataFrame:
    """Two appends of one table's halves."""
    path, deg = _place(s), prep.degrees(graphs.event_graph(s, d)).select("id", "deg")
    for k in range(2):
        sinks.append_csv(deg.where(F.crc32("id") % 2 == k), path)
    return s.read.schema("id string, deg long").option("header", True).csv(path)


@add(over(GRAPH, then="WITH c AS (SELECT deg AS cost, count(*) * 1.5::DOUBLE AS value FROM deg GROUP BY deg) SELECT 'deg_Cost, ' || string_agg(CAST(CAST(cost AS DOUBLE) AS VARCHAR), ', ' ORDER BY cost) AS value FROM c UNION ALL SELECT 'deg, ' || string_agg(CAST(CAST(value AS DOUBLE) AS VARCHAR), ', ' ORDER BY cost) FROM c"))
def curve_lines(s, d) -> DataFrame:
    """A15."""
    deg = prep.degrees(graphs.event_graph(s, d))
    return sinks.curve_lines(deg.groupBy(F.col("deg").alias("cost")).agg((F.count("*") * F.lit(1.5)).alias("value")).withColumn("type", F.lit("deg")))


@add(_DEG)
def report_round_trip(s, d) -> DataFrame:
    """A19."""
    path = _place(s)
    sinks.report(prep.degrees(graphs.event_graph(s, d)).select("id", "deg"), path)
    return s.read.schema("id string, deg long").option("header", True).option("sep", " ").csv(path)
