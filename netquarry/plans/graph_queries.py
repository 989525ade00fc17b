"""Graph preparation, access, metric, statistic, community and oracle queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import u_sql
from netquarry.operators import access, community, metrics, oracle, prep, stats
from netquarry.plans.sql import CLUSTERING, GRAPH, SPARSE, TRIPARTITE, over, pagerank
from netquarry.sources import graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def graph(f=None, *, sql: str | None = None, with_: tuple[str, ...] = (), recursive: bool = False):
    """A query over the default graph; ``sql`` is the final SELECT over the shared tables."""

    def add(f):
        QUERIES[f.__name__] = lambda s, d: f(cut(graphs.event_graph(s, d)))
        if sql is not None:
            ORACLES[f.__name__] = over(GRAPH, *with_, recursive=recursive, then=sql)
        return f

    return add(f) if f else add


def closed_of(e: DataFrame) -> DataFrame:
    """A fixed closed set: users whose number is divisible by 3."""
    return prep.vertices(e).where("cast(id AS bigint) % 3 = 0")


def candidates_of(e: DataFrame) -> DataFrame:
    closed = closed_of(e)
    return prep.boundaries(e, closed).select(F.col("nbr").alias("id")).distinct()


def partition_of(e: DataFrame) -> DataFrame:
    return graphs.stand_in_partition(prep.vertices(e))


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, for comparison across engines."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources and preparation -----------------------------------------------------------------------------------------


@graph(sql="SELECT src, dst FROM e")
def edges_event(e):
    return e


@query("SELECT DISTINCT least('P' || l_partkey, 'S' || l_suppkey) AS src, greatest('P' || l_partkey, 'S' || l_suppkey) AS dst FROM lineitem")
def edges_part_supplier(s, d):
    return graphs.part_supplier(s, d)


@query(over(TRIPARTITE, then="SELECT src, dst FROM e"))
def edges_tripartite(s, d):
    return graphs.tripartite(s, d)


@query(over(GRAPH, then="SELECT CAST(layer AS INTEGER) AS layer, src, dst FROM pl"))
def edges_layers(s, d):
    return graphs.layers(s, d)


@query(over(SPARSE, recursive=True, then="SELECT src, dst FROM e"))
def edges_sparse(s, d):
    return graphs.sparse_graph(s, d)


@query("WITH p AS (SELECT CAST(user_id AS VARCHAR) AS src, CAST(lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS VARCHAR) AS dst FROM events) SELECT count(*) AS pairs, count(*) FILTER (src <> dst) AS kept FROM p WHERE dst IS NOT NULL")
def self_loop_drop(s, d):
    pairs = graphs.consecutive(graphs.table(s, d, "events"))
    return pairs.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("kept"))


@query(over(SPARSE, recursive=True, then="SELECT id, component FROM comp"))
def connected_components(s, d):
    return prep.components(graphs.sparse_graph(s, d))


@query(over(SPARSE, recursive=True, then="SELECT src, dst FROM e WHERE src IN (SELECT id FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))"))
def giant_component(s, d):
    return prep.giant_component(graphs.sparse_graph(s, d))


@graph(sql="SELECT src, dst FROM e WHERE src IN (SELECT id FROM shut) AND dst IN (SELECT id FROM shut)")
def induced_subgraph(e):
    return prep.induced(e, closed_of(e))


@graph(sql="SELECT src, dst FROM e WHERE src IN (SELECT id FROM deg WHERE deg > 24) AND dst IN (SELECT id FROM deg WHERE deg > 24)")
def degree_filtered_subgraph(e):
    return prep.degree_filtered(e, 24)


@graph(sql="SELECT src, dst FROM e, (SELECT min(id) AS v FROM deg) WHERE (src = v OR src IN (SELECT nbr FROM adj WHERE id = v)) AND (dst = v OR dst IN (SELECT nbr FROM adj WHERE id = v))")
def ego_graph(e):
    return prep.ego(e, prep.vertices(e).agg(F.min("id").alias("id")))


@query(over(GRAPH, then="SELECT DISTINCT src, dst FROM pl WHERE layer IN (0, 1)"))
def graph_union(s, d):
    layers = graphs.layers(s, d)
    return prep.compose(layers.where("layer = 0"), layers.where("layer = 1"))


@query(over(GRAPH, then="SELECT id FROM (SELECT layer, src AS id FROM pl UNION SELECT layer, dst FROM pl) GROUP BY id HAVING count(*) = 5"))
def layer_intersection(s, d):
    return prep.common_nodes(graphs.layers(s, d))


@graph(sql="SELECT id, deg FROM deg WHERE id NOT IN (SELECT id FROM shut)")
def map_anti_filter(e):
    return prep.without_keys(prep.degrees(e), closed_of(e))


@query(over(GRAPH, then="SELECT coalesce(r.id, l.id) AS id, coalesce(r.value, l.value) AS value FROM (SELECT id, deg AS value FROM deg) l FULL JOIN (SELECT id, count(*) AS value FROM (SELECT src AS id FROM pl WHERE layer = 1 UNION ALL SELECT dst FROM pl WHERE layer = 1) GROUP BY id) r ON l.id = r.id"))
def map_merge(s, d):
    layers = graphs.layers(s, d)
    one = lambda k: prep.degrees(layers.where(F.col("layer") == k)).withColumnRenamed("deg", "value")
    return prep.merged(one(0), one(1))


@graph(with_=(CLUSTERING,), sql="SELECT id, round(cc, 6) AS value, CASE WHEN cc = 0 THEN 'zero' ELSE 'nonzero' END AS kind, cc < 0.9 AS low FROM cc")
def split_zero(e):
    return r6(prep.split_zero(metrics.local_clustering(e).select("id", F.col("cc").alias("value"))))


@graph(sql="SELECT id FROM deg WHERE deg = (SELECT max(deg) FROM deg)")
def keys_by_value(e):
    deg = prep.degrees(e).withColumnRenamed("deg", "value")
    return deg.join(F.broadcast(deg.agg(F.max("value").alias("value"))), "value", "left_semi").select("id")


@graph(sql=f"SELECT id, deg AS value FROM deg ORDER BY deg DESC, {u_sql(1, 0, 'id')}, id LIMIT 1")
def argmax_random(e):
    return prep.pick_max(prep.degrees(e).withColumnRenamed("deg", "value"))


@graph(sql=f"SELECT id, deg AS value FROM deg ORDER BY deg, {u_sql(1, 0, 'id')}, id LIMIT 1")
def argmin_random(e):
    return prep.pick_min(prep.degrees(e).withColumnRenamed("deg", "value"))


@graph(sql="SELECT DISTINCT id FROM adj WHERE id IN (SELECT id FROM shut) AND nbr NOT IN (SELECT id FROM shut)")
def boundary_nodes(e):
    return prep.boundary_nodes(e, closed_of(e))


@graph(sql="SELECT id, nbr FROM adj WHERE id IN (SELECT id FROM shut) AND nbr NOT IN (SELECT id FROM shut)")
def edge_boundary(e):
    return prep.boundaries(e, closed_of(e))


@graph(sql="SELECT DISTINCT id FROM adj WHERE id NOT IN (SELECT id FROM shut) AND nbr IN (SELECT id FROM shut)")
def connected_outside(e):
    return prep.connected_outside(e, prep.without_keys(prep.vertices(e), closed_of(e)))


@query("WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row_no, 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem), f AS (SELECT \"user\", min(row_no * 2 + side) AS spot FROM (SELECT row_no, 0 AS side, src AS \"user\" FROM r UNION ALL SELECT row_no, 1, dst FROM r) GROUP BY \"user\") SELECT \"user\", row_number() OVER (ORDER BY spot, \"user\") - 1 AS id FROM f")
def id_dictionary(s, d):
    return prep.id_dictionary(graphs.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst")))


# --- access ----------------------------------------------------------------------------------------------------------


@graph(sql="SELECT id, nbr, CAST(1 AS DOUBLE) AS cost FROM adj WHERE id IN (SELECT id FROM shut)")
def neighbors_complete(e):
    return access.neighbours(e, closed_of(e))


@graph(sql=f"SELECT id, nbr, CAST(1 AS DOUBLE) AS cost FROM (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY {u_sql(7, 3, "id || '-' || nbr")}, nbr) AS k FROM adj WHERE id IN (SELECT id FROM shut)) WHERE k <= 5")
def neighbors_partial(e):
    return access.neighbours_partial(e, closed_of(e), 5, seed=7, query_no=3)


@graph(sql="SELECT id, nbr, CAST(1 AS DOUBLE) AS cost, ceil(deg / 5.0) - 1 <= 1 AS last FROM (SELECT adj.id, nbr, deg, row_number() OVER (PARTITION BY adj.id ORDER BY nbr) - 1 AS k FROM adj JOIN deg USING (id) WHERE adj.id IN (SELECT id FROM shut)) WHERE k // 5 = 1")
def neighbors_page(e):
    return access.neighbours_page(e, closed_of(e), page=1, size=5)


@graph(sql="SELECT id, deg, CAST(0.1 AS DOUBLE) AS cost FROM deg WHERE id IN (SELECT id FROM shut)")
def degree_probe_cost(e):
    return access.degree_probe(e, closed_of(e))


@graph(sql=f"SELECT id FROM deg ORDER BY {u_sql(5, 0, 'id')}, id LIMIT 1")
def random_node(e):
    return access.random_node(e, 5)


@graph(sql=f"SELECT id FROM (SELECT id FROM deg ORDER BY deg DESC, id LIMIT (SELECT CAST(floor(n * 0.3) AS BIGINT) FROM nm)) ORDER BY {u_sql(5, 0, 'id')}, id LIMIT 1")
def random_high_degree(e):
    return access.random_high_degree(e, 5)


@query(over(GRAPH, then="SELECT CAST(layer AS INTEGER) AS layer, id, nbr, CASE WHEN layer = 0 THEN 1.0 ELSE 0.2 END::DOUBLE AS cost FROM (SELECT layer, src AS id, dst AS nbr FROM pl UNION ALL SELECT layer, dst, src FROM pl) WHERE id IN (SELECT id FROM shut)"))
def layered_neighbors(s, d):
    return access.layered_neighbours(graphs.layers(s, d), closed_of(graphs.event_graph(s, d)))


@graph(with_=(CLUSTERING,), sql="SELECT id, round(cc, 6) AS cc FROM cc WHERE deg = (SELECT min(deg) FROM deg)")
def far_node_clustering(e):
    cc = metrics.local_clustering(e)
    return r6(cc.join(F.broadcast(cc.agg(F.min("deg").alias("deg"))), "deg", "left_semi").select("id", "cc"))


@graph(sql=f"""SELECT m.id, CAST(CASE WHEN len(list_intersect(m.a, r.a)) > 0 THEN floor(len(m.a) * len(r.a) / len(list_intersect(m.a, r.a))) ELSE 0 END AS INTEGER) AS estimate
FROM (SELECT id, list(nbr) AS a FROM (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY {u_sql(7, 1, "id || '-' || nbr")}, nbr) AS k FROM adj) WHERE k <= 8 GROUP BY id) m
JOIN (SELECT id, list(nbr) AS a FROM (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY {u_sql(7, 2, "id || '-' || nbr")}, nbr) AS k FROM adj) WHERE k <= 8 GROUP BY id) r USING (id)""")
def mark_recapture(e):
    nodes = prep.vertices(e)
    one = lambda q, n: access.neighbours_partial(e, nodes, 8, 7, q).groupBy("id").agg(F.collect_list("nbr").alias(n))
    return one(1, "m").join(one(2, "r"), "id").select("id", access.recaptured_degree(F.col("m"), F.col("r")).alias("estimate"))


@graph(sql="SELECT deg.id, round(CASE WHEN deg = 0 THEN 1.0 ELSE least(1.0, abs(deg - coalesce(o, 0)) / 8.0) END, 6)::DOUBLE AS p FROM deg LEFT JOIN (SELECT id, count(*) AS o FROM adj WHERE nbr IN (SELECT id FROM shut) GROUP BY id) USING (id)")
def selection_prob(e):
    seen = prep.adjacency(e).join(closed_of(e).toDF("nbr"), "nbr", "left_semi").groupBy("id").agg(F.count("*").alias("o"))
    own = prep.degrees(e).join(seen, "id", "left")
    return r6(own.select("id", access.selection_probability(F.col("deg"), F.coalesce("o", F.lit(0)), 8).alias("p")))


@graph(sql="SELECT id, deg AS p FROM deg ORDER BY deg DESC, id LIMIT (SELECT CAST(floor(n * 0.7) AS BIGINT) FROM nm)")
def likely_nodes(e):
    return access.likely(prep.degrees(e).withColumnRenamed("deg", "p"))


# --- metrics ---------------------------------------------------------------------------------------------------------


@graph(sql="SELECT id, deg FROM deg")
def degree(e):
    return prep.degrees(e)


@graph(sql="SELECT round(avg(deg), 6) AS mean, round(median(deg), 6) AS median, round(stddev_pop(deg), 6) AS std FROM deg")
def degree_stats(e):
    return r6(metrics.degree_stats(e))


@graph(with_=(CLUSTERING,), sql="SELECT id, deg, tri, round(cc, 6) AS cc FROM cc")
def local_clustering(e):
    return r6(metrics.local_clustering(e))


@graph(with_=(CLUSTERING,), sql="SELECT round(avg(cc), 6) AS cc FROM cc")
def avg_clustering(e):
    return r6(metrics.average_clustering(e))


@graph(with_=(CLUSTERING,), sql="SELECT round(avg(cc), 6) AS cc FROM cc WHERE id IN (SELECT id FROM shut)")
def avg_clustering_subset(e):
    return r6(metrics.average_clustering(e, closed_of(e)))


@graph(sql="SELECT n, m, round(m / (n * (n - 1) / 2.0), 6) AS density, round((m - (n - 1)) / (n * (n - 1) / 2.0 - (n - 1)), 6) AS tree_density FROM nm")
def density(e):
    return r6(metrics.density(e))


@graph(sql="SELECT id, round(deg / (n - 1.0), 6) AS centrality FROM deg, nm")
def degree_centrality(e):
    return r6(metrics.degree_centrality(e))


@graph(with_=(pagerank(20),), sql="SELECT id, round(rank, 6) AS rank FROM pr20")
def pagerank_20(e):
    return r6(metrics.pagerank(e, 20))


@graph(sql="SELECT adj.id, round(avg(deg), 6) AS nbr_deg FROM adj JOIN deg ON deg.id = adj.nbr GROUP BY adj.id")
def avg_neighbor_degree(e):
    return r6(metrics.neighbour_mean(e, prep.degrees(e).withColumnRenamed("deg", "value"), "nbr_deg"))


@graph(with_=(CLUSTERING,), sql="SELECT adj.id, round(avg(cc), 6) AS nbr_cc FROM adj JOIN cc ON cc.id = adj.nbr GROUP BY adj.id")
def avg_neighbor_cc(e):
    return r6(metrics.neighbour_mean(e, metrics.local_clustering(e).select("id", F.col("cc").alias("value")), "nbr_cc"))


_EGO = "SELECT cc.id, cc.deg + tri AS ego_edges, CAST(cc.deg + sum(deg.deg) - 2 * (cc.deg + tri) AS BIGINT) AS ego_out FROM cc JOIN adj ON adj.id = cc.id JOIN deg ON deg.id = adj.nbr GROUP BY cc.id, cc.deg, tri"


@graph(with_=(CLUSTERING,), sql=_EGO)
def ego_edges(e):
    return metrics.ego_edges(e)


@graph(with_=(CLUSTERING,), sql="SELECT id, round((deg + 1.0) / n, 6) AS nodes, round((deg + tri) / CAST(m AS DOUBLE), 6) AS edges FROM cc, nm")
def ego_coverage(e):
    return r6(metrics.ego_coverage(e))


@graph(sql="SELECT deg, count(*) AS n FROM deg GROUP BY deg")
def degree_hist(e):
    return metrics.degree_histogram(e)


@graph(sql="SELECT deg, n, CAST(sum(n) OVER (ORDER BY deg DESC) - n AS BIGINT) AS above FROM (SELECT deg, count(*) AS n FROM deg GROUP BY deg)")
def degree_ranks(e):
    return metrics.degree_ranks(e)


@graph(with_=(CLUSTERING,), sql="SELECT deg, count(*) AS n, round(avg(cc), 6) AS mean, round(stddev_pop(cc), 6) AS std, round(var_pop(cc), 6) AS var FROM cc GROUP BY deg")
def cc_by_degree(e):
    return r6(metrics.clustering_by_degree(e))


@graph(with_=(CLUSTERING,), sql="SELECT CAST(least(floor(cc * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM cc GROUP BY ALL")
def cc_hist(e):
    return metrics.clustering_histogram(e)


_LEVELS = ",\nlv AS (SELECT id, 0 AS level FROM (SELECT min(id) AS id FROM deg) UNION SELECT a.nbr, lv.level + 1 FROM lv JOIN adj a ON a.id = lv.id WHERE lv.level < 12),\nlvl AS (SELECT id, min(level) AS level FROM lv GROUP BY id)"


@graph(with_=(_LEVELS,), recursive=True, sql="SELECT id, CAST(level AS INTEGER) AS level FROM lvl")
def bfs_levels(e):
    return metrics.bfs_levels(e, prep.vertices(e).agg(F.min("id").alias("id")))


_ECC = """,
ce AS (SELECT p.com, src, dst FROM e JOIN part p ON p.id = src JOIN part q ON q.id = dst WHERE p.com = q.com),
ca AS (SELECT com, src AS id, dst AS nbr FROM ce UNION ALL SELECT com, dst, src FROM ce),
hop AS (SELECT DISTINCT com, id AS root, id, 0 AS level FROM ca UNION SELECT h.com, h.root, ca.nbr, h.level + 1 FROM hop h JOIN ca ON ca.com = h.com AND ca.id = h.id WHERE h.level < 14),
far AS (SELECT com, root, id, min(level) AS level FROM hop GROUP BY com, root, id),
ecc AS (SELECT com, root AS id, CAST(max(level) AS BIGINT) AS ecc, count(*) AS reached FROM far GROUP BY com, root)"""


@graph(with_=(_ECC,), recursive=True, sql="SELECT com, id, ecc, reached FROM ecc")
def eccentricity(e):
    return metrics.eccentricities(e, partition_of(e))


_DIAMETER = ",\nbig AS (SELECT ecc.* FROM ecc JOIN (SELECT com, max(reached) AS reached FROM ecc GROUP BY com) USING (com, reached)),\ndia AS (SELECT com, max(ecc) AS diameter, arg_min(id, (ecc, id)) AS centre FROM big GROUP BY com)"


@graph(with_=(_ECC, _DIAMETER), recursive=True, sql="SELECT com, diameter, centre FROM dia")
def diameter_by_community(e):
    return metrics.diameters(e, partition_of(e))


@graph
def hub_dispersion(e):
    return r6(metrics.dispersion(e, prep.degrees(e).orderBy(F.desc("deg"), "id").limit(2)))


_SHARES = ",\nsh AS (SELECT adj.id, count(*) AS deg, avg(CASE WHEN p.com <> q.com THEN 1.0 ELSE 0.0 END) AS outside, max(CASE WHEN p.com <> q.com THEN 1 ELSE 0 END) AS border, count(DISTINCT q.com) / CAST(count(*) AS DOUBLE) AS diversity FROM adj JOIN part p ON p.id = adj.id JOIN part q ON q.id = adj.nbr GROUP BY adj.id)"


@graph(with_=(_SHARES,), sql="SELECT id, CAST(border AS INTEGER) AS border FROM sh")
def border_label(e):
    return metrics.community_shares(e, partition_of(e)).select("id", "border")


@graph(with_=(_SHARES,), sql="SELECT id, deg, round(outside, 6) AS outside, round(1 - outside, 6) AS inside, round(diversity, 6) AS diversity FROM sh")
def outside_share(e):
    return r6(metrics.community_shares(e, partition_of(e)).drop("border"))


@graph(sql="SELECT inner_ AS inner, outer_ AS outer, round(CASE WHEN outer_ = 0 THEN 1.0 ELSE inner_ / CAST(outer_ AS DOUBLE) END, 6) AS local_r FROM (SELECT (SELECT count(*) FROM e WHERE src IN (SELECT id FROM shut) AND dst IN (SELECT id FROM shut)) AS inner_, (SELECT count(*) FROM adj WHERE id IN (SELECT id FROM shut) AND nbr NOT IN (SELECT id FROM shut)) AS outer_)")
def local_r(e):
    return r6(metrics.boundary_sharpness(e, closed_of(e), ""))


@graph(sql="SELECT p.com, round(avg(CASE WHEN p.com = q.com THEN 1.0 ELSE 0.0 END), 6) AS local_modularity FROM adj JOIN part p ON p.id = adj.id JOIN part q ON q.id = adj.nbr WHERE adj.id IN (SELECT a.id FROM adj a JOIN part x ON x.id = a.id JOIN part y ON y.id = a.nbr WHERE x.com <> y.com) GROUP BY p.com")
def local_modularity(e):
    return r6(metrics.local_modularity(e, partition_of(e)))


@graph(sql="WITH s AS (SELECT id, avg(CASE WHEN nbr IN (SELECT id FROM shut) THEN 1.0 ELSE 0.0 END) AS v FROM adj GROUP BY id) SELECT adj.id, round(avg(v), 6) AS score FROM adj JOIN s ON s.id = adj.nbr GROUP BY adj.id")
def neighbor_score(e):
    return r6(metrics.neighbour_score(e, closed_of(e)))


@graph(with_=(CLUSTERING, pagerank(20)), sql=f"SELECT cc.id, cc.deg, round(cc, 6) AS cc, round(nd, 6) AS nbr_deg, round(nc, 6) AS nbr_cc, ego_edges, ego_out, round(cc.deg / (n - 1.0), 6) AS centrality, round(rank, 6) AS rank FROM cc JOIN (SELECT adj.id, avg(c2.deg) AS nd, avg(c2.cc) AS nc FROM adj JOIN cc c2 ON c2.id = adj.nbr GROUP BY adj.id) USING (id) JOIN ({_EGO}) USING (id) JOIN pr20 USING (id), nm")
def node_features(e):
    return r6(metrics.node_features(e))


@graph(sql="WITH t AS (SELECT id, deg FROM deg ORDER BY deg DESC, id LIMIT (SELECT greatest(1, CAST(floor(n * 0.1) AS BIGINT)) FROM nm)), nd AS (SELECT adj.id, avg(deg) AS nd FROM adj JOIN deg ON deg.id = adj.nbr GROUP BY adj.id), g AS (SELECT abs(deg - CAST(floor(nd) AS BIGINT)) AS gap FROM t JOIN nd USING (id)) SELECT round(avg(gap), 2) AS mean, round(median(gap), 2) AS median FROM g")
def top_degree_gap(e):
    return metrics.top_gap(e, 0.1)


# --- statistics ------------------------------------------------------------------------------------------------------


@graph(with_=(CLUSTERING,), sql="SELECT 'deg' AS x, 'nd' AS y, round(corr(deg, nd), 6) AS r FROM cc JOIN (SELECT adj.id, avg(d.deg) AS nd FROM adj JOIN deg d ON d.id = adj.nbr GROUP BY adj.id) USING (id) UNION ALL SELECT 'deg', 'cc', round(corr(deg, cc), 6) FROM cc UNION ALL SELECT 'cc', 'nd', round(corr(cc, nd), 6) FROM cc JOIN (SELECT adj.id, avg(d.deg) AS nd FROM adj JOIN deg d ON d.id = adj.nbr GROUP BY adj.id) USING (id)")
def degree_correlation(e):
    cc = metrics.local_clustering(e)
    nd = metrics.neighbour_mean(e, prep.degrees(e).withColumnRenamed("deg", "value"), "nd")
    return r6(stats.correlation(cc.join(nd, "id"), ["deg", "cc", "nd"]))


@graph(with_=(CLUSTERING,), sql="WITH t AS (SELECT id, deg AS x, cc AS y FROM cc ORDER BY deg DESC, id LIMIT (SELECT CAST(floor(n * 0.2) AS BIGINT) + 1 FROM nm)) SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / (sqrt(count(*) FILTER (a.x <> b.x)) * sqrt(count(*) FILTER (a.y <> b.y))), 6) AS tau FROM t a JOIN t b ON a.id < b.id")
def kendall_topk(e):
    return r6(stats.kendall_top(metrics.local_clustering(e).select("id", F.col("deg").alias("x"), F.col("cc").alias("y")), 0.2))


@graph(sql="WITH v AS (SELECT DISTINCT deg AS x FROM deg) SELECT round(max(abs((SELECT avg(CASE WHEN deg <= x THEN 1.0 ELSE 0.0 END) FROM deg) - (SELECT avg(CASE WHEN deg <= x THEN 1.0 ELSE 0.0 END) FROM deg WHERE id IN (SELECT id FROM shut)))), 6) AS d FROM v")
def ks_degree(e):
    deg = prep.degrees(e)
    return r6(stats.ks_two_sample(deg.select(F.col("deg").alias("value")), deg.join(closed_of(e), "id", "left_semi").select(F.col("deg").alias("value"))).select("d"))


@graph
def ks_degree_p(e):
    deg = prep.degrees(e)
    return r6(stats.ks_two_sample(deg.select(F.col("deg").alias("value")), deg.join(closed_of(e), "id", "left_semi").select(F.col("deg").alias("value"))))


@graph(sql="SELECT d.id, round((sum(CASE WHEN s.deg < d.deg THEN 1 ELSE 0 END) + sum(CASE WHEN s.deg <= d.deg THEN 1 ELSE 0 END) + max(CASE WHEN s.deg = d.deg THEN 1 ELSE 0 END)) * 50.0 / count(*), 6) AS percentile FROM deg d, (SELECT deg FROM deg WHERE id IN (SELECT id FROM shut)) s GROUP BY d.id")
def percentile_of_degree(e):
    deg = prep.degrees(e)
    return r6(stats.percentile_of(deg.select("id", F.col("deg").alias("x")), deg.join(closed_of(e), "id", "left_semi").select(F.col("deg").alias("value"))))


@graph(sql="WITH t AS (SELECT id FROM part WHERE com = 0), x AS (SELECT (SELECT count(*) FROM shut) AS nf, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM shut WHERE id IN (SELECT id FROM t)) AS hit) SELECT round(hit / CAST(nf AS DOUBLE), 6) AS precision, round(hit / CAST(nt AS DOUBLE), 6) AS recall, round(2.0 * hit / (nf + nt), 6) AS f1 FROM x")
def precision_recall_f1(e):
    return r6(stats.precision_recall(closed_of(e), partition_of(e).where("com = 0")))


@graph(sql="WITH a AS (SELECT id FROM part WHERE com = 0), b AS (SELECT id FROM deg WHERE CAST(id AS BIGINT) % 2 = 0) SELECT round((SELECT count(*) FROM b WHERE id IN (SELECT id FROM a)) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS s1, round((SELECT count(*) FROM b WHERE id IN (SELECT id FROM a)) / CAST((SELECT count(*) FROM a) AS DOUBLE), 6) AS s2, round((SELECT count(*) FROM b WHERE id IN (SELECT id FROM shut)) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS s3, round((SELECT count(*) FROM b WHERE id IN (SELECT id FROM shut)) / CAST((SELECT count(*) FROM shut) AS DOUBLE), 6) AS s4")
def overlap_scores(e):
    nodes = prep.vertices(e)
    return r6(stats.overlap_scores(partition_of(e).where("com = 0"), nodes.where("cast(id AS bigint) % 2 = 0"), closed_of(e)))


@query(over(GRAPH, then="SELECT CAST(layer AS INTEGER) AS layer, round(avg(d), 6) AS mean_deg, round(stddev_pop(d), 6) AS std_deg FROM (SELECT layer, id, count(*) AS d FROM (SELECT layer, src AS id FROM pl UNION ALL SELECT layer, dst FROM pl) GROUP BY layer, id) GROUP BY layer"))
def summary_by_layer(s, d):
    deg = graphs.layers(s, d).select("layer", F.explode(F.array("src", "dst")).alias("id")).groupBy("layer", "id").agg(F.count("*").alias("deg"))
    return r6(stats.summary(deg, ["layer"], ["deg"]))


@query("SELECT CAST(floor(log10(c) / 0.1) AS BIGINT) AS bin, count(*) AS n, round(avg(c), 6) AS mean FROM (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) GROUP BY 1")
def log_histogram(s, d):
    return r6(stats.histogram(graphs.table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("c")), "c", 0.1, log=True))


@graph(sql="SELECT round(sum(1.0) / sum(1.0 / deg), 6) AS estimate FROM deg WHERE id IN (SELECT id FROM shut)")
def harmonic_mean_degree(e):
    return r6(stats.harmonic_mean_degree(prep.degrees(e).join(closed_of(e), "id", "left_semi")))


_OBS = "SELECT id, count(*) AS obs FROM adj WHERE nbr IN (SELECT id FROM shut) AND id IN (SELECT id FROM cand) GROUP BY id"


@graph(sql=f"WITH x AS (SELECT id, deg - obs AS value FROM deg JOIN ({_OBS}) USING (id)), r AS (SELECT id, value, rank() OVER (ORDER BY value DESC) - 1 AS r0, count(*) OVER (PARTITION BY value) AS n FROM x) SELECT id, round((r0 + (n - 1) / 2.0) / (SELECT count(*) FROM x), 6) AS rank FROM r")
def excess_rank(e):
    obs = prep.boundaries(e, closed_of(e)).groupBy(F.col("nbr").alias("id")).agg(F.count("*").alias("obs"))
    return r6(stats.excess_rank(prep.degrees(e).join(obs, "id").select("id", (F.col("deg") - F.col("obs")).alias("value"))))


# --- communities and oracle ------------------------------------------------------------------------------------------


@graph(sql="SELECT round(sum(i / (2.0 * m) - (d / (2.0 * m)) * (d / (2.0 * m))), 6) AS modularity FROM (SELECT p.com, count(*) AS d, count(*) FILTER (p.com = q.com) AS i FROM adj JOIN part p ON p.id = adj.id JOIN part q ON q.id = adj.nbr GROUP BY p.com), nm")
def modularity(e):
    return r6(community.modularity(e, partition_of(e)))


@graph(sql="SELECT CAST(least(p.com, q.com) AS INTEGER) AS src, CAST(greatest(p.com, q.com) AS INTEGER) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM e JOIN part p ON p.id = src JOIN part q ON q.id = dst GROUP BY ALL")
def induced_community_graph(e):
    return community.induced_graph(e, partition_of(e))


@graph(sql="SELECT com, count(*) AS members FROM part GROUP BY com")
def community_sizes(e):
    return community.sizes(partition_of(e))


@graph(sql="SELECT id, CAST(dense_rank() OVER (ORDER BY com * 7 % 11) - 1 AS INTEGER) AS com FROM part")
def renumber(e):
    return community.renumber(partition_of(e).select("id", (F.col("com") * 7 % 11).alias("com"))).select("id", F.col("com").cast("int").alias("com"))


_SEEN = "(SELECT id FROM shut UNION SELECT id FROM cand)"


def seen_of(e: DataFrame) -> DataFrame:
    return closed_of(e).union(candidates_of(e)).distinct()


@graph(sql=f"SELECT com, round(count(*) FILTER (id NOT IN {_SEEN}) / CAST((SELECT n FROM nm) AS DOUBLE), 6) AS gain FROM part GROUP BY com")
def community_gain(e):
    return r6(oracle.remaining_gain(partition_of(e), seen_of(e)))


@graph(with_=(_ECC, _DIAMETER), recursive=True, sql="SELECT com, round((SELECT count(*) FROM part p WHERE p.com = dia.com AND p.id NOT IN (SELECT id FROM shut)) / CAST((SELECT n FROM nm) AS DOUBLE) / diameter, 6) AS score FROM dia WHERE diameter > 0")
def community_score(e):
    com = partition_of(e)
    return r6(oracle.community_scores(oracle.remaining_gain(com, closed_of(e)), metrics.diameters(e, com)))


@graph(with_=(_ECC, _DIAMETER, ",\nctr AS (SELECT centre, diameter FROM dia WHERE com = 0),\nlv AS (SELECT centre AS id, 0 AS level FROM ctr UNION SELECT a.nbr, lv.level + 1 FROM lv JOIN adj a ON a.id = lv.id WHERE lv.level < 12),\nnr AS (SELECT c.id, greatest(min(lv.level) - max(diameter) / 2.0, 0.0) AS far FROM cand c JOIN lv ON lv.id = c.id, ctr GROUP BY c.id),\nfi AS (SELECT id, far FROM nr ORDER BY far, id LIMIT 1)"), recursive=True, sql="SELECT id, CAST(far AS DOUBLE) AS far, round((SELECT count(*) FROM cand, fi f WHERE f.far > 0 OR cand.id <= f.id) * 0.05, 6)::DOUBLE AS cost FROM fi")
def oracle_expansion(e):
    target = metrics.diameters(e, partition_of(e)).where("com = 0").select("centre", "diameter")
    return r6(oracle.expansion(e, candidates_of(e), target).withColumn("far", F.col("far").cast("double")).withColumn("cost", F.col("cost").cast("double")))


@graph(sql="WITH o AS (SELECT adj.id, count(*) AS out_ FROM adj JOIN part p ON p.id = adj.id JOIN part q ON q.id = adj.nbr WHERE p.com <> q.com AND adj.nbr NOT IN (SELECT id FROM shut) GROUP BY adj.id) SELECT cand.id, round(coalesce(out_, 0) * (SELECT count(*) FROM part q WHERE q.com = p.com) / CAST((SELECT n FROM nm) AS DOUBLE) / ((SELECT count(*) FROM shut JOIN part s ON s.id = shut.id WHERE s.com = p.com) + 1), 6) AS score FROM cand JOIN part p ON p.id = cand.id LEFT JOIN o ON o.id = cand.id")
def oracle_expansion_by_share(e):
    com = partition_of(e)
    visits = closed_of(e).join(com, "id").groupBy("com").agg(F.count("*").alias("visits"))
    return r6(oracle.expansion_by_share(e, com, closed_of(e), candidates_of(e), visits))


@graph(sql=f"SELECT id, n_new, CAST(cost AS DOUBLE) AS cost FROM (SELECT cand.id, (SELECT count(*) FROM adj WHERE adj.id = cand.id AND nbr NOT IN (SELECT id FROM shut)) AS n_new, round((SELECT count(*) FROM cand) * 0.01, 6) AS cost FROM cand) ORDER BY n_new DESC, {u_sql(1, 0, 'id')}, id LIMIT 1")
def oracle_densification(e):
    return r6(oracle.densification(e, closed_of(e), candidates_of(e)).withColumn("cost", F.col("cost").cast("double")))


@graph(sql="SELECT com, count(*) FILTER (id NOT IN (SELECT id FROM shut)) / CAST((SELECT n FROM nm) AS DOUBLE) >= 0.05 AS good, round(count(*) / CAST(nullif(count(*) FILTER (id NOT IN (SELECT id FROM shut)), 0) AS DOUBLE), 6) AS size_over_unobserved FROM part GROUP BY com")
def cluster_tests(e):
    return r6(oracle.cluster_tests(partition_of(e), closed_of(e)))


@graph
def louvain(e):
    return community.louvain(e)
