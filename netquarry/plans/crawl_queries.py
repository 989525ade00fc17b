"""Crawl, incomplete-access, replay, simulation, generator and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import u_sql
from netquarry.operators import access, community, crawl, grouped, learn, lfr, local, metrics, prep, replay, simulate, stats
from netquarry.plans.graph_queries import ORACLES as _BASE
from netquarry.plans.graph_queries import closed_of, partition_of, r6
from netquarry.plans.sql import CLUSTERING, GRAPH, over
from netquarry.sources import graphs

QUERIES, ORACLES = {}, {}
STEPS, SEED = 5, 1


def add(f, sql=None, name=None):
    QUERIES[name or f.__name__] = f
    if sql is not None:
        ORACLES[name or f.__name__] = sql
    return f


def graph(s, d):
    return cut(graphs.event_graph(s, d))


def one_run(s, seed=SEED):
    return s.createDataFrame([("r", seed)], "run string, seed int")


# --- unrolled crawls -------------------------------------------------------------------------------------------------

#: rule -> (order over o(id, obs, first, cash) and deg, restriction)
_ORDER = {
    "random": "", "mod": "obs DESC,", "med": "deg - obs DESC,", "cheat": "deg DESC,", "ratio": "obs / CAST(deg AS DOUBLE) DESC,", "cash": "round(cash, 9) DESC,",
    "opic": "round(opic, 9) DESC,", "bfs": f"first, {u_sql(SEED, 'first', 'o.id')},", "sb": f"first, {u_sql(SEED, 'first', 'o.id')},",
}


def _chosen(rule: str, t: int, seed: int) -> tuple[str, str, str]:
    """Tables, source of candidates and order of a rule's choice after step t."""
    order, source, before = _ORDER.get(rule, ""), f"(SELECT o.*, deg FROM o{t} o JOIN deg USING (id)) o", ""
    if rule == "k_rank":
        ranked = f"SELECT o.*, deg, row_number() OVER (ORDER BY deg - obs DESC, {u_sql(seed, t, 'o.id')}, o.id) AS k, floor(count(*) OVER () * CAST(0.1 AS DOUBLE)) AS cut FROM o{t} o JOIN deg USING (id)"
        source = f"(SELECT * FROM ({ranked}) WHERE k = 1 OR (cut > 2 AND k <= cut)) o"
    elif rule == "degree_gap":
        before = f",\nm{t} AS (SELECT avg(deg) AS mean FROM deg JOIN c{t} USING (id))"
        order = f"obs < (SELECT mean FROM m{t}), obs - (SELECT mean FROM m{t}) DESC,"
    elif rule == "max_score" and t > 10:
        before = f",\nb{t} AS (SELECT DISTINCT nbr FROM adj WHERE id IN (SELECT id FROM c{t} JOIN deg USING (id) ORDER BY deg DESC, id LIMIT 10))"
        order = f"o.id IN (SELECT nbr FROM b{t}) DESC,"
    elif rule == "unobserved":
        before = f",\nf{t} AS (SELECT id, count(*) AS fresh FROM adj WHERE id IN (SELECT id FROM o{t}) AND nbr NOT IN (SELECT id FROM c{t} UNION SELECT id FROM o{t}) GROUP BY id)"
        source = f"(SELECT o.*, coalesce(fresh, 0) AS fresh FROM o{t} o LEFT JOIN f{t} USING (id)) o"
        order = "fresh DESC,"
    return before, source, order


def crawl_sql(rule: str, steps: int = STEPS, seed: int = SEED) -> str:
    """The trace of one run, one table per step."""
    out = [f",\nc1 AS MATERIALIZED (SELECT 1 AS step, id, CAST(0 AS BIGINT) AS obs, CAST(1 AS DOUBLE) AS opic FROM deg ORDER BY {u_sql(seed, 0, 'id')}, id LIMIT 1)"]
    for t in range(1, steps):
        out.append(f",\no{t} AS MATERIALIZED (SELECT nbr AS id, count(*) AS obs, min(step) AS first, 1 + sum(1.0 / d.deg) AS cash, 1 + sum(c{t}.opic / d.deg) AS opic FROM adj JOIN c{t} ON adj.id = c{t}.id JOIN deg d ON d.id = adj.id WHERE nbr NOT IN (SELECT id FROM c{t}) GROUP BY nbr)")
        queued = ""
        if rule == "sb":
            # A node was queued by the step that found it, if it was in the first half of that answer's new nodes.
            out.append(f",\nh{t} AS MATERIALIZED (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {u_sql(seed, t, 'id')}, id) AS k, count(*) OVER () AS n FROM o{t} WHERE first = {t}) WHERE k <= ceil(n / 2.0)" + (f" UNION ALL SELECT id FROM h{t - 1}" if t > 1 else "") + ")")
            queued = f"WHERE o.id IN (SELECT id FROM h{t})"
        before, source, order = _chosen(rule, t, seed)
        out.append(before + f",\nc{t + 1} AS MATERIALIZED (SELECT * FROM c{t} UNION ALL (SELECT {t + 1}, o.id, o.obs, o.opic FROM {source} {queued} ORDER BY {order} {u_sql(seed, t, 'o.id')}, o.id LIMIT 1))")
    out.append(f",\nshown AS (SELECT id, min(step) AS step FROM (SELECT id, step FROM c{steps} UNION ALL SELECT nbr, step FROM adj JOIN c{steps} c ON c.id = adj.id) GROUP BY id)")
    out.append(f",\nlinks AS (SELECT least(adj.id, nbr) AS a, greatest(adj.id, nbr) AS b, min(step) AS step FROM adj JOIN c{steps} c ON c.id = adj.id GROUP BY ALL)")
    then = f"SELECT 'r' AS run, CAST(step AS INTEGER) AS step, id, obs, (SELECT count(*) FROM shown s WHERE s.step <= c.step) AS nodes, (SELECT count(*) FROM links l WHERE l.step <= c.step) AS edges FROM c{steps} c"
    return over(GRAPH, *out, then=then)


def _traced(rule, steps=STEPS):
    return lambda s, d: crawl.crawl(graph(s, d), one_run(s), rule, steps)


for _rule, _name in (("bfs", "bfs_trace"), ("sb", "snowball_trace"), ("random", "random_trace"), ("mod", "mod_trace"), ("med", "med_trace"), ("cash", "cash_trace"), ("cheat", "cheat_trace"), ("ratio", "ratio_trace")):
    add(_traced(_rule), crawl_sql(_rule), _name)
for _rule, _steps in (("opic", STEPS), ("k_rank", STEPS), ("degree_gap", STEPS), ("max_score", 13), ("unobserved", STEPS)):
    add(_traced(_rule, _steps), crawl_sql(_rule, _steps), f"{_rule}_trace")


def walk_sql(hops: int = 6) -> str:
    out = [f",\nw1 AS MATERIALIZED (SELECT 1 AS step, id FROM deg ORDER BY {u_sql(SEED, 0, 'id')}, id LIMIT 1)"]
    for t in range(1, hops):
        out.append(f",\nw{t + 1} AS MATERIALIZED (SELECT {t + 1} AS step, nbr AS id FROM adj WHERE id = (SELECT id FROM w{t}) ORDER BY {u_sql(SEED, t, 'nbr')}, nbr LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT * FROM w{t}" for t in range(1, hops + 1))
    return over(GRAPH, *out, then=f"SELECT 'r' AS run, CAST(step AS INTEGER) AS step, id, step = min(step) OVER (PARTITION BY id) AS charged FROM ({every})")


add(lambda s, d: crawl.walk(graph(s, d), one_run(s), 6), walk_sql(), "rw_trace")


def tenth(e) -> float:
    """A budget of a tenth of the nodes, five at least."""
    return float(max(5, int(0.1 * prep.vertices(e).count())))


def mod_curve(s, d):
    """Budget curve of the maximum-observed-degree crawl with a budget of a tenth of the nodes, five at least."""
    e = prep.giant_component(graph(s, d))
    if e.limit(grouped.MAX_EDGES + 1).count() > grouped.MAX_EDGES:
        return crawl.crawl(e, one_run(s), "mod", int(tenth(e))).select("run", "step", "nodes", "edges")
    return grouped.crawl_all(e, ["mod"], 1, tenth(e), seed=SEED).select(F.lit("r").alias("run"), "step", "nodes", "edges")


#: Steps that the SQL of a budget of a tenth of the nodes is unrolled to: enough for 160 nodes.
TENTH_STEPS = 16


def tenth_sql(rule: str, columns: str, then: str = "", seed: int = SEED) -> str:
    """``columns`` of the rule's trace t, cut at a tenth of the nodes."""
    head, _, last = crawl_sql(rule, TENTH_STEPS, seed).rpartition("\nSELECT 'r' AS run")
    return head + ",\ntr AS (SELECT 'r' AS run" + last + f")\nSELECT {columns} FROM tr t WHERE step <= (SELECT greatest(5, floor(count(*) * CAST(0.1 AS DOUBLE))) FROM deg){then}"


add(mod_curve, tenth_sql("mod", "run, step, nodes, edges"))


def grouped_sql(rule: str, trials: int = 2) -> str:
    """The traces of a grouped crawler; a trial's seed is its number more."""
    return "\nUNION ALL\n".join(f"SELECT * FROM ({tenth_sql(rule, f"'{rule}' AS algo, CAST({t} AS INTEGER) AS trial, step, CAST(step AS DOUBLE) AS cost, id AS node, CAST(obs AS INTEGER) AS obs, CAST(0 AS DOUBLE) AS score, nodes, edges", seed=SEED + t)})" for t in range(trials))


def _grouped(algos, trials=2, **kw):
    return lambda s, d: r6(grouped.crawl_all((e := graph(s, d)), algos, trials, tenth(e), **kw))


for _a in ("opic", "pagerank", "vmab", "exp_den", "dense_ex", "hybrid", "k_rank", "max_score", "degree_gap", "quartile", "unobserved", "percentile", "escalating"):
    add(_grouped([_a]), grouped_sql(_a) if _a in ("opic", "k_rank", "max_score", "degree_gap", "unobserved") else None, f"crawl_{_a}")
add(_grouped(["exp_den_0.2", "exp_den_0.5", "exp_den_0.7"]), None, "threshold_sweep")
add(_grouped(["rw_teleport", "rw_mixed", "rw_clustered"]), None, "walk_variants")
add(_grouped(["mod"], limit=5, incomplete=True), None, "incomplete_mod")
add(_grouped(["bfs"], limit=5, paged=True, incomplete=True), None, "incomplete_bfs")
add(_grouped(["random", "med", "opic"], limit=5, incomplete=True), None, "incomplete_others")


def grouped_mod(s, d):
    """The grouped executor's trace of the same run as ``mod_trace``."""
    rows = grouped.crawl_all(graph(s, d), ["mod"], 1, STEPS, seed=SEED)
    return rows.select(F.lit("r").alias("run"), "step", F.col("node").alias("id"), F.col("obs").cast("long").alias("obs"), "nodes", "edges")


add(grouped_mod, crawl_sql("mod"))


def budget_curve(s, d):
    return grouped.budget_curve(grouped.crawl_all((e := graph(s, d)), ["med", "mod", "rw", "bfs", "sb", "random", "opic"], 2, tenth(e)), 5)


add(budget_curve)

_OPEN = "SELECT adj.id, count(*) AS obs FROM adj WHERE nbr IN (SELECT id FROM shut) AND id NOT IN (SELECT id FROM shut) GROUP BY adj.id"


def _open(e):
    return prep.boundaries(e, closed_of(e)).groupBy(F.col("nbr").alias("id")).agg(F.count("*").alias("obs"))


add(lambda s, d: crawl.densification_candidates(_open(graph(s, d))), over(GRAPH, then=f"SELECT id, obs FROM ({_OPEN}) ORDER BY obs DESC, id LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM ({_OPEN}))"), "den_candidates")


def exp_candidates(s, d):
    e = graph(s, d)
    return r6(crawl.expansion_candidates(metrics.local_clustering(e).join(_open(e), "id").select("id", F.round("cc", 6).alias("cc"))))


add(exp_candidates, over(GRAPH, CLUSTERING, then=f"SELECT id, round(cc, 6) AS cc FROM cc WHERE id IN (SELECT id FROM ({_OPEN})) ORDER BY round(cc, 6), id LIMIT 15"))


def den_choice(s, d):
    e = graph(s, d)
    own = metrics.local_clustering(e).join(_open(e), "id").select("id", F.col("obs").alias("deg"), "cc")
    return r6(crawl.densification_choice(own, SEED, 1))


add(den_choice, over(GRAPH, CLUSTERING, then=f"WITH x AS (SELECT id, obs, cc FROM ({_OPEN}) JOIN cc USING (id)), l AS (SELECT min(obs) AS lo, max(obs) AS hi, count(*) AS n FROM x) SELECT id, round(score, 6) AS score FROM (SELECT id, CAST(CASE WHEN n > 10 THEN (CASE WHEN hi > lo THEN (obs - lo) / CAST(hi - lo AS DOUBLE) ELSE obs END) * (1 - cc) ELSE obs END AS DOUBLE) AS score FROM x, l) ORDER BY round(score, 9) DESC, {u_sql(SEED, 1, 'id')}, id LIMIT 1"))



def _scored(s, d):
    e = graph(s, d)
    t = crawl.crawl(e, one_run(s), "mod", STEPS).join(prep.degrees(e), "id")
    from pyspark.sql import Window

    prev = F.lag("nodes").over(Window.partitionBy("run").orderBy("step"))
    return t.withColumn("new", F.col("nodes") - F.coalesce(prev, F.lit(0)))


def _score_sql(x: str) -> str:
    base = crawl_sql("mod")
    head, _, last = base.rpartition("\nSELECT 'r' AS run")
    return head + ",\ntr AS (SELECT 'r' AS run" + last + "),\nnx AS (SELECT tr.*, deg.deg, nodes - coalesce(lag(nodes) OVER (ORDER BY step), 0) AS new FROM tr JOIN deg USING (id)),\n" + f"xs AS (SELECT step, coalesce(({x}) / CAST(nullif(deg - obs, 0) AS DOUBLE), 0) AS x FROM nx)\nSELECT 'r' AS run, a.step, round(sum(b.x * pow(0.5, a.step - b.step)), 6) AS score FROM xs a JOIN xs b ON b.step <= a.step GROUP BY a.step"


add(lambda s, d: r6(crawl.densification_score(_scored(s, d)).select("run", "step", "score")), _score_sql("new"), "den_scores")
add(lambda s, d: r6(crawl.expansion_score(_scored(s, d)).select("run", "step", "score")), _score_sql("deg - new - obs"), "exp_scores")


def ks_degree_p_sql() -> str:
    return over(GRAPH, then="WITH c AS (SELECT deg FROM deg WHERE id IN (SELECT id FROM shut)), x AS (SELECT max(abs((SELECT avg(CASE WHEN deg <= v THEN 1.0 ELSE 0.0 END) FROM c) - (SELECT avg(CASE WHEN deg <= v THEN 1.0 ELSE 0.0 END) FROM deg))) AS d, (SELECT count(*) FROM c) AS n FROM (SELECT DISTINCT deg AS v FROM deg)) SELECT round(d, 6) AS d, round(" + _SERIES.format(d="d", n="n", m="(SELECT n FROM nm)") + ", 6) AS p FROM x")


def window_yield(s, d):
    return crawl.window_yield(crawl.crawl(graph(s, d), one_run(s), "mod", STEPS).select("run", "step", "nodes"), 2)


_head, _, _last = crawl_sql("mod").rpartition("\nSELECT 'r' AS run")
add(window_yield, _head + ",\ntr AS (SELECT 'r' AS run" + _last + "),\nnx AS (SELECT run, step, nodes - coalesce(lag(nodes) OVER (ORDER BY step), 0) AS new FROM tr)\nSELECT run, step, new, CAST(sum(new) OVER (ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS now, CAST(coalesce(sum(new) OVER (ORDER BY step ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), 0) AS BIGINT) AS before FROM nx")

add(lambda s, d: crawl.top_hubs((e := graph(s, d)), partition_of(e)), over(GRAPH, then="SELECT com, id, deg FROM (SELECT com, id, deg, row_number() OVER (PARTITION BY com ORDER BY deg DESC, id) AS k, count(*) OVER (PARTITION BY com) AS n FROM deg JOIN part USING (id)) WHERE k <= greatest(1, floor(0.1 * n))"), "community_hubs")


def cheap_estimate(s, d):
    e = graph(s, d)
    cheap = graphs.layers(s, d).where("layer = 1").select("src", "dst")
    return crawl.cheap_estimate(cheap, _open(e), closed_of(e))


_CHEAP = "(SELECT src AS id, dst AS nbr FROM pl WHERE layer = 1 UNION ALL SELECT dst, src FROM pl WHERE layer = 1)"
add(cheap_estimate, over(GRAPH, then=f"SELECT o.id, count(c.nbr) AS n FROM ({_OPEN}) o LEFT JOIN (SELECT * FROM {_CHEAP} WHERE nbr NOT IN (SELECT id FROM shut)) c ON c.id = o.id GROUP BY o.id"))


def cheap_choice(s, d):
    e = graph(s, d)
    cheap = prep.degrees(graphs.layers(s, d).where("layer = 1").select("src", "dst"))
    return r6(crawl.cheap_choice(metrics.local_clustering(e).select("id", "deg", "cc"), cheap, 10))


add(cheap_choice, over(GRAPH, CLUSTERING, then=f"WITH x AS (SELECT cc.id, deg, cc, c.n AS cheap FROM cc LEFT JOIN (SELECT id, count(*) AS n FROM {_CHEAP} GROUP BY id) c USING (id)), l AS (SELECT min(deg) AS lo, max(deg) AS hi, max(cheap) AS top FROM x) SELECT id, round(score, 6) AS score FROM (SELECT id, (deg - lo) / CAST(hi - lo AS DOUBLE) * (1 - cc) + coalesce(cheap / CAST(top AS DOUBLE), 0) AS score FROM x, l) ORDER BY round(score, 9) DESC, id LIMIT 10"))


def page_probability(s, d):
    """H2-H4, H6 as expressions over a table of page states."""
    e = graph(s, d)
    own = prep.degrees(e).join(_open(e), "id")
    p = access.selection_probability(F.col("deg"), F.col("obs"), 8)
    last = F.col("obs") + 4 >= F.col("deg")
    return r6(own.select("id", access.revisit_probability(p, F.lit(50.0), F.lit(20.0)).alias("p"), access.closes(F.col("obs"), F.col("deg"), last).alias("closes"), access.next_page(F.lit(2), last).alias("page")))


add(page_probability, over(GRAPH, then=f"SELECT id, round(least(1.0, abs(deg - obs) / 8.0) * 0.6, 6)::DOUBLE AS p, obs = deg OR obs + 4 >= deg AS closes, CASE WHEN obs + 4 >= deg THEN 2 ELSE 3 END AS page FROM deg JOIN ({_OPEN}) USING (id)"))

# --- replay ----------------------------------------------------------------------------------------------------------

#: A logged crawl: users in order of their numbers, two runs.
_ORDERS = ",\nord AS (SELECT CAST(CAST(id AS BIGINT) % 2 AS INTEGER) AS run, CAST(row_number() OVER (PARTITION BY CAST(id AS BIGINT) % 2 ORDER BY CAST(id AS BIGINT)) - 1 AS INTEGER) AS step, id FROM deg),\nshown AS (SELECT run, id, min(step) AS step FROM (SELECT run, id, step FROM ord UNION ALL SELECT run, nbr, step FROM ord JOIN adj USING (id)) GROUP BY run, id)"


def _orders(e):
    from pyspark.sql import Window

    n = F.col("id").cast("long")
    run = (n % 2).cast("int")
    return prep.vertices(e).select(run.alias("run"), (F.row_number().over(Window.partitionBy(run).orderBy(n)) - 1).alias("step"), "id")


add(lambda s, d: replay.new_nodes((e := graph(s, d)), _orders(e), 5), over(GRAPH, _ORDERS, then="SELECT run, step, (SELECT count(*) FROM shown s WHERE s.run = o.run AND s.step = o.step) AS new FROM ord o WHERE step % 5 = 0"), "replay_new_nodes")
add(lambda s, d: r6(replay.community_coverage((e := graph(s, d)), _orders(e), partition_of(e))), over(GRAPH, _ORDERS, then="SELECT o.run, o.step, p.com, round((SELECT count(*) FROM shown s JOIN part q ON q.id = s.id WHERE s.run = o.run AND q.com = p.com AND s.step <= o.step) / CAST((SELECT count(*) FROM part q WHERE q.com = p.com) AS DOUBLE), 6) AS coverage FROM ord o JOIN part p USING (id)"), "replay_coverage")
#: The asymptotic series of the two-sample test with sizes n and m.
_SERIES = "(SELECT CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam))))) END FROM (SELECT (s + 0.12 + 0.11 / s) * {d} AS lam FROM (SELECT sqrt({n} * {m} / CAST({n} + {m} AS DOUBLE)) AS s)))"
_PREFIXES = """WITH l AS (SELECT run, least(id, nbr) AS a, greatest(id, nbr) AS b, min(step) AS step FROM ord JOIN adj USING (id) GROUP BY ALL),
mk AS (SELECT DISTINCT run, step AS mark FROM ord WHERE step % 5 = 0),
lm AS MATERIALIZED (SELECT l.run, mark, a, b FROM l JOIN mk ON mk.run = l.run AND l.step <= mark),
dn AS (SELECT run, mark, id, count(*) AS d FROM (SELECT run, mark, a AS id FROM lm UNION ALL SELECT run, mark, b FROM lm) GROUP BY ALL),
tr AS (SELECT x.run, x.mark, x.a AS p, x.b AS q, y.b AS r FROM lm x JOIN lm y ON x.run = y.run AND x.mark = y.mark AND x.b = y.a JOIN lm z ON z.run = x.run AND z.mark = x.mark AND z.a = x.a AND z.b = y.b),
tn AS (SELECT run, mark, id, count(*) AS t FROM (SELECT run, mark, p AS id FROM tr UNION ALL SELECT run, mark, q FROM tr UNION ALL SELECT run, mark, r FROM tr) GROUP BY ALL),
nd AS MATERIALIZED (SELECT dn.run, dn.mark, dn.id, d, CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END AS cc, coalesce(o.step <= dn.mark, false) AS shut_ FROM dn LEFT JOIN tn USING (run, mark, id) LEFT JOIN ord o ON o.run = dn.run AND o.id = dn.id),
v AS (SELECT d AS v FROM nd UNION SELECT deg FROM deg),
k AS (SELECT run, mark, v, avg(CASE WHEN d <= v THEN 1.0 ELSE 0.0 END) AS f, avg(CASE WHEN d <= v THEN 1.0 ELSE 0.0 END) FILTER (shut_) AS fc FROM nd, v GROUP BY ALL),
g AS (SELECT v, avg(CASE WHEN deg <= v THEN 1.0 ELSE 0.0 END) AS f0 FROM deg, v GROUP BY v),
ks AS (SELECT run, mark, max(abs(f - f0)) AS d, max(abs(fc - f0)) AS d_c FROM k JOIN g USING (v) GROUP BY run, mark),
pr AS (SELECT run, mark, count(*) AS nodes, avg(d) AS mean_deg, avg(cc) AS mean_cc, count(*) FILTER (shut_) AS closed, avg(d) FILTER (shut_) AS mean_deg_c, avg(cc) FILTER (shut_) AS mean_cc_c FROM nd GROUP BY run, mark)
SELECT run, mark AS step, nodes, round(mean_deg, 6) AS mean_deg, round(mean_cc, 6) AS mean_cc, round(d, 6) AS d, round(""" + _SERIES.format(d="d", n="nodes", m="(SELECT n FROM nm)") + """, 6) AS p,
  closed, round(mean_deg_c, 6) AS mean_deg_c, round(mean_cc_c, 6) AS mean_cc_c, round(d_c, 6) AS d_c, round(""" + _SERIES.format(d="d_c", n="closed", m="(SELECT n FROM nm)") + """, 6) AS p_c FROM pr JOIN ks USING (run, mark)"""
ORACLES["ks_degree_p"] = ks_degree_p_sql()
add(lambda s, d: r6(replay.properties((e := graph(s, d)), _orders(e), 5)), over(GRAPH, _ORDERS, then=_PREFIXES), "replay_properties")


def replay_properties_by_graph(s, d):
    """I4: each run against its own graph (the first two layers)."""
    e = cut(graphs.layers(s, d).where("layer < 2").select(F.col("layer").alias("graph"), "src", "dst"))
    return r6(replay.properties(e, _orders(e.select("src", "dst").distinct()).withColumn("graph", F.col("run")), 25).select("graph", "run", "step", "nodes", "mean_deg", "closed"))


add(replay_properties_by_graph, over(GRAPH, ",\nboth_ AS (SELECT layer AS graph, src AS id, dst AS nbr FROM pl WHERE layer < 2 UNION ALL SELECT layer, dst, src FROM pl WHERE layer < 2),\nord AS (SELECT CAST(CAST(id AS BIGINT) % 2 AS INTEGER) AS run, CAST(row_number() OVER (PARTITION BY CAST(id AS BIGINT) % 2 ORDER BY CAST(id AS BIGINT)) - 1 AS INTEGER) AS step, id FROM (SELECT DISTINCT id FROM both_))", then="WITH l AS (SELECT run, least(o.id, nbr) AS a, greatest(o.id, nbr) AS b, min(step) AS step FROM ord o JOIN both_ b ON b.graph = o.run AND b.id = o.id GROUP BY ALL), mk AS (SELECT DISTINCT run, step AS mark FROM ord WHERE step % 25 = 0), dn AS (SELECT run, mark, id, count(*) AS d FROM (SELECT l.run, mark, unnest([a, b]) AS id FROM l JOIN mk ON mk.run = l.run AND l.step <= mark) GROUP BY ALL) SELECT CAST(dn.run AS INTEGER) AS graph, dn.run, mark AS step, count(*) AS nodes, round(avg(d), 6) AS mean_deg, count(*) FILTER (o.step <= mark) AS closed FROM dn LEFT JOIN ord o ON o.run = dn.run AND o.id = dn.id GROUP BY dn.run, mark"))
add(lambda s, d: replay.relabelled(_orders((e := graph(s, d))), partition_of(e)), over(GRAPH, _ORDERS, then="SELECT run, com, CAST(row_number() OVER (PARTITION BY run ORDER BY first) AS INTEGER) AS label FROM (SELECT run, com, min(step) AS first FROM ord JOIN part USING (id) GROUP BY run, com)"), "label_reorder")
add(lambda s, d: replay.small_sample((e := graph(s, d)), _orders(e).where("run = 0 AND step < 40")), over(GRAPH, _ORDERS, then="SELECT src, dst FROM e WHERE src IN (SELECT id FROM ord WHERE run = 0 AND step < 40) AND dst IN (SELECT id FROM ord WHERE run = 0 AND step < 40)"), "small_sample")


def merge_logs(s, d):
    o = _orders(graph(s, d))
    one = lambda r, n, k: o.where(F.col("run") == r).select(F.col("step").alias("row_no"), (F.col("step") + F.when(F.col("step") >= k, 1).otherwise(0)).alias("budget"), F.col("id").alias(n))
    return replay.merged_logs(one(0, "a", 1 << 30), one(1, "b", 5))


add(merge_logs, over(GRAPH, _ORDERS, then="SELECT x.step AS row_no, x.step AS budget, x.id AS a, y.id AS b FROM ord x JOIN ord y ON x.step = y.step WHERE x.run = 0 AND y.run = 1 AND x.step < 5"))


def core_periphery_tau(s, d):
    own = replay.core_periphery(graph(s, d), 10, 3, 0)
    return r6(stats.kendall_top(own.select("id", F.col("actual").alias("x"), F.col("observed").alias("y")), 0.5))


add(core_periphery_tau, over(GRAPH, then=f"WITH k AS (SELECT id FROM deg ORDER BY {u_sql(3, 0, 'id')}, id LIMIT 10), l AS (SELECT DISTINCT least(id, nbr) AS a, greatest(id, nbr) AS b FROM adj WHERE id IN (SELECT id FROM k)), o AS (SELECT id, count(*) AS obs FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY id), x AS (SELECT id, deg AS x, obs AS y FROM o JOIN deg USING (id) WHERE obs <> deg), t AS (SELECT * FROM x ORDER BY x DESC, id LIMIT (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) + 1 FROM x)) SELECT round(coalesce(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(count(*) FILTER (a.x <> b.x)) * sqrt(count(*) FILTER (a.y <> b.y)), 0), 0.0), 6) AS tau FROM t a JOIN t b ON a.id < b.id"))
add(lambda s, d: r6(replay.sample_report(prep.induced((e := graph(s, d)), closed_of(e)), e)), over(GRAPH, then="WITH i AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM shut) AND dst IN (SELECT id FROM shut)), a AS (SELECT src AS id, dst AS nbr FROM i UNION ALL SELECT dst, src FROM i), g AS (SELECT id, count(*) AS d FROM a GROUP BY id), t AS (SELECT x.id, count(*) AS t2 FROM a x JOIN a y ON x.nbr = y.id JOIN a z ON z.id = y.nbr AND z.nbr = x.id GROUP BY x.id), v AS (SELECT d AS v FROM g UNION SELECT deg FROM deg), ks AS (SELECT max(abs((SELECT avg(CASE WHEN d <= v THEN 1.0 ELSE 0.0 END) FROM g) - (SELECT avg(CASE WHEN deg <= v THEN 1.0 ELSE 0.0 END) FROM deg))) AS d, (SELECT count(*) FROM g) AS n FROM v), r AS (SELECT round(avg(d), 6) AS mean_deg, round(median(d), 6) AS median_deg, round(avg(CASE WHEN d > 1 THEN coalesce(t2, 0) / CAST(d * (d - 1) AS DOUBLE) ELSE 0 END), 6) AS mean_cc FROM g LEFT JOIN t USING (id)) SELECT r.*, round(d, 6) AS d, round(" + _SERIES.format(d="d", n="n", m="(SELECT n FROM nm)") + ", 6) AS p FROM r, ks"), "sample_report")

# --- simulation, generators, learning --------------------------------------------------------------------------------


def sir_sql(rounds: int = 5) -> str:
    out = [",\ns0 AS (SELECT id, CASE WHEN id = (SELECT min(id) FROM deg) THEN 'I' ELSE 'S' END AS state FROM deg)"]
    for t in range(rounds):
        out.append(f",\ns{t + 1} AS MATERIALIZED (SELECT id, CASE WHEN state = 'S' AND id IN (SELECT nbr FROM adj WHERE id IN (SELECT id FROM s{t} WHERE state = 'I') AND {u_sql(1, 2 * t, chr(34) + 'adj' + chr(34) + '.id || ' + repr('-') + ' || nbr')} < 0.3) THEN 'I' WHEN state = 'I' AND {u_sql(1, 2 * t + 1, 'id')} < 0.1 THEN 'R' ELSE state END AS state FROM s{t})")
    rows = " UNION ALL ".join(f"SELECT {t} AS t, count(*) FILTER (state = 'S') AS s, count(*) FILTER (state = 'I') AS i, count(*) FILTER (state = 'R') AS r, count(*) FILTER (state <> 'S') AS seen FROM s{t}" for t in range(rounds + 1))
    return over(GRAPH, *out, then=rows)


add(lambda s, d: simulate.sir((e := graph(s, d)), prep.vertices(e).agg(F.min("id").alias("id")), 5), sir_sql(), "sir_rounds")
add(lambda s, d: simulate.random_graph(s, 300, 0.02), f"SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst FROM (SELECT a, CAST(a + sum(1 + floor(ln(1 - {u_sql(1, 'k', 'a')}) / ln(CAST(0.98 AS DOUBLE)))) OVER (PARTITION BY a ORDER BY k) AS BIGINT) AS b FROM range(300) x(a), range(300) y(k)) WHERE b < 300", "er_edges")


def rewire_cc(s, d):
    e = graph(s, d)
    before, after = metrics.average_clustering(e), metrics.average_clustering(simulate.reduce_clustering(e, partition_of(e), 0.05, rounds=2))
    return r6(before.select(F.lit("before").alias("state"), "cc").union(after.select(F.lit("after"), "cc")))


add(rewire_cc)
add(lambda s, d: lfr.graphs(s, 2, lfr.Parameters(n=250, mean_degree=10, max_degree=25, min_size=20, max_size=60)), None, "lfr")
add(lambda s, d: simulate.lfr_histograms((e := graph(s, d)), partition_of(e)), over(GRAPH, then="WITH x AS (SELECT adj.id, avg(CASE WHEN p.com <> q.com THEN 1.0 ELSE 0.0 END) AS mu FROM adj JOIN part p ON p.id = adj.id JOIN part q ON q.id = adj.nbr GROUP BY adj.id) SELECT 'mixing' AS kind, CAST(floor(round(mu * 20 / 1.1, 9)) AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'size', bin, count(*) FROM (SELECT com, count(*) AS bin FROM part GROUP BY com) GROUP BY bin"), "lfr_histograms")
_LAW = ", ".join(f"CAST({round(float(x), 12)!r} AS DOUBLE)" for x in lfr.power_law(3, 30, 2.0))
_INNER = "CAST(0.7 AS DOUBLE) * k"
add(lambda s, d: lfr.internal_degrees(lfr.power_law_draws(s, 500, 3, 30, 2.0), 0.3), f"SELECT id, k, CAST(floor({_INNER}) + CASE WHEN {u_sql(1, 1, 'id')} < {_INNER} - floor({_INNER}) THEN 1 ELSE 0 END AS INTEGER) AS inner FROM (SELECT id, CAST(least(len(list_filter([{_LAW}], lambda c: c < {u_sql(1, 0, 'id')})) + 3, 30) AS INTEGER) AS k FROM range(500) x(id))", "power_law_degrees")
add(lambda s, d: r6(learn.scaled_features(graph(s, d))), over(_BASE["node_features"].removeprefix("WITH ").rpartition("\nSELECT ")[0], ",\nnf AS (SELECT " + _BASE["node_features"].rpartition("\nSELECT ")[2].replace("round(cc, 6)", "cc").replace("round(nd, 6)", "nd").replace("round(nc, 6)", "nc").replace("round(cc.deg / (n - 1.0), 6)", "cc.deg / (n - 1.0)").replace("round(rank, 6)", "rank") + ")", then="SELECT id, " + ", ".join(f"round(({c} - min({c}) OVER ()) / CAST(nullif(max({c}) OVER () - min({c}) OVER (), 0) AS DOUBLE), 6) AS {c}" for c in learn.FEATURES) + " FROM nf"), "feature_minmax")


def _bordered(e):
    """Labels with both classes: a user is inner if most of its neighbours share its community."""
    share = metrics.community_shares(e, e.sparkSession.createDataFrame([], "id string, com int").union(partition_of(e)))
    mid = share.agg(F.expr("percentile(outside, 0.5)").alias("mid"))
    return share.crossJoin(F.broadcast(mid)).select("id", (F.col("outside") > F.col("mid")).cast("int").alias("border"))


def border_knn(s, d):
    e = graph(s, d)
    return r6(learn.border_knn(cut(metrics.node_features(e)), _bordered(e), shuffles=2))


def border_logreg(s, d):
    e = graph(s, d)
    own = cut(learn.min_max(metrics.node_features(e)).join(_bordered(e), "id"))
    parts = learn.split(own, "border", 1, 0)
    return r6(learn.quality(learn.logistic(parts.where("NOT test"), parts.where("test"), "border")))


def sub_communities(s, d):
    e = graph(s, d)
    levels = metrics.bfs_levels(e, prep.vertices(e).agg(F.min("id").alias("id")), most=2)
    return r6(learn.sub_communities(prep.induced(e, levels.select("id")), partition_of(e).where("com = 2"), closed_of(e)))


def multi_layer_community(s, d):
    """From a start, the PageRank heads of the cheap communities next to its own are seeds; each grows the sample by observed
    over true degree for a budget of 10; then the start's community grows while its sharpness does."""
    layers = cut(graphs.layers(s, d))
    cheap = layers.where("layer = 1").select("src", "dst")
    com = cut(community.best_partition(community.louvain(cheap, levels=2)))
    rank = metrics.pagerank(cheap, 10)
    expensive = layers.where("layer = 0").select("src", "dst")
    return r6(local.report(local.communities(expensive, partition_of(expensive), "layers", 2, cheap=cheap, cheap_com=com, cheap_rank=rank)))


def local_communities(method):
    def run(s, d):
        layers = cut(graphs.layers(s, d))
        expensive = layers.where("layer = 0").select("src", "dst")
        return r6(local.report(local.communities(expensive, partition_of(expensive), method, 2, cheap=layers.where("layer = 1").select("src", "dst"))))

    return run


for _f in (border_knn, border_logreg, sub_communities, multi_layer_community):
    add(_f)
add(local_communities("mutual"), None, "mutual_community")
add(local_communities("overlap"), None, "overlap_community")


def _with_help(algo):
    """Crawls that look at more than the graph: a partition (oracle) or a cheap layer (man)."""

    def run(s, d):
        layers = cut(graphs.layers(s, d))
        e = layers.where("layer = 0").select("src", "dst")
        return r6(grouped.crawl_all(e, [algo], 2, tenth(e), com=partition_of(e), cheap=prep.degrees(layers.where("layer = 1").select("src", "dst"))))

    return run


add(_with_help("oracle"), None, "crawl_oracle")
add(_with_help("man"), None, "crawl_man")
add(_grouped(["learned", "random_exp", "seed_walk", "dense_ex_bfs", "dense_ex_smooth"], 1), None, "crawl_further")
add(_grouped(["sb", "rw", "pagerank"], limit=5, incomplete=True), None, "incomplete_more")


def accumulated_results(s, d):
    """Curves of two algorithms over two trials, side by side."""
    e = graph(s, d)
    runs = s.createDataFrame([(str(t), t) for t in (1, 2)], "run string, seed int")
    traces = {a: crawl.crawl(e, runs, a, STEPS).select(F.col("run").alias("trial"), F.col("step").alias("cost"), "nodes", "edges") for a in ("mod", "random")}
    return replay.accumulated(traces, 2)


def _accumulated_sql() -> str:
    parts = []
    for a in ("mod", "random"):
        for t in (1, 2):
            body = crawl_sql(a, seed=t).rpartition("\nSELECT 'r' AS run")
            parts.append(f"SELECT '{a}' AS algo, '{t}' AS trial, CAST(step // 2 * 2 AS INTEGER) AS budget, max(nodes) AS nodes, max(edges) AS edges FROM ({body[0]}\nSELECT 'r' AS run{body[2]}) GROUP BY ALL")
    return "\nUNION ALL\n".join(parts)


add(accumulated_results, _accumulated_sql())


def random_in_largest(s, d):
    """C7 over the given partition."""
    e = graph(s, d)
    return access.random_in_largest(e, partition_of(e), SEED)


add(random_in_largest, over(GRAPH, then=f"WITH big AS (SELECT com FROM part GROUP BY com ORDER BY count(*) DESC, com LIMIT 1), m AS (SELECT id, deg, row_number() OVER (ORDER BY deg DESC, id) AS k, count(*) OVER () AS n FROM part JOIN deg USING (id) WHERE com = (SELECT com FROM big)) SELECT id FROM m WHERE k <= greatest(1, floor(n * 0.5)) ORDER BY {u_sql(SEED, 0, 'id')}, id LIMIT 1"))


def boundary_score(s, d):
    """Of a closed set and its boundary."""
    e = graph(s, d)
    return r6(metrics.boundary_score(e, closed_of(e)))


add(boundary_score, over(GRAPH, then="WITH b AS (SELECT DISTINCT id FROM adj WHERE id IN (SELECT id FROM shut) AND nbr NOT IN (SELECT id FROM shut)), x AS (SELECT least(id, nbr) AS p, greatest(id, nbr) AS q, id, nbr FROM adj WHERE id IN (SELECT id FROM b)) SELECT round(count(DISTINCT CASE WHEN nbr IN (SELECT id FROM shut) THEN nbr END) / CAST(count(DISTINCT (p, q)) AS DOUBLE), 6) AS score FROM x"))


def bounded_bfs(s, d):
    """G43 over the first five queries of a queue crawl."""
    e = graph(s, d)
    return crawl.core_and_periphery(e, crawl.crawl(e, one_run(s), "bfs", STEPS))


_bhead, _, _ = crawl_sql("bfs").rpartition("\nSELECT 'r' AS run")
add(bounded_bfs, _bhead + f"\nSELECT 'r' AS run, id, 'core' AS kind FROM c{STEPS} UNION ALL SELECT DISTINCT 'r', nbr, 'periphery' FROM adj WHERE id IN (SELECT id FROM c{STEPS}) AND nbr NOT IN (SELECT id FROM c{STEPS})")


def cheap_overlap(s, d):
    e = graph(s, d)
    return crawl.cheap_overlap(e, graphs.layers(s, d).where("layer = 1").select("src", "dst"), closed_of(e).union(_open(e).select("id")))


_SEEN = f"(SELECT id FROM shut UNION SELECT id FROM ({_OPEN}))"
add(cheap_overlap, over(GRAPH, then=f"SELECT s.id, count(c.nbr) AS overlap FROM {_SEEN} s LEFT JOIN (SELECT * FROM {_CHEAP} WHERE nbr IN {_SEEN}) c ON c.id = s.id GROUP BY s.id"))


def degree_estimate_trace(s, d):
    """H9: per query number, the true degree and the mark-recapture estimate from the answers so far."""
    e = graph(s, d)
    nodes = prep.vertices(e)
    one = lambda q: access.neighbours_partial(e, nodes, 8, 7, q).groupBy("id").agg(F.collect_list("nbr").alias(f"a{q}"))
    own = one(1).join(one(2), "id").join(one(3), "id").join(prep.degrees(e), "id")
    second = access.recaptured_degree(F.col("a1"), F.col("a2"))
    third = access.recaptured_degree(F.array_union("a1", "a2"), F.col("a3"))
    rows = F.array(F.struct(F.lit(2).alias("query_count"), second.alias("estimate")), F.struct(F.lit(3).alias("query_count"), third.alias("estimate")))
    return own.select("id", "deg", F.explode(rows).alias("r")).select("id", F.col("deg").alias("true_degree"), "r.query_count", "r.estimate")


def _answer(q: int) -> str:
    return f"(SELECT id, list(nbr) AS a FROM (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY {u_sql(7, q, chr(105) + 'd || ' + repr('-') + ' || nbr')}, nbr) AS k FROM adj) WHERE k <= 8 GROUP BY id)"


_GUESS = "CAST(CASE WHEN len(list_intersect({m}, {r})) > 0 THEN floor(len({m}) * len({r}) / len(list_intersect({m}, {r}))) ELSE 0 END AS INTEGER)"
add(degree_estimate_trace, over(GRAPH, then=f"WITH x AS (SELECT o.id, o.a AS a1, p.a AS a2, q.a AS a3, list_distinct(list_concat(o.a, p.a)) AS b FROM {_answer(1)} o JOIN {_answer(2)} p USING (id) JOIN {_answer(3)} q USING (id)) SELECT id, deg AS true_degree, 2 AS query_count, {_GUESS.format(m='a1', r='a2')} AS estimate FROM x JOIN deg USING (id) UNION ALL SELECT id, deg, 3, {_GUESS.format(m='b', r='a3')} FROM x JOIN deg USING (id)"))


def distinct_datasets(s, d):
    """The data sets (here: layers) with their number of edges, each once."""
    return graphs.layers(s, d).groupBy("layer").agg(F.count("*").alias("edges"))


add(distinct_datasets, over(GRAPH, then="SELECT CAST(layer AS INTEGER) AS layer, count(*) AS edges FROM pl GROUP BY layer"))
