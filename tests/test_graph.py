"""Toy graphs with expected values computed by hand, invariants, and agreement of the two crawl executors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions.choice import u, u_py
from netquarry.operators import access, community, crawl, grouped, learn, lfr, local, metrics, prep, replay, simulate, stats
from netquarry.sources import readers, sinks
from netquarry.sources.graphs import canonical

TOYS = {
    "path": [("a", "b"), ("b", "c"), ("c", "d")],
    "star": [("h", "1"), ("h", "2"), ("h", "3"), ("h", "4")],
    "k4": [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")],
    "bridge": [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")],
}


def toy(spark, name):
    return canonical(spark.createDataFrame(TOYS[name], "src string, dst string"))


def as_map(df, key="id", *values):
    return {r[key]: (r[values[0]] if len(values) == 1 else tuple(r[v] for v in values)) for r in df.collect()}


def test_choice_agrees(spark):
    df = spark.createDataFrame([(str(i),) for i in range(50)], "id string").withColumn("u", u(3, 7, "id"))
    assert all(abs(r.u - u_py(3, 7, r.id)) < 1e-15 for r in df.collect())


@pytest.mark.parametrize("name,density,tree,cc", [("path", 0.5, 0, 0), ("star", 0.4, 0, 0), ("k4", 1, 1, 1), ("bridge", 0.466667, 0.2, 0.777778)])
def test_densities_and_clustering(spark, name, density, tree, cc):
    e = toy(spark, name)
    r = metrics.density(e).first()
    assert (round(r.density, 6), round(r.tree_density, 6)) == (density, tree)
    assert round(metrics.average_clustering(e).first().cc, 6) == cc
    assert prep.degrees(e).agg(F.sum("deg")).first()[0] == 2 * e.count()


def test_ego_values(spark):
    got = as_map(metrics.ego_edges(toy(spark, "bridge")), "id", "ego_edges", "ego_out")
    assert got == {"a": (3, 1), "b": (3, 1), "c": (4, 2), "d": (4, 2), "e": (3, 1), "f": (3, 1)}
    near = as_map(metrics.neighbour_mean(toy(spark, "bridge"), prep.degrees(toy(spark, "bridge")).withColumnRenamed("deg", "value"), "nd"), "id", "nd")
    assert {k: round(v, 4) for k, v in near.items()} == {"a": 2.5, "b": 2.5, "c": 2.3333, "d": 2.3333, "e": 2.5, "f": 2.5}


@pytest.mark.parametrize("name,want", [("path", {"a": 3, "b": 2, "c": 2, "d": 3}), ("star", {"h": 1, "1": 2, "2": 2, "3": 2, "4": 2}), ("bridge", {"a": 3, "b": 3, "c": 2, "d": 2, "e": 3, "f": 3})])
def test_eccentricity(spark, name, want):
    assert as_map(metrics.eccentricities(toy(spark, name)), "id", "ecc") == want


def test_modularity_and_louvain(spark):
    e = toy(spark, "bridge")
    com = spark.createDataFrame([(v, 0 if v in "abc" else 1) for v in "abcdef"], "id string, com int")
    assert abs(community.modularity(e, com).first()[0] - 0.357142857) < 1e-9
    found = community.best_partition(community.louvain(e))
    alone = spark.createDataFrame([(v, i) for i, v in enumerate("abcdef")], "id string, com int")
    assert community.modularity(e, found).first()[0] >= community.modularity(e, alone).first()[0]
    shares = as_map(metrics.community_shares(e, com), "id", "border", "outside")
    assert shares["c"] == (1, pytest.approx(1 / 3)) and shares["a"] == (0, 0.0)
    assert metrics.boundary_sharpness(e, com.where("com = 0"), "").first().local_r == 3.0


def test_med_crawl_on_the_bridge(spark):
    e = toy(spark, "bridge")
    runs, start = spark.createDataFrame([("r", 1)], "run string, seed int"), spark.createDataFrame([("r", "a")], "run string, id string")
    rows = crawl.crawl(e, runs, "med", 4, start).orderBy("step").collect()
    assert [r.nodes for r in rows] == [3, 4, 6, 6] and [r.edges for r in rows] == [2, 4, 6, 7]
    assert [r.id for r in rows][:3] == ["a", "c", "d"] and rows[3].id in "ef"


def test_opic_cash_after_one_query():
    adj = {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
    c = grouped.Crawl(grouped.Access(adj), "opic", 0, 1)
    c.query("a")
    assert (c.opic["a"], c.opic["b"], c.opic["c"]) == (0.0, 1.5, 1.5)


@pytest.mark.parametrize("rule", ["random", "mod", "med", "cash", "bfs", "sb", "cheat", "opic", "k_rank", "degree_gap", "unobserved"])
def test_both_executors_agree(spark, rule):
    import random

    rng = random.Random(4)
    e = canonical(spark.createDataFrame([(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(120)], "src string, dst string"))
    e = prep.giant_component(e)
    a = crawl.crawl(e, spark.createDataFrame([("r", 1)], "run string, seed int"), rule, 5).orderBy("step").select("id", "obs", "nodes", "edges").collect()
    b = grouped.crawl_all(e, [rule], 1, 5, seed=1).orderBy("step").select(F.col("node").alias("id"), "obs", "nodes", "edges").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


@pytest.mark.parametrize("algo", sorted(grouped.ALGORITHMS))
def test_crawl_invariants(algo):
    import random

    rng = random.Random(5)
    adj = {str(i): set() for i in range(60)}
    for i in range(1, 60):
        for j in {rng.randrange(i) for _ in range(3)}:
            adj[str(i)].add(str(j))
            adj[str(j)].add(str(i))
    adj = {k: sorted(v) for k, v in adj.items()}
    rows = grouped.run_one(adj, algo, 0, 15, 2)
    assert rows == grouped.run_one(adj, algo, 0, 15, 2)
    nodes, edges = [r[7] for r in rows], [r[8] for r in rows]
    assert nodes == sorted(nodes) and edges == sorted(edges) and rows[-1][3] <= 16 and len({r[4] for r in rows}) == len(rows)
    for kw in ({"limit": 2}, {"limit": 2, "paged": True}):
        part = grouped.run_one(adj, "mod", 0, 15, 2, incomplete=True, **kw)
        assert part and part[-1][3] <= 16


def test_components_and_giant(spark):
    e = canonical(spark.createDataFrame([(str(i), str(i + 1)) for i in range(30)] + [("x", "y"), ("z", "z")], "src string, dst string"))
    comp = as_map(prep.components(e), "id", "component")
    assert {comp[str(i)] for i in range(31)} == {"0"} and comp["y"] == "x" and "z" not in comp
    assert prep.giant_component(e).count() == 30


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert prep.components(e).count() == 0 and metrics.local_clustering(e).count() == 0 and metrics.pagerank(e, 2).count() == 0
    assert metrics.density(e).first().m == 0 and community.modularity(e, spark.createDataFrame([], "id string, com int")).first()[0] is None
    with pytest.raises(ValueError):
        grouped.crawl_all(canonical(spark.range(9).selectExpr("cast(id AS string) src", "cast(id + 1 AS string) dst")), ["mod"], 1, 2, max_edges=3)


def test_access(spark):
    e = toy(spark, "star")
    asked = spark.createDataFrame([("h",)], "id string")
    pages = [sorted(r.nbr for r in access.neighbours_page(e, asked, p, 3).collect()) for p in range(3)]
    assert pages == [["1", "2", "3"], ["4"], []] and access.neighbours_page(e, asked, 0, 3, whole_first=True).count() == 4
    assert access.neighbours_partial(e, asked, 2, 1, 1).count() == 2
    row = spark.createDataFrame([(["b", "c", "d"], ["c", "d", "e"], 4, 1)], "m array<string>, r array<string>, t int, o int")
    assert row.select(access.recaptured_degree(F.col("m"), F.col("r"))).first()[0] == 4
    assert row.select(access.selection_probability(F.col("t"), F.col("o"), 2)).first()[0] == 1


def test_statistics(spark):
    a = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 5)], "value double")
    b = spark.createDataFrame([(float(x),) for x in (4, 5, 6, 7, 9)], "value double")
    r = stats.ks_two_sample(a, b).first()
    assert r.d == pytest.approx(0.8) and r.p == pytest.approx(stats.kolmogorov_p(0.8, 5, 5))
    t = spark.createDataFrame([("a", 3.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 3.0)], "id string, x double, y double")
    assert stats.kendall_top(t, 1.0).first().tau == pytest.approx(-1.0)
    rows = [(str(i), float(i * 7 % 5), None if i == 8 else float(i * i % 11)) for i in range(40)]
    own = [(x, y) for _, x, y in rows if y is not None]
    sign = lambda a, b: (a > b) - (a < b)
    pairs = [(sign(a[0], b[0]), sign(a[1], b[1])) for i, a in enumerate(own) for b in own[:i]]
    tau = sum(a * b for a, b in pairs) / math.sqrt(sum(a != 0 for a, _ in pairs) * sum(b != 0 for _, b in pairs))
    many = spark.createDataFrame(rows, "id string, x double, y double")
    assert stats.kendall_top(many, 1.0).first().tau == pytest.approx(tau) and stats.kendall_top(many.limit(0)).first().tau == 0
    assert [simulate.random_graph(spark, 6, p).distinct().count() for p in (0.0, 1.0)] == [0, 15]
    p = as_map(stats.percentile_of(t.select("id", "x"), a), "id", "percentile")
    assert p["a"] == pytest.approx((3 + 4 + 1) * 10.0)


def test_replay_and_logs(spark):
    e = toy(spark, "bridge")
    orders = spark.createDataFrame([(0, 0, "a"), (0, 1, "c"), (0, 2, "d")], "run int, step int, id string")
    assert [r.new for r in replay.new_nodes(e, orders, 1).orderBy("step").collect()] == [3, 1, 2]
    left = spark.createDataFrame([(0, 1, 5), (1, 2, 6), (2, 3, 7)], "row_no long, budget int, a int")
    right = spark.createDataFrame([(0, 1, 5), (1, 9, 6), (2, 3, 7)], "row_no long, budget int, b int")
    assert replay.merged_logs(left, right).count() == 1


def test_sir_conserves(spark):
    e = toy(spark, "bridge")
    rows = simulate.sir(e, spark.createDataFrame([("a",)], "id string"), 4).collect()
    assert all(r.s + r.i + r.r == 6 and r.seen == r.i + r.r for r in rows) and len(rows) == 5


def test_lfr():
    p = lfr.Parameters(n=200, mean_degree=8, max_degree=20, min_size=20, max_size=50, mixing=0.2)
    edges, com = lfr.generate(p, 3)
    assert (edges, com) == lfr.generate(p, 3) and len(set(edges)) == len(edges) and all(a < b for a, b in edges) and len(com) == 200
    outside = sum(com[a] != com[b] for a, b in edges) / len(edges)
    assert abs(outside - 0.2) < 0.1


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%c\n1 2\n2,3\n3 3\n9 8\n")
    assert sorted(map(tuple, readers.read_graph(spark, str(tmp_path / "g.mtx")).collect())) == [("1", "2"), ("2", "3")]
    (tmp_path / "g.txt").write_text("a  b 5\n# x\nb\tc\n")
    e = readers.edge_list(spark, str(tmp_path / "g.txt"))
    assert sorted(map(tuple, e.collect())) == [("a", "b"), ("b", "c")]
    sinks.edge_list(e, str(tmp_path / "out"))
    assert readers.edge_list(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "log.csv").write_text("mod,budget\nu'1',1\n 2,2\n3,3\n4,1\n5,2\n6,3\n")
    log = readers.crawl_log(spark, str(tmp_path / "log.csv"))
    assert [r.node for r in readers.trial(log, "mod", 1).orderBy("step").collect()] == [4, 5]
    import struct

    (tmp_path / "g.bin").write_bytes(struct.pack("<I2I2I", 2, 1, 2, 1, 0))
    assert sorted(map(tuple, readers.binary_graph(spark, str(tmp_path / "g.bin")).collect())) == [("0", "1"), ("1", "0")]
    (tmp_path / "net.dat").write_text("1\t2\n2\t1\n")
    assert readers.lfr_network(spark, str(tmp_path / "net.dat")).count() == 1
    (tmp_path / "layers").mkdir()
    (tmp_path / "layers" / "a").write_text("1 2\n")
    (tmp_path / "layers" / "b").write_text("1 3\n")
    assert sorted((r.layer, r.folder) for r in readers.layer_folder(spark, str(tmp_path / "layers"), expensive="b").collect()) == [(0, "b"), (1, "a")]
    (tmp_path / "open.txt").write_text("set(['12', '7'])")
    assert sorted(r.id for r in readers.saved_nodes(spark, str(tmp_path / "open.txt")).collect()) == ["12", "7"]
    lines = sinks.curve_lines(spark.createDataFrame([("m", 1, 2.0), ("m", 2, 3.12345)], "type string, cost int, value double"))
    assert [r.value for r in lines.collect()] == ["m_Cost, 1.0, 2.0", "m, 2.0, 3.1235"] or [r.value for r in lines.collect()] == ["m_Cost, 1.0, 2.0", "m, 2.0, 3.1234"]
    table = sinks.cached(spark, str(tmp_path / "cache"), lambda: e)
    assert table.count() == 2 and sinks.cached(spark, str(tmp_path / "cache"), lambda: 1 / 0).count() == 2


def test_learning(spark):
    rows = [(str(i), *(float(i % 7 + k) for k in range(8)), int(i % 7 > 3)) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(["id string", *(f"{c} double" for c in learn.FEATURES), "border int"]))
    r = learn.border_knn(df.drop("border"), df.select("id", "border"), shuffles=1).first()
    assert r.accuracy > 0.7 and r.auc > 0.8
    parts = learn.split(df, "border", 1, 0)
    scored = learn.logistic(parts.where("NOT test"), parts.where("test"), "border")
    assert learn.quality(scored).first().auc > 0.95


def test_crawls_look_at_few_open_nodes(monkeypatch):
    """The greatest keys come from an index: the traces are those of a look at every open node."""
    rng = random.Random(8)
    pairs = {tuple(sorted((str(rng.randrange(3000)), str(rng.randrange(3000))))) for _ in range(9000)}
    adj = {}
    for a, b in sorted(p for p in pairs if p[0] != p[1]):
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    looks = [0]
    monkeypatch.setattr(grouped, "u_py", lambda *k, own=u_py: (looks.__setitem__(0, looks[0] + 1), own(*k))[1])
    for algo, key in (("mod", lambda c, n: c.obs(n)), ("med", lambda c, n: c.deg(n) - c.obs(n)), ("opic", lambda c, n: c.opic[n]), ("random", lambda c, n: 0)):
        looks[0] = 0
        got = grouped.run_one(adj, algo, 0, 200.0, 5)
        assert looks[0] < 40 * 200 + 2 * len(adj)
        c, v = grouped.Crawl(grouped.Access(adj), algo, 0, 5), got[0][4]
        for _ in range(200):
            c.query(v)
            v = c.top(c.open, lambda n, key=key, c=c: key(c, n))
        assert got == c.rows
    looks[0] = 0
    grouped.run_one(adj, "mod", 0, 200.0, 5, limit=5, incomplete=True)
    assert looks[0] < 100 * 200 + 2 * len(adj)


def test_properties_pair_no_rows_with_marks(spark):
    e = canonical(spark.createDataFrame([(str(i), str(j)) for i in range(12) for j in range(i) if (i * j) % 3], "src string, dst string"))
    orders = spark.createDataFrame([(0, i, str(i)) for i in range(12)], "run int, step int, id string")
    out = replay.properties(e, orders, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and "<= mark" in line]
    assert [r.step for r in out.orderBy("step").collect()] == [4, 8]  # the first query shows nothing


def test_shares_are_those_of_written_decimals(spark):
    scores = spark.range(10).selectExpr("cast(id AS string) AS id", "double(id) AS p")
    assert access.likely(scores, 0.7).count() == 7
    assert int(0.29 * 100) == 28 and access.likely(spark.range(100).selectExpr("cast(id AS string) AS id", "double(id) AS p"), 0.29).count() == 29


def test_eccentricities_hold_no_pairs_of_nodes(spark, monkeypatch):
    rng = random.Random(6)
    e = canonical(spark.createDataFrame([(str(rng.randrange(150)), str(rng.randrange(150))) for _ in range(260)], "src string, dst string"))
    com = prep.vertices(e).select("id", (F.col("id").cast("int") % 2).alias("com"))
    near = {}
    for r in e.collect():
        if int(r.src) % 2 == int(r.dst) % 2:
            near.setdefault(r.src, set()).add(r.dst)
            near.setdefault(r.dst, set()).add(r.src)
    want = {}
    for v in near:
        away, edge = {v: 0}, [v]
        for x in edge:
            for n in near[x] - away.keys():
                away[n] = away[x] + 1
                edge.append(n)
        want[v] = (int(v) % 2, max(away.values()), len(away))
    written = []
    monkeypatch.setattr(metrics, "cut", lambda df, own=metrics.cut: (out := own(df), written.append(out.count()))[0])
    assert as_map(metrics.eccentricities(e, com), "id", "com", "ecc", "reached") == want
    assert max(written) <= e.count()  # no table of reached pairs
    monkeypatch.undo()
    assert as_map(metrics.eccentricities(toy(spark, "bridge"), max_edges=2, pairs=20), "id", "ecc", "reached") == {"a": (3, 6), "b": (3, 6), "c": (2, 6), "d": (2, 6), "e": (3, 6), "f": (3, 6)}


def test_nearest_vote_takes_any_number_of_training_rows(spark):
    rng = random.Random(4)
    value = lambda n, k: [(f"{k}{i}", float(rng.randrange(40)), float(rng.randrange(40)), rng.randrange(2)) for i in range(n)]
    train, test = value(20_010, "r"), value(30, "t")
    table = lambda rows: spark.createDataFrame(rows, "id string, deg double, cc double, border int")
    for size in (20_000, 7_000):
        got = as_map(learn.nearest_vote(table(train), table(test), "border", columns=("deg", "cc"), rows=size), "id", "label", "score")
        for i, x, y, label in test:
            near = sorted(((a - x) ** 2 + (b - y) ** 2, k, v) for k, a, b, v in train)[:5]
            assert got[i] == (label, sum(v for _, _, v in near) / 5)


def test_id_dictionary(spark):
    rows = spark.createDataFrame([(0, "x", "y"), (1, "y", "z"), (250_000, "w", "x")], "row_no long, src string, dst string")
    assert as_map(prep.id_dictionary(rows), "user", "id") == {"x": 0, "y": 1, "z": 2, "w": 3}


def test_pagerank_sums_to_one(spark):
    assert math.isclose(metrics.pagerank(toy(spark, "bridge"), 10).agg(F.sum("rank")).first()[0], 1.0, abs_tol=1e-9)


def test_curves_run_a_tenth_of_the_nodes(spark, monkeypatch):
    from netquarry.plans import crawl_queries

    e = simulate.random_graph(spark, 300, 0.02).cache()
    n = int(0.1 * prep.vertices(e).count())
    monkeypatch.setattr(crawl_queries, "graph", lambda s, d: e)
    rows = {r.step: r for r in crawl_queries.mod_curve(spark, "").collect()}
    assert n > 15 and len(rows) == int(0.1 * prep.vertices(prep.giant_component(e)).count())
    few = crawl.crawl(prep.giant_component(e), crawl_queries.one_run(spark), "mod", 4).collect()
    assert all((rows[r.step].nodes, rows[r.step].edges) == (r.nodes, r.edges) for r in few)
    for name in ("crawl_hybrid", "walk_variants", "incomplete_mod"):
        assert crawl_queries.QUERIES[name](spark, "").agg(F.max("cost")).first()[0] == n
    assert crawl_queries.QUERIES["budget_curve"](spark, "").agg(F.max("budget")).first()[0] == n // 5 * 5


def test_expansion_considers_every_open_node():
    links = [("hub", f"a{k:03d}") for k in range(300)] + [(x, y) for t in "yz" for x, y in zip(["hub"] + [f"{t}{k}" for k in range(1, 5)], [f"{t}{k}" for k in range(1, 6)], strict=True)]
    rng = random.Random(3)
    for more in ([], [(f"n{k}", f"n{max(0, k - rng.randrange(1, 40))}") for k in range(1, 500)] + [("n0", "hub")] + [(f"n{9 * k}", f"n{rng.randrange(9 * k)}") for k in range(1, 50)]):
        adj = {}
        for x, y in {tuple(sorted(e)) for e in links + more}:
            adj.setdefault(x, []).append(y)
            adj.setdefault(y, []).append(x)
        c = grouped.Crawl(grouped.Access({k: sorted(v) for k, v in adj.items()}), "dense_ex", 0, 1)
        for v in ["hub", *(f"{t}{k}" for t in "yz" for k in range(1, 5)), *(f"n{k}" for k in range(0, 480, 3))]:
            if v in adj:
                c.query(v)
        far = {n: grouped.eccentricity(c, n) for n in c.open}
        assert len(far) > 300 and sorted(grouped.farthest(c)) == sorted(n for n in far if far[n] == max(far.values()))
        assert more or set(grouped.farthest(c)) == {"y5", "z5"} and not {"y5", "z5"} & set(sorted(c.open)[:200])
    adj = {k: sorted(v) for k, v in adj.items()}
    assert grouped.run_one(adj, "dense_ex", 0, 50.0, 1)


def test_incomplete_access_refuses_crawlers_without_a_rule():
    adj = {"a": ["b"], "b": ["a"]}
    assert grouped.run_one(adj, "mod", 0, 2.0, 1, 5, incomplete=True)
    with pytest.raises(ValueError, match="vmab"):
        grouped.run_one(adj, "vmab", 0, 2.0, 1, 5, incomplete=True)
    for algo in grouped.INCOMPLETE:
        rows = grouped.run_one(adj, algo, 0, 2.0, 1, 5, incomplete=True)
        assert rows and rows[-1][3] <= 2


def test_helped_crawls_use_their_help():
    rng = random.Random(8)
    adj = {}
    for i in range(120):
        for j in {rng.randrange(120) for _ in range(4)} | {(i + 2) % 120}:
            if i % 2 == j % 2 or rng.random() < 0.1:
                if i != j:
                    adj.setdefault(str(i), set()).add(str(j))
                    adj.setdefault(str(j), set()).add(str(i))
    adj = {k: sorted(v) for k, v in adj.items()}
    com, cheap = {n: int(n) % 2 for n in adj}, {n: len(v) for n, v in adj.items() if int(n) % 3}
    for algo in ("oracle", "man"):
        rows = grouped.run_one(adj, algo, 0, 20, 1, com=com, cheap=cheap)
        assert len(rows) == 20 and rows == grouped.run_one(adj, algo, 0, 20, 1, com=com, cheap=cheap)
    weight, mean = grouped.calibrated_weight(c := grouped.Crawl(grouped.Access(adj), "x", 0, 1), grouped._seed_walk(c, "0", 10, {}))
    assert mean >= 1 and weight == max(map(c.obs, c.closed)) / mean


def test_local_communities_find_a_clique(spark):
    inside = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(6) for j in range(i)]
    e = canonical(spark.createDataFrame([*inside, ("a0", "b0"), ("b1", "z")], "src string, dst string"))
    com = spark.createDataFrame([(f"{c}{i}", int(c == "b")) for c in "ab" for i in range(6)] + [("z", 2)], "id string, com int")
    for method, kw in (("mutual", {}), ("overlap", {"cheap": e}), ("layers", {"cheap": e, "cheap_com": com, "cheap_rank": metrics.pagerank(e, 5)})):
        out = {r.com: r for r in local.report(local.communities(e, com.where("com < 2"), method, 1, budget=6.0, **kw)).collect()}
        assert set(out) == {0, 1} and all(0 < r.precision <= 1 and 0 < r.recall <= 1 for r in out.values()) and out[0].recall >= 0.5


def test_trajectories_by_hand(spark):
    e = toy(spark, "bridge")  # ab ac bc cd de df ef
    orders = spark.createDataFrame([("r", 0, "c"), ("r", 1, "a")], "run string, step int, id string")
    rows = {r.step: r for r in replay.properties(e, orders, 1).collect()}
    assert (rows[0].nodes, rows[0].closed, rows[0].mean_deg, rows[0].mean_cc, rows[0].mean_deg_c) == (4, 1, 1.5, 0.0, 3.0)
    assert (rows[1].nodes, rows[1].closed, rows[1].mean_deg, rows[1].mean_deg_c) == (4, 2, 2.0, 2.5)
    assert math.isclose(rows[1].mean_cc, (1 + 1 + 1 / 3 + 0) / 4) and 0 < rows[1].d <= 1 and 0 <= rows[1].p <= 1


def _tangle(n, links, seed):
    """A random graph with a dense corner and a tail, so that keys tie, differ and reach far."""
    rng = random.Random(seed)
    adj = {}
    for a, b in {tuple(sorted((str(rng.randrange(n)), str(rng.randrange(n) if rng.random() < 0.7 else rng.randrange(40))))) for _ in range(links)} | {(f"t{k}", f"t{k + 1}") for k in range(8)} | {("0", "t0")}:
        if a != b:
            adj.setdefault(a, []).append(b)
            adj.setdefault(b, []).append(a)
    return {k: sorted(v) for k, v in adj.items()}


def _plain(c):
    """The choices of expansion, eccentric expansion and densification by a look at every open node."""
    ranked = sorted(c.open, key=lambda n: (-c.obs(n), n))
    cand = ranked[: int(0.2 * len(ranked))] or ranked
    lo, hi = min(map(c.obs, cand)), max(map(c.obs, cand))
    dense = c.top(cand, lambda n: ((c.obs(n) - lo) / (hi - lo) if hi > lo else c.obs(n)) * (1 - c.cc(n))) if len(cand) > 10 else cand[0]
    return c.top(ranked[int(0.2 * len(ranked)) :]), c.top(grouped.farthest(c)), dense


def test_arrays_choose_what_plain_rules_choose():
    for n, links, seed in ((700, 1500, 1), (300, 3000, 2), (40, 60, 3)):
        adj = _tangle(n, links, seed)
        for trace in (grouped.run_one(adj, "dense_ex", 0, 60.0, seed), grouped.run_one(adj, "bfs", 0, 60.0, seed)):
            c = grouped.Crawl(grouped.Access(adj), "x", 0, seed)
            for k, row in enumerate(trace[:-1]):
                c.query(row[4])
                if k >= 5 and k % 6 == 0 and c.open:
                    t = c.table(eccentric=True)
                    assert (t.expand(), t.outermost(), t.densify()) == _plain(c)


def test_eccentric_expansion_searches_from_few_nodes(monkeypatch):
    from netquarry.operators import arrays

    looks = [0]
    for name in ("_eccentricity", "_many"):
        monkeypatch.setattr(arrays.Arrays, name, lambda *k, own=getattr(arrays.Arrays, name): (looks.__setitem__(0, looks[0] + 1), own(*k))[1])
    monkeypatch.setattr(grouped, "distances", None)  # searches in plain Python
    for algo in ("dense_ex", "dense_ex_bfs", "dense_ex_smooth"):
        looks[0] = 0
        assert len(grouped.run_one(_tangle(3000, 12000, 4), algo, 0, 200.0, 5)) == 200
        assert 200 <= looks[0] < 4 * 200


def test_hashes_of_many_nodes_are_the_draws():
    from netquarry.operators.arrays import Hashes

    import numpy as np

    ids = sorted({str(k * k % 99991) for k in range(3000)} | {"", "é", "x" * 30})
    for seed, step in ((1, 0), (12, 34567), (1 << 40, 10**12)):
        assert [x / 4294967296 for x in Hashes(ids)(seed, step, np.arange(len(ids))).tolist()] == [u_py(seed, step, v) for v in ids]


def test_quarters_by_score_and_hash_are_those_of_a_whole_order():
    adj = _tangle(700, 3000, 7)
    c = grouped.Crawl(grouped.Access(adj), "x", 0, 7)
    for k, row in enumerate(grouped.run_one(adj, "mod", 0, 90.0, 7)):
        c.query(row[4])
        if k % 4 == 0 and c.open:
            ranked = sorted(c.open, key=lambda n: (c.obs(n) * (1 - c.cc(n)), c.u(n), n))
            part = [ranked[len(ranked) * i // 4 : len(ranked) * (i + 1) // 4] for i in range(4)]
            assert [c.table().quarter(i) for i in range(4) if part[i]] == [c.top(own) for own in part if own]


def test_oracle_choices_are_those_of_a_look_at_every_neighbour():
    adj = _tangle(500, 1500, 9)
    com = {n: len(n) % 3 for n in adj}
    for trace in (grouped.run_one(adj, "oracle", 0, 60.0, 9, com=com), grouped.run_one(adj, "bfs", 0, 60.0, 9)):
        c, beside = grouped.Crawl(grouped.Access(adj), "x", 0, 9), {}
        for row in trace[:-1]:
            c.query(row[4])
            seen, ranked = {*c.closed, *c.open}, sorted(c.open, key=lambda n: (-c.obs(n), n))
            if not ranked:
                break
            assert c.table().unseen() == c.top(ranked[: int(0.2 * len(ranked))] or ranked, lambda n: sum(w not in seen for w in adj[n]))
            for k in range(4):
                own = {n for n in adj if com[n] == k}
                near = {n for n in c.open if own & set(adj[n])}
                assert c.table().towards(own, beside, k) == c.top(near or c.open, lambda n: sum(w in own and w not in seen for w in adj[n]))


def test_pagerank_crawl_needs_no_plain_sums(monkeypatch):
    adj = _tangle(400, 1200, 8)
    got = grouped.run_one(adj, "pagerank", 0, 40.0, 8)
    c, v = grouped.Crawl(grouped.Access(adj), "pagerank", 0, 8), got[0][4]
    for _ in range(40):
        c.query(v)
        rank = grouped.sample_pagerank(c)
        v = c.top(c.open, lambda n, rank=rank: rank.get(n, 0.0))
    assert got == c.rows
    monkeypatch.setattr(grouped, "sample_pagerank", None)
    assert grouped.run_one(adj, "pagerank", 0, 40.0, 8) == got


def test_learned_and_random_expansion_look_at_no_open_node_in_python(monkeypatch):
    adj = _tangle(3000, 12000, 10)
    looks = [0]
    monkeypatch.setattr(grouped.Crawl, "cc", lambda c, v, own=grouped.Crawl.cc: (looks.__setitem__(0, looks[0] + 1), own(c, v))[1])
    monkeypatch.setattr(grouped.Crawl, "obs", lambda c, v, own=grouped.Crawl.obs: (looks.__setitem__(0, looks[0] + 1), own(c, v))[1])
    for algo in ("learned", "random_exp"):
        looks[0] = 0
        assert len(grouped.run_one(adj, algo, 0, 120.0, 10)) == 120
        assert looks[0] < 1000 * 120
    c = grouped.Crawl(grouped.Access(adj), "x", 0, 10)
    for k, row in enumerate(grouped.run_one(adj, "mod", 0, 60.0, 10)):
        c.query(row[4])
        if k % 10 == 9:
            value = lambda n: 0.3 + 1.5 * math.log1p(c.obs(n)) - 2.0 * c.cc(n) + 0.25 * math.log1p(sum(map(c.obs, c.near[n])) / c.obs(n))
            assert c.table().likeliest(__import__("numpy").array([0.3, 1.5, -2.0, 0.25]), value) == c.top(c.open, value)


def test_each_grouped_run_is_a_task_of_its_own(spark):
    e = canonical(spark.range(40).selectExpr("cast(id AS string) src", "cast((id * 7 + 1) % 40 AS string) dst"))
    algos = ["exp_den_0.2", "exp_den_0.5", "exp_den_0.7"]
    rows = grouped.crawl_all(e, algos, 2, 12.0).withColumn("task", F.spark_partition_id()).collect()
    task = {(r.algo, r.trial): r.task for r in rows}
    assert sorted(task) == [(a, t) for a in algos for t in range(2)] and len(set(task.values())) == 6
    adj = grouped.adjacency_of(e)
    assert [tuple(r)[:9] for r in sorted(rows, key=lambda r: (r.algo, r.trial, r.step))] == [r for a in algos for t in range(2) for r in grouped.run_one(adj, a, t, 12.0, 1 + t)]
