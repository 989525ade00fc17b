"""Common table expressions of the checking SQL (DuckDB)."""

GRAPH = """
pe AS (SELECT event_type, user_id AS a, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b, event_id FROM events),
pl AS (SELECT DISTINCT CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS layer,
  least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS src, greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS dst FROM pe WHERE b IS NOT NULL AND a <> b),
e AS (SELECT src, dst FROM pl WHERE layer = 0),
adj AS (SELECT src AS id, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e),
deg AS (SELECT id, count(*) AS deg FROM adj GROUP BY id),
nm AS (SELECT (SELECT count(*) FROM deg) AS n, (SELECT count(*) FROM e) AS m),
part AS (SELECT id, CAST(CAST(id AS BIGINT) % 5 AS INTEGER) AS com FROM deg),
shut AS (SELECT id FROM deg WHERE CAST(id AS BIGINT) % 3 = 0),
cand AS (SELECT DISTINCT nbr AS id FROM adj WHERE id IN (SELECT id FROM shut) AND nbr NOT IN (SELECT id FROM shut))"""

CLUSTERING = """,
tri AS (SELECT x.id, count(*) / 2 AS tri FROM adj x JOIN adj y ON x.nbr = y.id JOIN e ON e.src = least(x.id, y.nbr) AND e.dst = greatest(x.id, y.nbr) WHERE x.id <> y.nbr GROUP BY x.id),
cc AS (SELECT deg.id, deg, CAST(coalesce(tri, 0) AS BIGINT) AS tri, CASE WHEN deg > 1 THEN 2.0 * coalesce(tri, 0) / (deg * (deg - 1)) ELSE 0.0 END AS cc FROM deg LEFT JOIN tri USING (id))"""

SPARSE = """
pe AS (SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b, event_id FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS src, greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS dst FROM pe WHERE b IS NOT NULL AND a <> b AND event_id % 17 = 0),
adj AS (SELECT src AS id, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e),
reach AS (SELECT DISTINCT id AS root, id FROM adj UNION SELECT r.root, a.nbr FROM reach r JOIN adj a ON a.id = r.id),
comp AS (SELECT root AS id, min(id) AS component FROM reach GROUP BY root)"""

TRIPARTITE = """
it AS (SELECT DISTINCT 'C' || o_custkey AS c, 'P' || l_partkey AS p, 'S' || l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT c AS src, p AS dst FROM it UNION SELECT c, s FROM it UNION SELECT p, s FROM it)"""


def over(*ctes: str, recursive: bool = False, then: str) -> str:
    if then.startswith("WITH "):
        ctes, then = (*ctes, ",\n" + then[5:]), ""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + "".join(ctes).lstrip() + "\n" + then


def pagerank(rounds: int, damping: float = 0.85) -> str:
    """Unrolled power iteration: the last table is pr{rounds}(id, rank)."""
    out = [",\npr0 AS (SELECT id, 1.0 / (SELECT n FROM nm) AS rank FROM deg)"]
    for i in range(1, rounds + 1):
        out.append(f",\npr{i} AS MATERIALIZED (SELECT adj.nbr AS id, {1 - damping} / (SELECT n FROM nm) + {damping} * sum(p.rank / deg.deg) AS rank FROM adj JOIN pr{i - 1} p ON p.id = adj.id JOIN deg ON deg.id = adj.id GROUP BY adj.nbr)")
    return "".join(out)
