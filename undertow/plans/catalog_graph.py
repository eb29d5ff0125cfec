"""Graph metrics as checked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import graph, transmission
from undertow.plans.catalog_series import SHARE, region_shares
from undertow.plans.registry import R, query, r, rounded
from undertow.sources.tables import FLOWS


@query(
    "spill_edges",
    f"""WITH {SHARE}, level AS (SELECT 1.5 * stddev_pop(net) AS l FROM pairwise)
    SELECT 0::BIGINT AS window_id, src, dst, {R('abs(net)')} AS weight, 'positive' AS kind FROM pairwise, level WHERE src <> dst AND net > l""",
)
def _(t):
    return rounded(graph.spill_edges(transmission.spill_pairwise(region_shares(t))))


@query(
    "spill_edges_both",
    f"""WITH {SHARE}, level AS (SELECT 1.5 * stddev_pop(net) AS l FROM pairwise)
    SELECT 0::BIGINT AS window_id, src, dst, {R('abs(net)')} AS weight, CASE WHEN net > 0 THEN 'positive' ELSE 'negative' END AS kind FROM pairwise, level WHERE src <> dst AND abs(net) > l""",
)
def _(t):
    return rounded(graph.spill_edges(transmission.spill_pairwise(region_shares(t)), both_directions=True))


DEGREE = """degree AS (SELECT node, sum(i) AS in_weight, sum(o) AS out_weight, sum(o) - sum(i) AS net_weight FROM (SELECT src AS node, 0 AS i, weight AS o FROM edges UNION ALL SELECT dst, weight, 0 FROM edges) GROUP BY 1)"""


@query("weighted_degree", f"WITH {FLOWS}, {DEGREE} SELECT node, {R('in_weight', 2)} AS in_weight, {R('out_weight', 2)} AS out_weight, {R('net_weight', 2)} AS net_weight FROM degree")
def _(t):
    return rounded(graph.weighted_degree(t.flows), 2)


ROUNDS = 10


def rank_sql(edges="edges"):
    parts = [
        f"nodes AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges})",
        f"links AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {edges})",
        "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)",
    ]
    for i in range(1, ROUNDS + 1):
        parts.append(
            f"""r{i} AS MATERIALIZED (SELECT n.node, 0.85 * (coalesce(x.s, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM links)) / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes) AS rank
            FROM nodes n LEFT JOIN (SELECT dst, sum(share * rank) AS s FROM links JOIN r{i - 1} ON src = node GROUP BY 1) x ON x.dst = n.node)"""
        )
    return ", ".join(parts)


@query("pagerank", f"WITH {FLOWS}, {rank_sql('strong')} SELECT node, {R(f'rank', 9)} AS rank FROM r{ROUNDS}")
def _(t):
    return rounded(graph.pagerank(t.strong_flows, rounds=ROUNDS, tolerance=None), 9)


@query("pagerank_converged")
def _(t):
    return rounded(graph.pagerank(t.flows), 6)


CLUSTER = """und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM edges GROUP BY 1, 2), nw AS (SELECT a, b, w / (SELECT max(w) FROM und) AS w FROM und),
  sym AS (SELECT a, b, w FROM nw UNION ALL SELECT b, a, w FROM nw), deg AS (SELECT a AS node, count(*) AS d FROM sym GROUP BY 1),
  tri AS (SELECT x.a AS node, sum(pow(x.w * y.w * z.w, 1.0 / 3)) AS s FROM sym x JOIN sym y ON x.a = y.a AND x.b < y.b JOIN nw z ON z.a = x.b AND z.b = y.b GROUP BY 1),
  clustering AS (SELECT node, CASE WHEN d >= 2 THEN 2 * coalesce(s, 0) / (d * (d - 1)) ELSE 0 END AS clustering FROM deg LEFT JOIN tri USING (node))"""


@query("weighted_clustering", f"WITH {FLOWS}, {CLUSTER} SELECT node, {R('clustering', 9)} AS clustering FROM clustering")
def _(t):
    return rounded(graph.weighted_clustering(t.flows), 9)


HOPS = 7


def between_sql(edges="edges"):
    parts = [
        f"arcs AS (SELECT src, dst, 1 / weight AS len FROM {edges})",
        f"nd AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges})",
        "d0 AS MATERIALIZED (SELECT node AS s, node AS v, 0.0::DOUBLE AS d FROM nd)",
    ]
    for i in range(1, HOPS + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT s, v, min(d) AS d FROM (SELECT s, v, d FROM d{i - 1} UNION ALL SELECT s, dst, d + len FROM d{i - 1} JOIN arcs ON v = src) GROUP BY 1, 2)")
    parts.append(f"dag AS MATERIALIZED (SELECT a.s, src, dst FROM d{HOPS} a JOIN arcs ON a.v = src JOIN d{HOPS} b ON b.s = a.s AND b.v = dst WHERE a.d + len = b.d)")
    parts.append("p0 AS (SELECT node AS s, node AS v, 1.0::DOUBLE AS c FROM nd)")
    for i in range(1, HOPS + 1):
        parts.append(f"p{i} AS MATERIALIZED (SELECT dag.s, dst AS v, sum(c) AS c FROM p{i - 1} p JOIN dag ON p.s = dag.s AND p.v = dag.src GROUP BY 1, 2)")
    parts.append("sigma AS MATERIALIZED (SELECT s, v, sum(c) AS sigma FROM (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(HOPS + 1)) + ") GROUP BY 1, 2)")
    parts.append("x0 AS (SELECT s, v, 1 / sigma AS g FROM sigma WHERE s <> v)")
    for i in range(1, HOPS + 1):
        parts.append(f"x{i} AS MATERIALIZED (SELECT dag.s, src AS v, sum(g) AS g FROM x{i - 1} x JOIN dag ON x.s = dag.s AND x.v = dag.dst WHERE src <> dag.s GROUP BY 1, 2)")
    parts.append(
        "between AS (SELECT node, coalesce(b, 0) / ((SELECT count(*) FROM nd) - 1) / ((SELECT count(*) FROM nd) - 2) AS betweenness FROM nd LEFT JOIN (SELECT v, sum(g * sigma) AS b FROM ("
        + " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(1, HOPS + 1))
        + ") JOIN sigma USING (s, v) GROUP BY 1) ON v = node)"
    )
    return ", ".join(parts)


@query("betweenness", f"WITH {FLOWS}, {between_sql('strong')} SELECT node, {R('betweenness', 9)} AS betweenness FROM between")
def _(t):
    return rounded(graph.betweenness(t.strong_flows), 9)


COUNTS = "SELECT count(*)::BIGINT AS edges, (SELECT count(*) FROM (SELECT src FROM {e} UNION SELECT dst FROM {e}))::BIGINT AS nodes FROM {e}"


@query("graph_counts", f"WITH {FLOWS}, c AS ({COUNTS.format(e='edges')}) SELECT edges, nodes, {R('edges / (nodes * (nodes - 1))')} AS density FROM c")
def _(t):
    return rounded(graph.graph_counts(t.flows))


@query(
    "weak_components",
    f"""WITH RECURSIVE {FLOWS}, n AS (SELECT n_name AS node FROM nation), link AS (SELECT src AS u, dst AS v FROM strong UNION SELECT dst, src FROM strong),
    reach(u, v) AS (SELECT node, node FROM n UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u), lab AS (SELECT u, min(v) AS label FROM reach GROUP BY 1)
    SELECT label, count(*)::BIGINT AS size FROM lab GROUP BY 1""",
)
def _(t):
    nodes = t.raw("nation").select(F.col("n_name").alias("node"))
    return graph.weak_components(t.strong_flows, nodes)


@query(
    "node_table",
    f"""WITH {FLOWS}, {DEGREE}, {rank_sql()}, {CLUSTER}, {between_sql()} SELECT degree.node, {R('in_weight', 2)} AS in_weight, {R('out_weight', 2)} AS out_weight, {R('net_weight', 2)} AS net,
    {R('rank', 9)} AS rank, {R('clustering', 9)} AS clustering, {R('betweenness', 9)} AS betweenness, {R('abs(net_weight)', 2)} AS size, CASE WHEN net_weight > 0 THEN 'transmitter' ELSE 'receiver' END AS kind
    FROM degree JOIN r{ROUNDS} USING (node) JOIN clustering USING (node) JOIN between USING (node)""",
)
def _(t):
    n = graph.node_table(t.flows, rank_options={"rounds": ROUNDS, "tolerance": None})
    return n.select(
        "node", *[r(c, 2).alias(c) for c in ("in_weight", "out_weight", "net", "size")], *[r(c, 9).alias(c) for c in ("rank", "clustering", "betweenness")], "kind"
    )
