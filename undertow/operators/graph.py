"""Metrics of weighted directed graphs held as edges (src, dst, weight) and nodes (node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators import blocks
from undertow.session import cut_lineage


def spill_edges(pairwise: DataFrame, *, times: float = 1.5, both_directions: bool = False) -> DataFrame:
    """Pairs whose net effect exceeds ``times`` population std of all cells (diagonal included).

    Net effects are antisymmetric, so by default only the positive cell of a
    pair becomes an edge transmitter -> receiver.
    """
    level = pairwise.groupBy("window_id").agg((F.stddev_pop("net") * times).alias("_level"))
    kept = pairwise.join(level, "window_id").filter((F.col("src") != F.col("dst")) & (F.abs("net") > F.col("_level")))
    if not both_directions:
        kept = kept.filter("net > 0")
    return kept.select(
        "window_id", "src", "dst", F.abs("net").alias("weight"), F.when(F.col("net") > 0, "positive").otherwise("negative").alias("kind")
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def weighted_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """In, out and net weight per node; isolated nodes have zeros."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.col("weight").alias("o"), F.lit(0.0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.col("weight").alias("i")),
            )
        )
    )
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node", F.lit(0.0).alias("o"), F.lit(0.0).alias("i")))
    g = ends.groupBy("node").agg(F.sum("i").alias("in_weight"), F.sum("o").alias("out_weight"))
    return g.withColumn("net_weight", F.col("out_weight") - F.col("in_weight"))


def pagerank(
    edges: DataFrame, nodes: DataFrame | None = None, *, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, stride: int = 10
) -> DataFrame:
    """Weighted PageRank with dangling mass spread evenly.

    A round is one join on src and one sum by dst; sums combine before the
    shuffle, so a node with most of the edges stays cheap.  Teleport and
    dangling mass both add the same amount to every node, so ``stride`` rounds
    run without knowing that amount: the powers of the link matrix applied to
    the ranks and (once) to the even vector are kept per node, their sums are
    read back, and the amounts of the whole stride follow from the ranks adding
    up to 1.  Lineage is cut and convergence tested once per stride;
    ``tolerance=None`` runs exactly ``rounds`` rounds.
    """
    names = nodes_of(edges) if nodes is None else nodes.select("node")
    names = cut_lineage(names)
    n = names.count()
    if n == 0:
        return names.withColumn("rank", F.lit(0.0))
    flows = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = flows.groupBy("src").agg(F.sum("weight").alias("_total"))
    shares = flows.join(out.filter("_total > 0"), "src").select("src", "dst", (F.col("weight") / F.col("_total") * alpha).alias("share"))
    keep = names.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("share"))
    links = cut_lineage(shares.unionByName(keep))  # a NULL share hands a node's history to itself

    def powers(start: DataFrame, k: int) -> DataFrame:
        """(node, z): the vector and its k images under the links."""
        state = start.select("node", F.array("rank").alias("z"))
        for _ in range(k):
            sent = links.join(state, links.src == state.node)
            state = sent.groupBy("dst").agg(
                F.sum(F.col("share") * F.element_at("z", -1)).alias("_in"), F.collect_list(F.when(F.col("share").isNull(), F.col("z"))).alias("_z")
            ).select(F.col("dst").alias("node"), F.array_append(F.get("_z", F.lit(0)), F.coalesce("_in", F.lit(0.0))).alias("z"))
        return cut_lineage(state)

    def sums(state: DataFrame, k: int) -> list[float]:
        return list(state.agg(*[F.sum(F.get("z", F.lit(j))).alias(f"m{j}") for j in range(k + 1)]).first())

    ranks, even, even_sums, done = names.withColumn("rank", F.lit(1.0 / n)), None, None, 0
    while done < rounds:
        k = min(stride, rounds - done)
        state = powers(ranks, k)
        mass = sums(state, k)
        if even is None:
            even, even_sums = state.select("node", F.col("z").alias("a")), mass
        added: list[float] = []
        for j in range(k):
            added.append(1.0 - mass[j + 1] - sum(added[i] * even_sums[j - i] for i in range(j)))

        def image(j: int):
            total = F.get("z", F.lit(j))
            for i in range(j):
                total = total + F.get("a", F.lit(j - 1 - i)) * added[i]
            return total

        ranks = state.join(even, "node").select("node", image(k).alias("rank"), F.abs(image(k) - image(k - 1)).alias("_moved"))
        done += k
        if tolerance is not None and ranks.agg(F.sum("_moved")).first()[0] < n * tolerance:
            break
    return ranks.select("node", "rank")


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair with its largest weight."""
    return (
        edges.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.max("weight").alias("w"))
    )


def weighted_clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Geometric mean of the normalised weights of each triangle, averaged over neighbour pairs.

    Pairs are oriented from the lower to the higher degree before wedges are
    formed, so a hub never enumerates the pairs of its own neighbours.
    """
    pairs = undirected(edges)
    top = pairs.agg(F.max("w")).scalar()
    pairs = cut_lineage(pairs.withColumn("w", F.col("w") / top))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    da = degree.select(F.col("node").alias("a"), F.col("d").alias("_da"))
    db = degree.select(F.col("node").alias("b"), F.col("d").alias("_db"))
    up = F.struct("_da", "a") < F.struct("_db", "b")
    oriented = pairs.join(da, "a").join(db, "b").select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"), "w",
        F.when(up, F.col("_db")).otherwise(F.col("_da")).alias("dh"),
    )
    one = oriented.select("low", F.col("high").alias("x"), F.col("w").alias("w1"), F.col("dh").alias("dx"))
    two = oriented.select("low", F.col("high").alias("y"), F.col("w").alias("w2"), F.col("dh").alias("dy"))
    wedges = one.join(two, "low").filter(F.struct("dx", "x") < F.struct("dy", "y"))
    closing = oriented.select(F.col("low").alias("x"), F.col("high").alias("y"), F.col("w").alias("w3"))
    triangles = wedges.join(closing, ["x", "y"]).select(
        F.explode(F.array("low", "x", "y")).alias("node"), F.pow(F.col("w1") * F.col("w2") * F.col("w3"), 1.0 / 3).alias("t")
    )
    sums = triangles.groupBy("node").agg(F.sum("t").alias("_t"))
    every = degree if nodes is None else nodes.select("node").join(degree, "node", "left").na.fill(0, ["d"])
    return every.join(sums, "node", "left").select(
        "node", F.when(F.col("d") >= 2, 2 * F.coalesce("_t", F.lit(0.0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering")
    )


STATE = 10_000_000  # rows (source, node) that one batch of sources may hold


def betweenness(edges: DataFrame, nodes: DataFrame | None = None, *, weight_is_distance: bool = False, state: int = STATE) -> DataFrame:
    """Normalised weighted betweenness of every node.

    Sources are handled in batches of ``state / n``, so that the table (source, node) stays bounded; what a batch adds
    to the nodes is one row per node.  Inside a batch, distances relax until nothing changes, then path counts run
    down the shortest-path edges and dependencies run back up, hop by hop.
    Distance is 1/weight unless ``weight_is_distance``; a length that is not positive fails the job.
    """
    names = cut_lineage(nodes_of(edges) if nodes is None else nodes.select("node").distinct())
    n = names.count()
    length = F.col("weight") if weight_is_distance else 1 / F.nullif(F.col("weight"), F.lit(0.0))
    arcs = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(length).alias("len"), F.min(F.coalesce(length > 0, F.lit(False))).alias("_ok"))
    fine = F.when(F.col("_ok"), F.col("len")).otherwise(F.raise_error(F.lit("betweenness needs positive lengths")))
    arcs = cut_lineage(arcs.select("src", "dst", fine.alias("len")))
    batches = max(1, -(-n * n // max(state, n)))
    if batches == 1:
        parts = [_dependencies(names, arcs)]
    else:
        sources = cut_lineage(blocks.positions(names, [], ["node"], name="_p").select("node", (F.col("_p") % batches).alias("_b")))
        parts = [_dependencies(sources.filter(F.col("_b") == b).select("node"), arcs) for b in range(batches)]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    score = total.groupBy("v").agg(F.sum("b").alias("_b"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return names.join(score, names.node == score.v, "left").select("node", (F.coalesce("_b", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(v, b): what the shortest paths from ``sources`` add to each node between their ends."""
    dist = cut_lineage(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0.0).alias("d")))
    fresh = dist
    while True:
        offers = fresh.join(arcs.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("dst").alias("v")).agg(
            F.min(F.col("d") + F.col("len")).alias("_d")
        )
        merged = dist.join(offers, ["s", "v"], "full")
        better = F.col("d").isNull() | (F.col("_d") < F.col("d"))
        merged = cut_lineage(
            merged.select("s", "v", F.coalesce(F.least("d", "_d"), "d", "_d").alias("d"), (F.col("_d").isNotNull() & better).alias("_new"))
        )
        dist, fresh = merged.select("s", "v", "d"), merged.filter("_new").select("s", "v", "d")
        if fresh.isEmpty():
            break
    # Edges on shortest paths, per source.
    near = dist.select("s", F.col("v").alias("src"), F.col("d").alias("_du"))
    far = dist.select("s", F.col("v").alias("dst"), F.col("d").alias("_dv"))
    dag = cut_lineage(near.join(arcs, "src").join(far, ["s", "dst"]).filter("_du + len = _dv").select("s", "src", "dst"))
    # Number of shortest paths: paths of h hops, summed over h.
    hop = sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("c"))
    parts, h = [hop], 0
    while True:
        step = dag.withColumnRenamed("src", "v")
        hop = hop.join(step, ["s", "v"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("c").alias("c"))
        hop, h = cut_lineage(hop), h + 1
        if hop.isEmpty():
            break
        parts.append(hop)
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    sigma = cut_lineage(counted.groupBy("s", "v").agg(F.sum("c").alias("sigma")))
    # Dependencies: 1/sigma of the ends travels back along the same edges.
    flow = sigma.filter("s <> v").select("s", "v", (1 / F.col("sigma")).alias("g"))
    back = []
    while True:
        step = dag.withColumnRenamed("dst", "v")
        flow = flow.join(step, ["s", "v"]).groupBy("s", F.col("src").alias("v")).agg(F.sum("g").alias("g"))
        flow = cut_lineage(flow.filter("s <> v"))
        if flow.isEmpty():
            break
        back.append(flow)
    total = back[0] if back else flow
    for part in back[1:]:
        total = total.unionByName(part)
    return cut_lineage(total.groupBy("s", "v").agg(F.sum("g").alias("g")).join(sigma, ["s", "v"]).groupBy("v").agg(F.sum(F.col("g") * F.col("sigma")).alias("b")))


def graph_counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes, edges and density m / (n (n - 1))."""
    names = nodes_of(edges) if nodes is None else nodes
    n = names.agg(F.count(F.lit(1))).scalar()
    row = edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("nodes", n)
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return row.withColumn("density", F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0))


def component_labels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Smallest reachable node name per node, ignoring direction.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so chains shorten geometrically.
    """
    names = nodes_of(edges) if nodes is None else nodes.select("node")
    links = cut_lineage(
        edges.select(F.inline(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))).distinct()
    )
    labels = cut_lineage(names.withColumn("label", F.col("node")))
    while True:
        heard = links.join(labels, links.v == labels.node).groupBy("u").agg(F.min("label").alias("_m"))
        lower = labels.join(heard, labels.node == heard.u, "left").select("node", "label", F.least("label", "_m").alias("_low"))
        jump = labels.select(F.col("node").alias("_low"), F.col("label").alias("_far"))
        new = cut_lineage(lower.join(jump, "_low").select("node", F.least("_low", "_far").alias("label"), (F.least("_low", "_far") < F.col("label")).alias("_moved")))
        moved = not new.filter("_moved").isEmpty()
        labels = new.select("node", "label")
        if not moved:
            return labels


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return component_labels(edges, nodes).groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def node_table(edges: DataFrame, nodes: DataFrame | None = None, *, net: DataFrame | None = None, with_betweenness: bool = True, rank_options: dict | None = None) -> DataFrame:
    """All metrics per node; ``net`` (node, net) defaults to the net weight. The edges are computed once."""
    edges = cut_lineage(edges)
    table = weighted_degree(edges, nodes)
    table = table.join(pagerank(edges, nodes, **(rank_options or {})), "node", "left").join(weighted_clustering(edges, nodes), "node", "left")
    if with_betweenness:
        table = table.join(betweenness(edges, nodes), "node", "left")
    table = table.withColumnRenamed("net_weight", "net") if net is None else table.drop("net_weight").join(net, "node", "left")
    return table.withColumns({"size": F.abs("net"), "kind": F.when(F.col("net") > 0, "transmitter").otherwise("receiver")})
