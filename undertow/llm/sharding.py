"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``nodes`` points of a ring.  A document's place is the hash of its text, and inside an arc it has a rank by
another hash of its text.  One pass over the texts stores ids, sizes and hashes.  Arc and rank give one of ``nodes x shards x ranks`` cells, so equal texts share a cell and
with it a shard.  Only a text whose copies weigh more than the slack of a shard is dealt out by the hash of the id, to
as many pieces as it weighs slacks; no more than ``shards / slack`` texts can.  The cells' loads - rows and bytes, one
aggregate over all rows - are all that the driver sees: their number is bounded by the parameters, not by the data.

The walk gives each cell to the owner of its arc while the load stays below ``(1 + slack)`` times the average;
a cell that would overflow continues clockwise to the next shard with room (to the emptiest shard if none has
room).  So the balance is guaranteed, and another shard takes over only its arcs and what overflowed.

Slots count the rows of a shard in ring order: cells have running starts, and only rows of one cell are ranked.

Edge cases: a NULL text has size 1 and crc32 0, and NULL and empty texts share a place; NULL ids are ranked
first in their cell; repeated rows get slots one after the other, and rows alike in id and text share a shard whatever
they weigh; a very long text is one row like others; an empty table gives an empty result; other columns, whatever their
names, are not looked at and stay as they are.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import fresh, q, stash

RING = 1 << 32
NODES = 16
RANKS = 1024
SLACK = 0.005


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(point, shard) in ring order; a shard's points do not depend on the other shards."""
    point = lambda s, k: int.from_bytes(blake2b(f"{s}/{k}".encode(), digest_size=4).digest(), "big")
    return sorted((point(s, k), s) for s in range(shards) for k in range(nodes))


def walk(points: list[tuple[int, int]], cells: list[tuple[int, ...]], shards: int, slack: float = SLACK) -> list[int]:
    """Shard of each cell (arc, rank, ..., load), handed out by rank and then along the ring."""
    owners = [s for _, s in points]
    cap = (1 + slack) * sum(c[-1] for c in cells) / shards
    load = [0] * shards
    given = [0] * len(cells)
    for i in sorted(range(len(cells)), key=lambda i: (cells[i][1], cells[i][0], cells[i])):
        arc, size = cells[i][0], cells[i][-1]
        open_ = [s for s in range(shards) if load[s] + size <= cap]
        if open_:
            at = arc
            while owners[at % len(owners)] not in open_:
                at += 1
            shard = owners[at % len(owners)]
        else:
            shard = min(range(shards), key=lambda s: (load[s], s))
        given[i] = shard
        load[shard] += size
    return given


def placed(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", *, nodes: int = NODES, ranks: int = RANKS, slack: float = SLACK, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and a last struct column: size, text_crc32, shard, slot."""
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    arc, rank, piece, out, shard, start, heavy = fresh(docs, "_arc", "_rank", "_piece", "placed", "_shard", "_start", "_heavy")
    points = ring(shards, nodes)
    whole = F.coalesce(q(text), F.lit(""))
    place, name = F.pmod(F.xxhash64(whole), F.lit(RING)), F.xxhash64(F.lit(1), whole)
    ends = F.array(*[F.lit(p) for p, _ in points])

    def known(d: DataFrame, columns: list[str]) -> DataFrame:
        size = (F.octet_length(whole) + 1).cast("long")
        read = F.struct(place.alias("place"), name.alias("name"), size.alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"))
        # one row each: the text is hashed once, not once per point of the ring
        d = d.select(*[q(c) for c in columns], F.explode(F.array(read)).alias(out))
        # the arc that ends at the first point not below the place; beyond the last point the ring begins again
        index = (F.size(F.filter(ends, lambda p: p < F.col(f"{out}.place"))) % len(points)).cast("int")
        cell = F.struct(index.alias("arc"), F.pmod(f"{out}.name", F.lit(ranks)).cast("int").alias("rank"))
        # one row each; the join below must not infer filters from how the cell is computed
        d = d.select(*[q(c) for c in columns], out, F.explode(F.array(cell)).alias(arc))
        return d.select(
            *[q(c) for c in columns], F.struct(f"{out}.size", f"{out}.text_crc32").alias(out),
            F.col(f"{out}.name").alias(heavy), F.col(f"{arc}.rank").alias(rank), F.col(f"{arc}.arc").alias(arc),
        )

    def loads(d: DataFrame, *by: str):
        sums = d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(f"{out}.size").alias("load")).toArrow()
        return sorted(zip(*[sums.column(i).to_pylist() for i in range(len(by) + 2)]))

    narrow = stash(known(docs, [key]), "shards")  # ids, sizes and hashes: the texts are read once for all that follows
    cells = [(a, r, 0, n, load) for a, r, n, load in loads(narrow, arc, rank)]
    most = slack * sum(c[-1] for c in cells) / shards
    full = [(a, r) for a, r, _, _, load in cells if load > most]  # at most shards / slack cells, and as many texts in them
    pieces = F.lit(0)
    if full:
        inside = narrow.filter(F.struct(F.col(arc).alias("a"), F.col(rank).alias("r")).isin([F.struct(F.lit(a).cast("int").alias("a"), F.lit(r).cast("int").alias("r")) for a, r in full]))
        sums = inside.groupBy(heavy).agg(F.sum(f"{out}.size").alias("load")).filter(F.col("load") > most).toArrow()
        into = {h: 4 * ceil(load / most) for h, load in zip(*[c.to_pylist() for c in sums.columns])}
        if into:
            parts = F.element_at(F.create_map(*[F.lit(x).cast("long") for x in chain.from_iterable(into.items())]), F.col(heavy))
            pieces = F.coalesce(F.lit(1) + F.pmod(F.xxhash64(q(key).cast("string")), parts), F.lit(0))
            cells = loads(narrow.withColumn(piece, pieces.cast("int")), arc, rank, piece)
    given = walk(points, cells, shards, slack)
    starts, upto = [], [0] * shards
    for (_, _, _, rows, _), s in zip(cells, given):
        starts.append(upto[s])
        upto[s] += rows
    table = pa.table({
        **{c: pa.array([x[k] for x in cells], pa.int32()) for k, c in enumerate((arc, rank, piece))},
        shard: pa.array(given, pa.int32()), start: pa.array(starts, pa.int64()),
    })
    plan = F.broadcast(spark.createDataFrame(table))  # at most shards x nodes x ranks rows, and the pieces
    order = Window.partitionBy(arc, rank, piece).orderBy(q(key).asc_nulls_first(), F.col(out)["text_crc32"], F.col(out)["size"])
    slot = F.col(start) + F.row_number().over(order) - 1
    rows = narrow if set(keep) <= {key} else known(docs, list(dict.fromkeys([*keep, key])))  # other columns are read where they lie
    rows = rows.withColumn(piece, pieces.cast("int")).join(plan, [arc, rank, piece])
    return rows.select(*[q(c) for c in keep], F.struct(f"{out}.size", f"{out}.text_crc32", F.col(shard).alias("shard"), slot.alias("slot")).alias(out))


def sharding_query(docs: DataFrame, shards: int = 8) -> DataFrame:
    rows = placed(docs.select("doc_id", "text"), shards, keep=["doc_id"])
    return rows.select("doc_id", "placed.size", "placed.text_crc32", F.lit("bytes").alias("law"), "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard"))
