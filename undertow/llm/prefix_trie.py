"""The trie of conversation prefixes, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  Its key is 128 bits: the exclusive or of hashes of (depth, role, text) along
the sequence, so keys are running totals (in chunks of ``CHUNK`` turns, whose totals are carried on: a giant conversation
is no single task), texts are hashed where they are read and never shuffled, and a parent's key is the node's without its
own turn.  Nodes are an aggregate over all turns, pre-aggregated before the shuffle, so a hot prefix is one row a task.

Totals flow upwards by time-forward processing:

1. **Shards.**  Nodes of more than ``C`` conversations (``C`` = all / ``SHARDS``, ``LEAST`` at least) are the top of the
   trie: no more than ``SHARDS`` of them at any depth.  What hangs below a top node falls apart into shards of at most
   ``C`` conversations, one for each child of a top node that is no top node itself.
2. **Within shards.**  Spark sorts the nodes externally by reverse level order inside each task.  A node takes what its
   children have sent off a priority queue, and sends its own totals to the time of its parent.  The queue's order is that of
   the nodes, it keeps ``QUEUE`` messages in memory and spills sorted runs of the rest to the task's temporary file.
3. **Across shard roots.**  The totals of shard roots are summed by parent and the top of the trie is processed likewise.

The ids that end at a node are sorted by range, joined to chunks and hashed chunk after chunk: no list is ever whole.

Edge cases: a NULL role or text is empty; a NULL turn comes first; turns of equal number are ordered by role, the text's first
64 characters and its hash, repeated rows count as often as they stand there; a NULL conv_id is no conversation and is left
out; an absent base gives no head; a conversation without turns after the rebuild is a member of the root only; an empty table
has no root and gives no row; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import heapq
import marshal
import tempfile
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import map_batches, q, stash
from undertow.operators import blocks
from undertow.session import attach

CHUNK = 4096  # turns whose keys one window computes
SHARDS, LEAST = 4096, 64
QUEUE = 200_000  # messages of a task's queue in memory
IDS = 4096  # ids of a chunk
MOST_HEAD = 5  # turns of a head
KEY = ["kx", "ky"]


def ordered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, pos (from 1), tx, ty (hashes of role and text), chars."""
    r, t = F.coalesce(q(role), F.lit("")), F.coalesce(q(text), F.lit(""))
    rows = turns.filter(q(conv).isNotNull()).select(
        q(conv).alias("conv_id"), q(turn).alias("turn"), r.alias("role"), F.substring(t, 1, 64).alias("head"),
        F.xxhash64(F.lit(1), r, t).alias("tx"), F.xxhash64(F.lit(2), t, r).alias("ty"), F.char_length(t).cast("long").alias("chars"),
    )
    at = blocks.positions(rows, ["conv_id"], ["turn", "role", "head", "tx", "ty"])
    return at.select("conv_id", "pos", "tx", "ty", "chars")


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations with the first turns of their hundred's first one: conv_id, depth, tx, ty, chars; a NULL depth names a conversation without turns."""
    base, h = F.col("conv_id") - F.col("conv_id") % 100, head_length(F.col("conv_id"))
    first = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") <= MOST_HEAD))
    lengths = first.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("have"))
    # one row of each conversation, and the rows behind its head
    own = turns.filter((F.col("pos") == 1) | (F.col("pos") > h)).withColumns({"base": base, "h": h})
    own = attach(own, lengths, ["base"], "left").withColumn("have", F.least("h", F.coalesce("have", F.lit(0))))
    tails = own.filter("pos > h").select("conv_id", (F.col("have") + F.col("pos") - F.col("h")).alias("depth"), "tx", "ty", "chars")
    asks = own.filter("pos = 1 and have > 0").select("conv_id", "base", "have")
    gives = first.select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "tx", "ty", "chars")
    heads = asks.join(gives, "base").filter("depth <= have").select("conv_id", "depth", "tx", "ty", "chars")
    none = own.filter("pos = 1").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("depth", "tx", "ty", "chars")])
    return tails.unionByName(heads).unionByName(none)


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds the keys of node (kx, ky) and parent (px, py)."""
    x, y = F.xxhash64("depth", "tx"), F.xxhash64("depth", "ty")
    rows = rows.select("conv_id", "depth", "chars", x.alias("x"), y.alias("y"), F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"))
    along = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = stash(rows.select("*", F.bit_xor("x").over(along).alias("kx"), F.bit_xor("y").over(along).alias("ky")), "turns")
    ends = local.filter(F.col("depth") % CHUNK == 0)  # whole chunks only: what they hand on
    if not ends.isEmpty():
        before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
        ahead = ends.select("conv_id", (F.col("chunk") + 1).alias("chunk"), F.bit_xor("kx").over(before).alias("ax"), F.bit_xor("ky").over(before).alias("ay"))
        local = attach(local, ahead, ["conv_id", "chunk"], "left")
        local = local.withColumns({f"k{c}": F.col(f"k{c}").bitwiseXOR(F.coalesce(f"a{c}", F.lit(0))) for c in "xy"})
    return local.select("conv_id", "depth", "chars", *KEY, F.col("kx").bitwiseXOR(F.col("x")).alias("px"), F.col("ky").bitwiseXOR(F.col("y")).alias("py"))


class SpillingQueue:
    """A priority queue of tuples that keeps ``limit`` of them in memory and sorted runs of the others in a temporary file."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.file = max(2, limit), [], [], None

    def _read(self, run: list):
        """Next tuple of a run [next offset, end, tuples read backwards]."""
        if not run[2]:
            if run[0] >= run[1]:
                return None
            self.file.seek(run[0])
            run[2] = marshal.load(self.file)[::-1]
            run[0] = self.file.tell()
        return run[2].pop()

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            keep = self.limit // 2
            late, self.heap = self.heap[keep:], self.heap[:keep]
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            run = [self.file.tell(), 0, []]
            for k in range(0, len(late), 1024):
                marshal.dump(late[k : k + 1024], self.file)
            run[1] = self.file.tell()
            heapq.heappush(self.runs, (self._read(run), run))

    def head(self) -> tuple | None:
        spilled = self.runs[0][0] if self.runs else None
        if spilled is not None and (not self.heap or spilled < self.heap[0]):
            return spilled
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, run = self.runs[0]
            following = self._read(run)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, run))
            return item
        return heapq.heappop(self.heap)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


NODE = ["depth", "kx", "ky", "px", "py", "conv_id", "n_convs", "chars", "children", "leaves", "saved"]
DONE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, kx long, ky long, px long, py long, open boolean"


def forward(batches, *, limit: int = QUEUE):
    """Nodes in reverse level order -> nodes with totals; ``open`` where the parent is not among them.

    The columns children, leaves and saved hold what has arrived from elsewhere.
    """
    queue, out = SpillingQueue(limit), []
    names = [c.split()[0] for c in DONE.split(", ")]
    types = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in DONE.split(", ")]

    def emit(message: tuple, parent):
        level, px, py, kx, ky, conv, n, children, leaves, saved = message
        out.append((conv, 1 - level, parent, n, children, leaves, saved, kx, ky, px, py, parent is None))

    def flush():
        nonlocal out
        made, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    for batch in batches:
        for depth, kx, ky, px, py, conv, n, chars, children, leaves, saved in zip(*[c.to_pylist() for c in batch.columns]):
            here = (-depth, kx, ky)
            while (head := queue.head()) is not None and head[:3] <= here:
                message = queue.pop()
                if message[:3] < here:
                    emit(message, None)
                    continue
                emit(message, conv)
                children, leaves, saved = children + 1, leaves + message[8], saved + message[9]
            queue.push((1 - depth, px, py, kx, ky, conv, n, children, leaves or 1, saved + (n - 1) * chars))
        if len(out) >= 4096:
            yield flush()
    while queue.head() is not None:
        emit(queue.pop(), None)
        if len(out) >= 4096:
            yield flush()
    if out:
        yield flush()
    queue.close()


def totals(nodes: DataFrame, heard: DataFrame | None, *, limit: int = QUEUE) -> DataFrame:
    """Time-forward processing of nodes that are dealt by shard, or are the top."""
    zero = F.lit(0).cast("long")
    if heard is None:
        nodes = nodes.withColumns({"children": zero, "leaves": zero, "saved": zero})
    else:
        nodes = nodes.join(heard, KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("children", "leaves", "saved")})
    placed = nodes.repartition(1) if heard is not None else nodes.repartition("shard")
    ordered = placed.sortWithinPartitions(F.col("depth").desc(), *KEY).select(*NODE)
    return map_batches(ordered, lambda b: forward(b, limit=limit), DONE)


def chunked_ids(batches):
    """kx, ky, conv_id in order -> kx, ky, first id, ids of one key joined by commas."""
    key, ids, out = None, [], []

    def close():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))

    def flush():
        nonlocal out
        made, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "first", "ids"])

    for batch in batches:
        for kx, ky, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (kx, ky) or len(ids) >= IDS:
                close()
                key, ids = (kx, ky), []
            ids.append(conv)
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def digests(batches):
    """Chunks in order of key and first id -> kx, ky, ends_sha256."""
    key, digest = None, None
    for batch in batches:
        out = []
        for kx, ky, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (kx, ky):
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (kx, ky), sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=[*KEY, "ends_sha256"])


def prefix_trie(sequences: DataFrame, *, shards: int = SHARDS, least: int = LEAST, queue: int = QUEUE) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, depth from 1, tx, ty, chars; NULL depth: names a sequence), with subtree totals.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    sequences = stash(sequences, "sequences")
    names = sequences.filter("depth is null").select("conv_id")
    n, smallest = names.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    spark, empty = sequences.sparkSession, sha256(b"").hexdigest()
    rows = stash(with_keys(sequences.filter("depth is not null")), "prefixes")
    nodes = rows.groupBy(*KEY).agg(F.max("depth").alias("depth"), F.max("px").alias("px"), F.max("py").alias("py"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    nodes = stash(nodes, "nodes")
    root = spark.createDataFrame([(0, 0, 0, 0, 0, smallest, n, 0)] if n else [], "kx long, ky long, depth long, px long, py long, conv_id long, n_convs long, chars long")

    most = max(least, -(-n // shards))
    top = stash(nodes.filter(F.col("n_convs") > most).unionByName(root), "top")
    few = top.count() <= 1_000_000  # keys only; at most ``shards`` of them at any depth
    named = top.select(*KEY, F.col("conv_id").alias("top_conv"))
    send = F.broadcast if few else (lambda d: d)

    # a shard is named by its root: the first node of a conversation that is not at the top
    below = rows.join(send(named), KEY, "left_anti").groupBy("conv_id").agg(F.min_by("kx", "depth").alias("shard"))
    bottom = nodes.filter(F.col("n_convs") <= most).join(below, "conv_id")
    made = stash(totals(bottom, None, limit=queue), "shards")
    heard = made.filter("open").groupBy(F.col("px").alias("kx"), F.col("py").alias("ky")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    above = totals(top, heard, limit=queue)
    parent = named.select(F.col("kx").alias("px"), F.col("ky").alias("py"), "top_conv")
    roots = made.filter("open").join(send(parent), ["px", "py"]).withColumn("parent_conv_id", F.col("top_conv")).drop("top_conv")
    whole = made.filter("not open").unionByName(roots.select(made.columns)).unionByName(above)

    # where conversations end
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("at"))
    ends = names.join(last, "conv_id", "left").select(*[F.coalesce(F.col(f"at.{k}"), F.lit(0)).alias(k) for k in KEY], "conv_id")
    ends = stash(ends, "ends")
    lists = map_batches(ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id"), chunked_ids, "kx long, ky long, first long, ids string")
    hashed = map_batches(lists.repartition(*KEY).sortWithinPartitions(*KEY, "first"), digests, "kx long, ky long, ends_sha256 string")
    return whole.join(hashed, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def trie_query(turns: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt(stash(ordered_turns(turns, "conv_id", "turn", "role", "text"), "ordered")))
