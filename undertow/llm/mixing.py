"""Mixing sources to target weights by Pareto order sampling.

Targets: sources weigh 5, 2, 1, 5, ... in code-point order and share all words; no target exceeds
``most_copies`` times its source, and what is cut off is shared again by weight (water filling, solved from
prefix sums over the table of sources).

Inside a source a document's expected copies are proportional to its appeal - here 2^(k/4) for a text of
2^k words, so that longer texts are somewhat preferred - capped at ``most_copies`` and scaled so that the
expected words meet the target.  The whole part of the expectation is certain; the fraction p is an
inclusion probability.  Documents are then ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the front of that order is taken (Pareto sampling).  The fixed size of the
sample is a number of words: the cut lies where the words taken come closest to what is left of the target.

No source is sorted in one task: the order is cut into ``SPLIT`` x ``SPLIT`` value cells, whose sums are added
first; only the rows of the one cell that holds the cut are ranked one by one.

Edge cases: NULL or empty texts have size 0 and are never taken; a NULL source is a source of its own, last in
order; repeated rows (same id and text) get the same random number and follow each other; an empty table
gives an empty result.  Other columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import attach_summary, fresh, q, stash, word_list

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SPLIT = 512


def filled(rows: DataFrame, by: list[str], amount: str, weight: str, total: Column, out: str) -> DataFrame:
    """Level L with sum(min(MOST_COPIES, L * weight / amount) * amount) = total inside ``by``.

    ``rows`` is a summary (one row per source, or per source and length class); rows are capped in the order of
    cap over weight, and the level is the first one that caps no further row.
    """
    cap = MOST_COPIES * F.col(amount)
    order = Window.partitionBy(*by).orderBy(cap / F.col(weight), weight)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(after)
    first = F.when(level <= cap / F.col(weight) * (1 + 1e-12), cap / F.col(weight))
    rows = rows.withColumn("_level", level).withColumn("_first", first)
    return rows.withColumn(out, F.min_by("_level", "_first").over(Window.partitionBy(*by))).drop("_level", "_first")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: a summary with one row per source (exact sums)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("_all", F.sum("source_size").over(every))
    some = filled(s.filter("source_size > 0").withColumn("_one", F.lit(0)), ["_one"], "source_size", "weight", F.col("_all"), "level")
    target = F.least(MOST_COPIES * F.col("source_size").cast("double"), F.col("level") * F.col("weight"))
    none = s.filter("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target"))
    return some.select("source", "source_size", target.alias("target")).unionByName(none)


def measure(docs: DataFrame, text: str, source: str, key: str, seed: int, out: str) -> DataFrame:
    """``docs`` with a struct column: source, size in words, length class, random number u, tie key."""
    name = F.xxhash64(F.lit(seed), q(key).cast("string"), q(text))
    u = (F.pmod(name, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    size = F.size(word_list(q(text))).cast("long")
    (n,) = fresh(docs, "_size")
    d = docs.withColumn(n, size)
    length = F.when(F.col(n) > 0, F.floor(F.log2(n))).otherwise(-1).cast("int")
    made = F.struct(q(source).alias("source"), F.col(n).alias("size"), length.alias("class"), u.alias("u"), F.xxhash64(q(text), name).alias("tie"))
    return d.select(*[q(c) for c in docs.columns], made.alias(out))


def pareto(d: Column, p: Column) -> Column:
    """Random odds over inclusion odds, folded into [0, 1): only the order counts."""
    rank = (d["u"] / (1 - d["u"])) / (p / (1 - p))
    return F.when(p > 0, rank / (1 + rank))


def cells(v: Column) -> tuple[Column, Column]:
    first = F.floor(v * SPLIT)
    return first, F.floor((v * SPLIT - first) * SPLIT)


def schedule(sizes: DataFrame) -> DataFrame:
    """What decides each document: one row per source and length class, from all rows of ``sizes``.

    source, class, source_size, target, whole, p, and the cut of the source's order: the cells at_c1, at_c2 and
    the last (v, tie) taken in them.
    """
    goals = stash(source_targets(sizes), "targets")
    same = F.col("g.source").eqNullSafe(F.col("d.source"))
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("amount")).alias("d").join(goals.alias("g"), same)
    classes = stash(classes.select("d.source", "class", F.col("amount").cast("double").alias("amount"), "source_size", "target"), "classes")
    appeal = F.pow(F.lit(2.0), F.col("class") / 4)
    levels = filled(classes.filter("amount > 0").withColumn("pull", appeal * F.col("amount")), ["source"], "amount", "pull", F.col("target"), "level")
    expect = F.least(F.lit(float(MOST_COPIES)), F.col("level") * appeal)
    whole = F.floor(expect + 1e-9)
    plan = levels.select("source", "class", "amount", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), expect - whole).alias("p"))
    plan = plan.unionByName(classes.filter("amount = 0").select("*", F.lit(0).cast("long").alias("whole"), F.lit(0.0).alias("p")))
    sure = F.sum(F.col("whole") * F.col("amount")).over(Window.partitionBy("source"))
    plan = stash(plan.withColumn("open", F.col("target") - sure).drop("amount"), "plan")

    v = pareto(F.struct("d.u"), F.col("g.p"))
    drawn = attach_summary(sizes.filter("size > 0"), plan.filter("p > 0"), "source", "class")
    drawn = drawn.select("d.source", "d.size", "d.tie", "g.open", v.alias("v"))
    c1, c2 = cells(F.col("v"))
    drawn = stash(drawn.withColumn("c1", c1).withColumn("c2", c2), "drawn")

    def crossing(rows: DataFrame, cell: str) -> DataFrame:
        """Per source the cell that holds the cut, and the words still open where it begins."""
        sums = rows.groupBy("source", cell).agg(F.sum("size").alias("words"), F.max("open").alias("open"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
        at = sums.withColumn("open", F.col("open") - F.coalesce(before, F.lit(0))).filter("open > 0")
        return stash(at.groupBy("source").agg(F.max(cell).alias(f"at_{cell}"), F.min("open").alias("open")), f"cut-{cell}")

    first = crossing(drawn, "c1")
    inner = attach_summary(drawn, first, "source").filter("d.c1 = g.at_c1").select("d.source", "d.size", "d.tie", "d.v", "d.c1", "d.c2", "g.open")
    second = crossing(inner, "c2")
    edge = attach_summary(inner, second, "source").filter("d.c2 = g.at_c2").select("d.source", "d.size", "d.tie", "d.v", "g.open")
    # rows alike in id and text share (v, tie): they count as one step of the order, and as many of them go in as fit;
    # the document that crosses the line goes where the sum ends up closer
    steps = edge.groupBy("source", "v", "tie", "size").agg(F.count(F.lit(1)).alias("rows"), F.max("open").alias("open"))
    order = Window.partitionBy("source").orderBy("v", "tie").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("open") - F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0))
    inside = steps.withColumn("fit", F.least("rows", F.floor(left / F.col("size") + 0.5))).filter("fit > 0")
    last = inside.groupBy("source").agg(F.max(F.struct("v", "tie", "fit", "rows")).alias("last"))
    cut = first.drop("open").alias("d").join(second.drop("open").alias("g"), same, "left").select("d.*", "at_c2")
    cut = cut.alias("d").join(last.alias("g"), same, "left").select("d.*", "last")
    return stash(plan.drop("open").alias("d").join(cut.alias("g"), same, "left").select("d.*", "at_c1", "at_c2", "last"), "schedule")


def with_copies(measured: DataFrame, plan: DataFrame, at: str, out: str) -> DataFrame:
    """Adds ``out``: struct of source_size, target and copies. Rows stay where they are.

    Only where rows alike in id and text are cut in two are they numbered: by their place in a stored copy, part by part.
    """
    names = [c for c in measured.columns if c != at]
    split = plan.filter("last.rows > last.fit")
    cut_in_two = not split.isEmpty()
    if cut_in_two:
        (place,) = fresh(measured, "_place")
        measured = stash(measured.withColumn(place, F.monotonically_increasing_id()), "placed")
    d = F.col(f"d.`{at}`")
    joined = attach_summary(measured, plan, **{"source": d["source"], "class": d["class"]})
    v = pareto(d, F.col("g.p"))
    c1, c2 = cells(v)
    level = F.struct(c1.alias("c1"), c2.alias("c2"))
    line = F.struct(F.col("g.at_c1").alias("c1"), F.col("g.at_c2").alias("c2"))
    here, last = F.struct(v.alias("v"), d["tie"].alias("tie")), F.struct(F.col("g.last.v").alias("v"), F.col("g.last.tie").alias("tie"))
    front = (level < line) | ((level == line) & (here <= last))
    if cut_in_two:
        part = F.shiftright(F.col(f"d.`{place}`"), 33)  # the number of the part that holds the row
        same = joined.filter((level == line) & (here == last) & (F.col("g.last.rows") > F.col("g.last.fit")))
        same = stash(same.select(d["source"].alias("source"), F.col("g.last.fit").alias("fit"), part.alias("part"), F.col(f"d.`{place}`").alias("place")), "alike")
        counts = same.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
        ahead = counts.select("source", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        inside = F.row_number().over(Window.partitionBy("source", "part").orderBy("place"))
        late = attach_summary(same.withColumn("rank", inside), stash(ahead, "ahead"), "source", "part")
        late = stash(late.filter(F.col("d.rank") + F.col("g.ahead") > F.col("d.fit")).select("d.place"), "late")
        late = F.broadcast(late) if late.count() <= 1_000_000 else late
        joined = joined.join(late.select("place", F.lit(True).alias("late")).alias("l"), F.col(f"d.`{place}`") == F.col("l.place"), "left")
        front = front & F.col("l.late").isNull()
    copies = F.col("g.whole") + F.coalesce(front & v.isNotNull(), F.lit(False)).cast("long")
    return joined.select(*[F.col(f"d.`{c}`") for c in names], d.alias(at), F.struct("g.source_size", "g.target", copies.alias("copies")).alias(out))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """The mixed table: every document as often as the mix takes it, columns untouched; texts are never shuffled."""
    at, out = fresh(docs, "_measured", "_mix")
    sizes = stash(measure(docs.select(q(key), q(text), q(source)), text, source, key, seed, "_measured").select("_measured.*"), "sizes")
    rows = with_copies(measure(docs, text, source, key, seed, at), schedule(sizes), at, out).filter(F.col(out)["copies"] > 0)
    times = F.sequence(F.lit(1), F.col(out)["copies"].cast("int"))
    return rows.select(*[q(c) for c in docs.columns], F.explode(times).alias(at)).drop(at)


def mixing_query(docs: DataFrame) -> DataFrame:
    made = stash(measure(docs.select("doc_id", "text", "source"), "text", "source", "doc_id", 17, "_m").select("doc_id", "_m"), "sizes")
    rows = with_copies(made, schedule(made.select("_m.*")), "_m", "_mix")
    return rows.select("doc_id", "_m.size", "_mix.source_size", "_mix.target", (F.col("_mix.copies") * F.col("_m.size")).alias("taken"), "_m.source", "_mix.copies")
