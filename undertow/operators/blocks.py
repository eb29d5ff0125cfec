"""Ordered computations over series of any length.

A plain ``Window.partitionBy(series)`` sends a whole series to one task, and one
series (or one hour) may hold a third of all rows.  The helpers here cut the
rows into blocks of about equal size along their order, work inside
``(series, block)`` and repair the block edges exactly:

* ``even_block`` - block number along an order, from cut points of a small sample;
* ``running``    - running totals: block totals are summed ahead of the blocks;
* ``positions``  - running row number;
* ``first_rows`` - whether a row is among the first c, without ordering the table;
* ``previous``   - the value of the row before;
* ``carry``      - last known value, handed from block to block;
* ``over_rows``  - row frames: each block also receives the few rows before/after it;
* ``time_sums``  - sums over time frames of any width, from running totals (linear);
* ``time_moments`` - moments over time frames, linear and without differences of totals;
* ``quantiles``  - exact interpolated quantiles from value counts.

The only un-blocked windows are over the block *summaries*: one row per series
and block.  Data that fits one block skips the summaries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.session import attach, cut_lineage, match

HOUR = 3600
DAY = 24 * HOUR
ROWS_PER_BLOCK = 2_000_000
MOST_BLOCKS = 16_384


def time_block(ts: str, seconds: int = DAY) -> Column:
    """Number of the time block of width ``seconds`` that holds ``ts``."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def even_block(df: DataFrame, order: Sequence[str], rows: int | None = None) -> Column | None:
    """Block number that grows with ``order``; None when one block is enough.

    Cut points come from a hash sample of at most a few values per block, so no
    block - and no (series, block) - holds much more than ``rows`` rows, however
    the rows crowd in time or in one series.  They are fixed in the plan: every
    stage, also a recomputed one, sees the same blocks.
    """
    n = df.count()
    blocks = min(MOST_BLOCKS, ceil(n / (rows or ROWS_PER_BLOCK)))
    if blocks <= 1:
        return None
    point = [F.unix_micros(c).alias(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c) for c in order]
    every = max(1, n // (blocks * 8))
    sample = df.select(*point).na.drop().filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).distinct().orderBy(*order)
    values = [tuple(row) for row in sample.collect()]  # bounded: about 8 per block
    step = max(1, len(values) // blocks)
    cuts = values[step::step]
    if not cuts:
        return None
    wide = max(1, int(len(cuts) ** 0.5))

    def table(points):
        """The points as one constant array."""
        rows = [dict(zip(order, p)) for p in points]
        return F.from_json(F.lit(json.dumps(rows, default=str)), T.ArrayType(sample.schema))

    here = F.struct(*point)
    below = lambda array: F.size(F.filter(array, lambda c: c < here))
    coarse = below(table(cuts[wide - 1 :: wide])) * wide  # this many cut points lie below, found in steps
    return coarse + below(F.slice(table(cuts), coarse + 1, F.lit(wide)))


def value_block(df: DataFrame, value: str, n: int | None = None) -> Column:
    """Block number that grows with ``value``: n blocks of about equal size, by default one per ``ROWS_PER_BLOCK`` and 64 at least.

    The n cut points come from one sketch pass and are fixed in the plan.
    """
    n = n or max(64, ceil(df.count() / ROWS_PER_BLOCK))
    probs = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(value, probs, max(1000, 10 * n))).first()[0] or []
    fixed = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    return F.size(F.filter(fixed, lambda c: c < F.col(value)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    block: Column | None = None,
    peers: bool = False,
    most: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums of ``totals`` and running maxima of ``most`` along ``order`` inside ``keys``.

    ``block`` must not decrease along ``order``; by default rows are cut evenly.
    With ``peers`` rows of equal order count together.
    """
    keys = list(keys)
    steps = {n: (F.sum, c) for n, c in totals.items()} | {n: (F.max, c) for n, c in (most or {}).items()}
    block = even_block(df, order) if block is None else block

    def window(*by):
        w = Window.partitionBy(*by).orderBy(*order)
        return (w.rangeBetween if peers else w.rowsBetween)(Window.unboundedPreceding, 0)

    if block is None:
        return df.select("*", *[f(c).over(window(*keys)).alias(n) for n, (f, c) in steps.items()])
    blocked = df.withColumn("_block", block)
    sums = blocked.groupBy(*keys, "_block").agg(*[f(c).alias(f"_sum_{n}") for n, (f, c) in steps.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*keys, "_block", *[f(f"_sum_{n}").over(before).alias(f"_ahead_{n}") for n, (f, _) in steps.items()])
    local = blocked.select("*", *[f(c).over(window(*keys, "_block")).alias(f"_local_{n}") for n, (f, c) in steps.items()])
    joined = match(local, ahead, [*keys, "_block"])
    here, past = (lambda n: F.col(f"_local_{n}")), (lambda n: F.col(f"_ahead_{n}"))
    made = [(here(n) + F.coalesce(past(n), F.lit(0)) if f is F.sum else F.greatest(here(n), past(n))).alias(n) for n, (f, _) in steps.items()]
    return joined.select(*df.columns, *made)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None, name: str = "pos"
) -> DataFrame:
    """Add the 1-based position of each row in its series."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, block)


def first_rows(df: DataFrame, order: Sequence[str], counts: Iterable[int], block: Column | None = None) -> tuple[DataFrame, dict[int, Column]]:
    """Per count c a condition that holds for the first c rows along ``order``, and the rows to which it applies.

    Rows are counted per block and only the blocks that a count cuts are ordered, so a condition is a comparison with the key of one
    row.  Where a cut would part rows of equal keys, every row gets its position instead.
    """
    point = [F.unix_micros(F.col(c).cast("timestamp")) if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(c) for c in order]
    block = even_block(df, order) if block is None else block
    number = F.lit(0) if block is None else F.coalesce(block.cast("long"), F.lit(-(2**62)))  # rows without a time come first
    keyed = df.select(number.cast("long").alias("_block"), *[c.alias(f"_k{i}") for i, c in enumerate(point)])
    sizes = sorted(tuple(r) for r in keyed.groupBy("_block").count().collect())  # bounded: one row per block
    n = sum(size for _, size in sizes)
    made = {c: F.lit(c >= n) for c in counts if c <= 0 or c >= n}
    wanted, start = [], 0
    for at, size in sizes:
        wanted += [(at, c - start + 1, c) for c in counts if start <= c < start + size and c not in made]
        start += size
    if not wanted:
        return df, made
    key = F.struct(*[f"_k{i}" for i in range(len(point))])
    w = Window.partitionBy("_block").orderBy(*[f"_k{i}" for i in range(len(point))])
    cut = keyed.filter(F.col("_block").isin([at for at, _, _ in wanted]))
    cut = cut.select("*", F.row_number().over(w).alias("_row"), F.lag(key).over(w).eqNullSafe(key).alias("_tie"))
    cut = cut.filter(reduce(or_, [(F.col("_block") == at) & (F.col("_row") == row) for at, row, _ in wanted]))
    found = {(r["_block"], r["_row"]): r for r in cut.collect()}  # one row per count
    if any(r["_tie"] for r in found.values()):
        placed = positions(df, [], order, block, "_pos")
        return placed, {c: F.col("_pos") <= c for c in counts}
    for at, row, c in wanted:
        edge = [F.lit(found[at, row][f"_k{i}"]).cast(keyed.schema[f"_k{i}"].dataType) for i in range(len(point))]
        made[c] = F.struct(*point) < F.struct(*edge)
    return df, made


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], block: Column | None = None
) -> DataFrame:
    """Add, per new name, a column's value on the row before (along ``order``, inside ``keys``)."""
    keys = list(keys)
    block = even_block(df, order) if block is None else block
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(n) for n, c in values.items()])
    blocked = df.withColumn("_block", block)
    row = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    ends = blocked.groupBy(*keys, "_block").agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    joined = match(blocked.select("*", F.lag(row).over(inside).alias("_before")), ends, [*keys, "_block"])
    joined = joined.withColumn("_before", F.coalesce("_before", "_end"))
    return joined.select(*df.columns, *[F.col(f"_before.{n}").alias(n) for n in values])


def carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], block: Column | None = None
) -> DataFrame:
    """Add, per new name, the last non-null value of a column up to and including the row."""
    keys = list(keys)
    block = even_block(df, order) if block is None else block
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in values.items()])
    blocked = df.withColumn("_block", block)
    stamp = F.struct(*[F.col(c) for c in order])
    lasts = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(f"_last_{n}") for n, c in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = lasts.select(
        *keys, "_block", *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_from_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select(
        "*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_in_{n}") for n, c in values.items()]
    )
    joined = match(local, handed, [*keys, "_block"])
    return joined.select(*df.columns, *[F.coalesce(f"_in_{n}", f"_from_{n}").alias(n) for n in values])


def over_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Callable[[Callable[[int, int], object]], Mapping[str, Column]],
    *,
    block: Column | None = None,
    back: int = 0,
    ahead: int = 0,
    rows: int = ROWS_PER_BLOCK,
    keep_position: bool = False,
) -> DataFrame:
    """Add row-frame expressions, ``back`` rows before and ``ahead`` rows after.

    ``columns`` receives ``frame(lo, hi)`` (a window over row offsets) and the
    plain ordered window under ``frame.ordered``.
    """
    keys = list(keys)
    rows = max(rows, back, ahead, 1)
    numbered = positions(df, keys, order, block, "_pos")
    home = F.floor((F.col("_pos") - 1) / rows)
    first = F.greatest(F.floor((F.col("_pos") - 1 - ahead) / rows), F.lit(0))
    last = F.floor((F.col("_pos") - 1 + back) / rows)
    spread = numbered.withColumn("_home", home).withColumn("_part", F.explode(F.sequence(first, last)))
    base = Window.partitionBy(*keys, "_part").orderBy("_pos")

    def frame(lo: int, hi: int):
        return base.rowsBetween(lo, hi)

    frame.ordered = base
    made = columns(frame)
    out = spread.select("*", *[c.alias(n) for n, c in made.items()]).filter("_part = _home")
    extra = [F.col("_pos").alias("pos")] if keep_position else []
    return out.select(*df.columns, *extra, *made)


def time_sums(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    totals: Mapping[str, Column],
    spans: Mapping[str, int],
    block: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Add sums of ``totals`` over [ts - span, ts] to every row: columns <total>_<span>.

    Rows of one instant are added up first.  Every instant then travels also as
    one probe per span to the moment before its frame opens; a frame is the
    running total at the instant minus the one at the probe.  The cost is linear
    whatever the width of the frame.
    """
    keys, names = list(keys), list(totals)
    timed = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    instants = timed.groupBy(*keys, "_at").agg(*[F.sum(totals[n].cast("double")).alias(n) for n in names])
    stops = [F.struct(F.lit("").alias("_tag"), F.col("_at").alias("_us"), F.lit(1.0).alias("_own"))]
    stops += [F.struct(F.lit(tag).alias("_tag"), (F.col("_at") - span * 1_000_000 - 1).alias("_us"), F.lit(0.0).alias("_own")) for tag, span in spans.items()]
    stream = instants.select(*keys, "_at", *names, F.inline(F.array(*stops)))
    run = running(
        stream, keys, ["_us"], {f"_p_{n}": F.col(n) * F.col("_own") for n in names}, None if block is None else block("_us"), peers=True
    )
    at = lambda tag, n: F.max(F.when(F.col("_tag") == tag, F.col(f"_p_{n}")))
    made = [f"{n}_{tag}" for tag in spans for n in names]
    frames = run.groupBy(*keys, "_at").agg(*[(at("", n) - at(tag, n)).alias(f"{n}_{tag}") for tag in spans for n in names])
    return match(timed, frames, [*keys, "_at"]).select(*df.columns, *made)


def _central(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> tuple[Column, ...]:
    """Mean and central sums of powers 2 to 4, from power sums about any point; zeros without values."""
    m = F.when(n > 0, s1 / n).otherwise(0.0)
    return m, s2 - n * m**2, s3 - 3 * m * s2 + 2 * n * m**3, s4 - 4 * m * s3 + 6 * m**2 * s2 - 3 * n * m**4


def time_moments(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, spans: Mapping[str, int], block: Callable[[str], Column] | None = None
) -> DataFrame:
    """Add n, mean, m2, m3, m4 (central sums), low and high of ``value`` over [ts - span, ts]: columns <name>_<span>.

    Time is cut into parts as wide as the span, so a frame is the end of one part and the beginning of the next:
    a running total backwards and one forwards, merged by the rules for central moments.  Nothing is taken off a
    longer total, so values outside a frame leave no trace in it; powers are about a median of their part, so
    neither large offsets nor small units cost digits.  Linear at any width, and parts with many rows run in blocks.
    Rows without a time have no frame (NULL); rows without a value have the frame of the others.

    Instants are stored once, whatever the number of spans.  Every instant asks at the opening of its frame for the total
    behind it, and takes the answer along to the part it lies in, where the second total is added.
    """
    keys, powers, group = list(keys), ["n", "s1", "s2", "s3", "s4"], [*keys, "_tag", "_in"]
    width = {tag: span * 1_000_000 for tag, span in spans.items()}
    tags = F.array(*[F.struct(F.lit(tag).alias("_tag"), F.lit(us).cast("long").alias("_span")) for tag, us in width.items()])
    slot, least = "_slot", min(width.values())
    timed = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = timed.filter("_at is not null").select(*keys, "_at", F.col(value).cast("double").alias("_x"), (F.col("_at") - F.pmod("_at", F.lit(least))).alias(slot))
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    slots = cut_lineage(rows.groupBy(*keys, slot).agg(median("_x").alias("_m")))
    reached = F.array_distinct(F.transform(F.array(F.col(slot), F.col(slot) + (least - 1)), lambda us: us - F.pmod(us, F.col("_span"))))
    centers = slots.select("*", F.inline(tags)).select(*keys, "_tag", "_m", F.explode(reached).alias("_in")).groupBy(*group).agg(F.coalesce(median("_m"), F.lit(0.0)).alias("_c"))
    d = F.col("_x") - F.col("_m")
    instants = cut_lineage(attach(rows, slots, [*keys, slot]).groupBy(*keys, "_at").agg(
        F.coalesce(F.first("_m"), F.lit(0.0)).alias("_m"), F.count("_x").cast("double").alias("n"),
        *[F.coalesce(F.sum(d**k), F.lit(0.0)).alias(f"s{k}") for k in range(1, 5)], F.max("_x").alias("_high"), F.max(-F.col("_x")).alias("_low"),
    ))
    tagged = instants.select("*", F.inline(tags)).withColumn("_in", F.col("_at") - F.pmod("_at", "_span"))
    e, n, s1, s2, s3, s4 = F.col("_m") - F.col("_c"), *(F.col(c) for c in powers)
    about = {"s1": s1 + n * e, "s2": s2 + 2 * e * s1 + n * e**2, "s3": s3 + 3 * e * s2 + 3 * e**2 * s1 + n * e**3, "s4": s4 + 4 * e * s3 + 6 * e**2 * s2 + 4 * e**3 * s1 + n * e**4}
    tagged = attach(tagged, centers, group).withColumns(about).select(*group, "_span", "_at", *powers, "_high", "_low", "_c")
    here = F.struct(F.col("_in").alias("_to"), F.col("_at").alias("_us"), F.lit(True).alias("_own"))
    opens = F.struct((F.col("_in") - F.col("_span")).alias("_to"), (F.col("_at") - F.col("_span")).alias("_us"), F.lit(False).alias("_own"))
    asked = tagged.select("*", F.inline(F.array(here, opens))).withColumnsRenamed({"_in": "_part", "_to": "_in"}).withColumn("_down", -F.col("_us"))
    cut = even_block(asked.select("_us"), ["_us"]) if block is None else block("_us")

    def run(stream, summed, side, order, most, cut):
        """At every row of ``stream`` the totals of its own rows so far; ``summed`` has these own rows, and a row in every block."""
        own = lambda c: F.when(F.col("_own"), F.col(c))
        steps = {f"{side}{c}": (F.sum, F.coalesce(own(c), F.lit(0.0))) for c in powers} | {f"{side}{c}": (F.max, own(c)) for c in most}
        within = group if cut is None else [*group, "_block"]
        w = Window.partitionBy(*within).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        blocked = (lambda rows: rows) if cut is None else (lambda rows: rows.withColumn("_block", cut))
        local = blocked(stream).select("*", *[f(c).over(w).alias(name) for name, (f, c) in steps.items()])
        if cut is None:
            return local
        before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = blocked(summed).groupBy(*within).agg(*[f(c).alias(name) for name, (f, c) in steps.items()])
        ahead = sums.select(*within, *[f(name).over(before).alias(f"_ahead_{name}") for name, (f, _) in steps.items()])
        both = {name: F.col(name) + F.coalesce(f"_ahead_{name}", F.lit(0.0)) if f is F.sum else F.greatest(name, f"_ahead_{name}") for name, (f, _) in steps.items()}
        return attach(local, ahead, within).withColumns(both).drop("_block", *[f"_ahead_{name}" for name in steps])

    behind = run(asked, asked, "a", "_down", ["_high", "_low", "_c"], None if cut is None else -cut).filter(~F.col("_own"))
    answers = behind.select(*keys, "_tag", F.col("_part").alias("_in"), F.col("_at").alias("_us"), F.lit(False).alias("_own"), "_c", *[f"a{c}" for c in (*powers, "_high", "_low", "_c")])
    own = tagged.select(*group, F.col("_at").alias("_us"), F.lit(True).alias("_own"), "_c", *powers, "_high", "_low")
    stream = own.unionByName(answers, allowMissingColumns=True)
    frames = run(stream, own, "b", "_us", ["_high", "_low"], cut).filter(~F.col("_own")).withColumnsRenamed({"_c": "b_c", "_us": "_at"}).drop(*powers)
    (am, a2, a3, a4), (bm, b2, b3, b4) = (_central(*[F.col(side + c) for c in powers]) for side in "ab")
    frames = frames.withColumns({"am": am, "a2": a2, "a3": a3, "a4": a4, "bm": bm, "b2": b2, "b3": b3, "b4": b4, "n": F.col("an") + F.col("bn")})
    both = (F.col("an") > 0) & (F.col("bn") > 0)
    frames = frames.withColumn("d", F.when(both, F.col("b_c") - F.col("a_c") + F.col("bm") - F.col("am")).otherwise(0.0))
    a, b, n, d = F.col("an"), F.col("bn"), F.nullif(F.col("n"), F.lit(0.0)), F.col("d")
    a2, a3, a4, b2, b3, b4 = (F.col(c) for c in ("a2", "a3", "a4", "b2", "b3", "b4"))
    merged = {
        "n": F.col("n"),
        "mean": F.when(a > 0, F.col("a_c") + (F.col("am") + d * b / n)).otherwise(F.col("b_c") + F.col("bm")),
        "m2": a2 + b2 + d**2 * a * b / n,
        "m3": a3 + b3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * b2 - b * a2) / n,
        "m4": a4 + b4 + d**4 * a * b * (a * a - a * b + b * b) / n**3 + 6 * d**2 * (a * a * b2 + b * b * a2) / n**2 + 4 * d * (a * b3 - b * a3) / n,
        "low": -F.greatest("a_low", "b_low"), "high": F.greatest("a_high", "b_high"),
    }
    place = F.struct(*keys, "_at").alias("_place")  # one key in which NULL equals NULL: grouping and join share an exchange
    told = frames.select(place, "_tag", *[c.alias(name) for name, c in merged.items()])
    wide = told.groupBy("_place").agg(*[F.max(F.when(F.col("_tag") == tag, F.col(name))).alias(f"{name}_{tag}") for tag in spans for name in merged])
    return timed.select("*", place).join(wide, "_place", "left").select(*df.columns, *[f"{name}_{tag}" for tag in spans for name in merged])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], blocks: int | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per ``keys``: one row per group.

    Equal values are counted before anything is ordered, so copies cost nothing,
    and the ordering runs over value blocks instead of one task per group.
    """
    keys = list(keys)
    counts = cut_lineage(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = running(counts, keys, ["_v"], {"_cum": F.col("_c")}, value_block(counts, "_v", blocks))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        ranked = attach(ranked, sizes, keys)
        n = F.col("_n")
    else:
        n = sizes.scalar()
    made = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (n - 1)
        for tag, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            holds = (F.col("_cum") - F.col("_c") <= at) & (at < F.col("_cum"))
            made.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}_{tag}"))
        made.append(F.max(h - F.floor(h)).alias(f"_{name}_w"))
    wide = ranked.groupBy(*keys).agg(*made)
    return wide.select(
        *keys,
        *[
            (F.col(f"_{q}_lo") + (F.col(f"_{q}_hi") - F.col(f"_{q}_lo")) * F.col(f"_{q}_w")).alias(q)
            for q in probs
        ],
    )
