"""Quality rules: a learned, ordered decision list over statistics of the text.

Sequential covering: one rule after the other is grown from labelled rows, condition by condition
(FOIL gain on the growing part), pruned back to the prefix that does best on the pruning part, and kept
while it is precise enough there; the rows it covers leave the table and the next rule starts.  Every
step is one aggregate over all labelled rows (feature x bin x part counts); the driver sees only those
counts.  The list becomes one ordered Spark conditional expression.

Only DataFrame functions: no Python touches a row.

Edge cases: a NULL or empty text has no word, all statistics 0, and fails the base; NULL ids are kept as
they are and never meet a label; repeated labels of one id count as the worst; rows with a NULL label do
not teach; without labels (or without bad ones) the list is empty and rejects nothing.  Repeated rows are
judged alike.  Other columns pass untouched, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import fold, fresh, q, stash, word_list

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic -> value from the struct of counts.
FEATURES = {
    "symbols_per_word": lambda c: c["n_symbols"] / F.greatest(c["n_words"], F.lit(1)),
    "upper_share": lambda c: c["n_upper"] / F.greatest(c["word_chars"], F.lit(1)),
    "digit_share": lambda c: c["n_digits"] / F.greatest(c["word_chars"], F.lit(1)),
    "mean_word": lambda c: c["word_chars"] / F.greatest(c["n_words"], F.lit(1)),
    "repeat_share": lambda c: c["n_repeat_words"] / F.greatest(c["n_words"], F.lit(1)),
    "dup_line_share": lambda c: c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
    "words_per_line": lambda c: c["n_words"] / F.greatest(c["n_lines"], F.lit(1)),
    "n_words": lambda c: c["n_words"].cast("double"),
}


def with_counts(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out``: the base counts and what the features need.

    Repeated windows are found by their 64-bit hash inside the row: most texts have none, which a hash set
    shows; only the others sort their windows to find the positions that repeat.
    """
    t, w, lines, h, s, p = fresh(docs, "_t", "_w", "_lines", "_h", "_s", "_p")
    keep = [q(c) for c in docs.columns]
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    d = docs.select(*keep, F.coalesce(q(text), F.lit("")).alias(t))
    d = d.select(
        *keep,
        word_list(F.col(t)).alias(w),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.struct(
            left(r"[\x20\x09-\x0D]+").alias("chars"), left(r"[^#*$%&|<>]+").alias("symbols"),
            left("[^A-Z]+").alias("upper"), left("[^0-9]+").alias("digits"),
        ).alias(t),
    )
    window = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WINDOW)]))
    d = d.select(
        *keep,
        F.struct(F.col(f"{t}.*"), F.size(w).alias("words"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("different")).alias(t),
        F.when(F.size(w) >= WINDOW, window).alias(h),
    )
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select(*keep, t, F.when(F.size(F.array_distinct(h)) < F.size(h), pairs).alias(s))
    twin = lambda x, i: (F.get(F.col(s), i - 1)["h"] == x["h"]) | (F.get(F.col(s), i + 1)["h"] == x["h"])
    again = F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.get(F.col(s), F.when(i > 0, i - 1).otherwise(i + 1))["h"] == x["h"]))
    d = d.select(*keep, t, F.when(F.col(s).isNotNull(), F.array_sort(F.transform(again, lambda x: x["i"]))).alias(p))
    ahead = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), i + 1) - x, F.lit(WINDOW))))
    return d.select(
        *keep,
        F.explode(F.array(F.struct(
            F.col(f"{t}.words").cast("long").alias("n_words"),
            F.col(f"{t}.chars").cast("long").alias("word_chars"),
            F.col(f"{t}.symbols").cast("long").alias("n_symbols"),
            (F.col(f"{t}.lines") - F.col(f"{t}.different")).cast("long").alias("n_dup_lines"),
            F.coalesce(F.aggregate(ahead, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.col(f"{t}.lines").cast("long").alias("n_lines"),
            F.col(f"{t}.upper").cast("long").alias("n_upper"),
            F.col(f"{t}.digits").cast("long").alias("n_digits"),
        ))).alias(out),  # one row each; a filter on the counts must not be unfolded into the steps above
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, counts: Column) -> Column:
        value = FEATURES[self.feature](counts)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def conjunction(rule: Rule, counts: Column) -> Column:
    whole = F.lit(True)
    for condition in rule:
        whole = whole & condition.column(counts)
    return whole


def verdict(rules: list[Rule], counts: Column) -> Column:
    """Number of the first rule that rejects the row, from 1; NULL if none does."""
    chain = None
    for k, rule in enumerate(rules, 1):
        hit = conjunction(rule, counts)
        chain = F.when(hit, k) if chain is None else chain.when(hit, k)
    return F.lit(None).cast("int") if chain is None else chain


def learn_rules(
    labelled: DataFrame, counts: str = "counts", bad: str = "bad", part: str = "part", *,
    bins: int = 16, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.9, support: int = 3,
) -> list[Rule]:
    """The decision list from all rows of ``labelled`` (counts struct, bad 0/1, part 0: grow, 1: prune)."""
    c = F.col(counts)
    names = list(FEATURES)
    edges = labelled.agg(*[F.percentile_approx(FEATURES[n](c), [i / bins for i in range(bins)], 1000).alias(n) for n in names]).first()
    # a bad minority has its own range of values, which cut points of all rows would miss
    rare = labelled.filter(F.col(bad) == 1).agg(*[F.percentile_approx(FEATURES[n](c), [i / bins for i in range(bins)], 1000).alias(n) for n in names]).first()
    cuts = {n: sorted({*map(float, edges[n] or []), *map(float, rare[n] or [])}) for n in names}
    place = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts[n])).cast("array<double>"), lambda x: x < FEATURES[n](c)))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), place(n).alias("b")) for k, n in enumerate(names)]))

    def tally(rules: list[Rule], grown: Rule) -> tuple[dict, dict]:
        """Per (part, feature, bin): good and bad rows left by the rules and inside the conjunction; per part: totals."""
        rest = labelled.filter(verdict(rules, c).isNull() & conjunction(grown, c))
        rows = rest.select(part, bad, cells.alias("cell")).groupBy(part, "cell.f", "cell.b").agg(F.sum(F.col(bad)).alias("p"), F.sum(1 - F.col(bad)).alias("n")).collect()
        cell, total = {}, {0: [0, 0], 1: [0, 0]}
        for r in rows:  # at most parts x features x bins
            cell[r[part], r["f"], r["b"]] = (r["p"], r["n"])
            if r["f"] == 0:
                total[r[part]][0] += r["p"]
                total[r[part]][1] += r["n"]
        return cell, total

    rules: list[Rule] = []
    while len(rules) < most_rules:
        grown: Rule = ()
        cell, total = tally(rules, grown)
        prefixes: list[tuple[float, int, Rule]] = []
        while len(grown) < most_conditions and total[0][0] >= support and total[0][1]:
            best = None
            p0, n0 = total[0]
            for k, name in enumerate(names):
                for j, cut in enumerate(cuts[name]):
                    for above in (False, True):
                        inside = [(g, b) for g in (0, 1) for b in range(len(cuts[name]) + 1) if (b > j) == above]
                        sums = {g: [sum(cell.get((g, k, b), (0, 0))[z] for gg, b in inside if gg == g) for z in (0, 1)] for g in (0, 1)}
                        p, n = sums[0]
                        if p >= support and n < n0:
                            gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                            if best is None or gain > best[0]:
                                best = (gain, Condition(name, above, cut), sums)
            if best is None or best[0] <= 1e-9:
                break
            grown = (*grown, best[1])
            p, n = best[2][1]
            prefixes.append(((p - n) / (p + n) if p + n else -1.0, p, grown))
            if len(grown) < most_conditions and best[2][0][1]:
                cell, total = tally(rules, grown)
            else:
                break
        if not prefixes:
            break
        worth, p, rule = max(prefixes, key=lambda x: (round(x[0], 9), x[1], -len(x[2])))
        if p < 1 or (worth + 1) / 2 < precision:
            break
        rules.append(rule)
    return rules


def labelled_counts(made: DataFrame, labels: DataFrame, counts: str = "counts", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows of ``made`` (key, counts) that have a label: bad is 1 where the worst label is 0."""
    worst = labels.filter(q(label).isNotNull() & q(key).isNotNull()).groupBy(q(key).alias("_key")).agg((F.min(q(label)) == 0).cast("int").alias("bad"))
    rows = made.filter(~base_failed(F.col(counts))).join(worst, q(key) == F.col("_key"))
    return rows.select(F.col(counts), "bad", (fold(q(key), 3) == 2).cast("int").alias("part"))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, counts and the rule that rejects each row: counts once, learned from, then judged."""
    made = stash(with_counts(docs.select(q(key), q(text)), text, "counts").select(q(key), "counts"), "counts")
    rules = learn_rules(stash(labelled_counts(made, labels, key=key), "labelled"))
    return made.withColumn("rule", verdict(rules, F.col("counts")))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that neither the base nor the learned list rejects, columns untouched."""
    made = with_counts(docs.select(q(key), q(text)), text, "counts").select(q(key), "counts")
    rules = learn_rules(stash(labelled_counts(made, labels, key=key), "labelled"))
    (out,) = fresh(docs, "_counts")
    c = F.col(out)
    return with_counts(docs, text, out).filter(~base_failed(c) & verdict(rules, c).isNull()).select(*[q(x) for x in docs.columns])


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    c = F.col("counts")
    return judged(docs, labels).select(
        "doc_id", *[c[n].alias(n) for n in COUNTS], base_failed(c).alias("base_failed"), (~base_failed(c) & F.col("rule").isNull()).alias("kept"), "rule",
    )
