"""Near-duplicates by MinHash with odd sketches.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes).  Texts with the same set are one
   class from here on, known by the digest of its set; ids only name the components at the end.
2. A class has ``BANDS`` x ``ROWS`` one-permutation MinHash samples (bins of the hash range; an empty bin borrows the
   sample of a bin chosen by hash, alike in every text).  ``FINE`` more samples fold into an odd sketch: one bit per hashed
   (bin, sample), where an even number of hits cancels out.  The population count of the XOR of two sketches
   estimates how many samples differ, most exactly where few do.
3. Classes that agree in a band are candidates.  In each bucket every class is first compared with one pivot, the first in
   one order of all classes, so a group of n near copies names about n pairs over all bands, not n^2.  Sketches discard what is
   clearly different; what remains is confirmed on the full sets.  Links join into components.
4. A bucket of several components contracts to one row per component.  What is outside of its largest component meets another
   member of that; new links join components, not classes, so nothing is labelled twice.
5. What is even then outside of a bucket's largest component meets every member of the other components of the bucket, so no
   candidate is lost; a pair inside one component cannot change the result and needs no look.

At the limit of 85 % the chance that no band of a linked pair agrees is (1 - 0.85^8)^48 = 2e-7.  Another limit takes as many
bands as that chance needs (84 at 80 %), and a margin of as many standard deviations for its sketches.

Edge cases: NULL and word-less texts have an empty set, link with nothing and are their own component; a text below
five words is one shingle, and a text of any length is taken whole; repeated rows share class and component, and are both kept
if their id is the smallest; rows of one id with several texts link by each of them; a NULL id never names a component
unless the whole component has none (then component_id is NULL); tables may be empty; other columns, whatever their names, are
not looked at and stay as they are.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import fresh, map_batches, q, stash, texts_of
from undertow.operators.graph import component_labels

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 48, 8
FINE = 1536  # samples of a sketch
SKETCH_WORDS = 32  # of 64 bits
MARGIN = 0.055  # of similarity at 85 %, between sketch and full sets: about five standard deviations
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TRIES = 64
MORE_PIVOTS = 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public domain constants of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def borrowed(k: int) -> np.ndarray:
    """(try, bin) -> the bin of ``k`` to borrow from."""
    with np.errstate(over="ignore"):
        return (mixed(np.arange(TRIES * k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11)) % np.uint64(k)).astype(np.int64).reshape(TRIES, k)


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n = len(words) - SHINGLE + 1
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h = mixed(h + one[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def samples(hashes: np.ndarray, from_: np.ndarray) -> np.ndarray:
    """One MinHash sample per bin (``from_``: where empty bins of so many borrow)."""
    bins = from_.shape[1]
    at = np.searchsorted(hashes, (np.arange(bins, dtype=np.float64) * (2.0**64 / bins)).astype(np.uint64))
    got = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < np.r_[at[1:], len(hashes)])
    value = np.where(full, got, np.uint64(0))
    empty = np.flatnonzero(~full)
    for k in range(TRIES):
        if not empty.size:
            return value
        source = from_[k][empty]
        ok = full[source]
        value[empty[ok]] = value[source[ok]]
        empty = empty[~ok]
    with np.errstate(over="ignore"):
        salt = mixed((empty + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # almost empty texts
        value[empty] = hashes[np.argmin(mixed(hashes[None, :] ^ salt[:, None]), axis=1)]
    return value


def bands_for(percent: int) -> int:
    """Bands that miss a pair at the limit no more often than ``BANDS`` do at ``PERCENT``."""
    missed = lambda p: np.log1p(-((p / 100) ** ROWS))
    return BANDS if percent == PERCENT else 1 if percent >= 100 else int(np.ceil(BANDS * missed(PERCENT) / missed(percent)))


def signatures(batches, *, n_bands: int = BANDS):
    """id, text, row -> id, row, n_shingles, class (digest of the set), band hashes, odd sketch."""
    k = n_bands * ROWS
    from_, fine = borrowed(k), borrowed(FINE)
    bin_, fine_bin = mixed(np.arange(1, k + 1, dtype=np.uint64)), mixed(np.arange(1, FINE + 1, dtype=np.uint64))
    band = mixed(np.arange(7, n_bands + 7, dtype=np.uint64))
    for batch in batches:
        count, digest, bands, sketches = [], [], [], []
        for text in texts_of(batch, 1):
            h = shingles(text)
            count.append(len(h))
            digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            if not len(h):
                bands.append(None)
                sketches.append(None)
                continue
            with np.errstate(over="ignore"):
                v = mixed(samples(h, from_) ^ bin_)
                key = band.copy()
                for column in v.reshape(n_bands, ROWS).T:
                    key = mixed(key + column)
            v = mixed(samples(h, fine) ^ fine_bin)
            bits = np.bincount((v >> np.uint64(11)).astype(np.int64) % (SKETCH_WORDS * 64), minlength=SKETCH_WORDS * 64) & 1
            bands.append(key.view(np.int64))
            sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            names=["id", "row", "n_shingles", "class", "bands", "sketch"],
        )


def full_sets(batches):
    """text -> class, set."""
    for batch in batches:
        sets = [h for h in map(shingles, texts_of(batch, 0)) if len(h)]
        digest = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["class", "set"])


def differing(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    total = F.lit(0)
    for k in range(SKETCH_WORDS):
        total = total + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return total


def deviation(percent: int) -> float:
    """Standard deviation of a similarity told by two sketches: of the samples that differ, and of their bits."""
    n, apart = SKETCH_WORDS * 64, 1 - percent / 100
    m = 2 * FINE * apart
    bits = n / 4 * (1 - np.exp(-4 * m / n)) - m * np.exp(-4 * m / n)
    return float(np.sqrt(apart * (1 - apart) / FINE + bits / (2 * FINE * np.exp(-2 * m / n)) ** 2))


def most_differing(percent: int) -> int:
    """Bits that differ at most for a pair worth confirming: n/2 (1 - exp(-2 m / n)) for m = 2 FINE (1 - J)."""
    margin = MARGIN * max(1.0, deviation(percent) / deviation(PERCENT))
    n, m = SKETCH_WORDS * 64, 2 * FINE * (1 - percent / 100 + margin)
    return int(n / 2 * (1 - np.exp(-2 * m / n)))


def classified(docs: DataFrame, text: str, key: str, n_bands: int) -> DataFrame:
    """id, row (hash of the text), n_shingles, class, bands and sketch of every row of ``docs``, stored."""
    narrow = docs.select(q(key).alias("id"), q(text).alias("text"), F.xxhash64(q(text)).alias("row"))
    kind = dict(narrow.dtypes)["id"]
    schema = f"id {kind}, row long, n_shingles long, class binary, bands array<long>, sketch array<long>"
    return stash(map_batches(narrow, partial(signatures, n_bands=n_bands), schema), "signatures")


def labelled_classes(docs: DataFrame, made: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """class and label (a class) of every class that shares a bucket with another one."""
    classes = made.filter("class is not null").groupBy("class").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.max("n_shingles").alias("n"))
    classes = stash(classes, "classes")

    # buckets of at least two classes; one order of classes gives the pivots of all bands, so that most bands of a group name one pair
    members = classes.select("class", F.posexplode("bands").alias("band", "key"))
    pivots = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("class").alias("o"), "class")).alias("pivot")).filter("size > 1")
    pivots = stash(pivots.select("band", "key", "size", F.col("pivot.class").alias("pivot")), "pivots")
    held = stash(members.join(pivots, ["band", "key"]), "buckets")

    wanted = stash(held.select("class").distinct(), "wanted")
    look = stash(classes.join(wanted, "class", "left_semi"), "sketches")
    # one text of each class: by id where it has one, so that texts stay where they are
    names = stash(look.select(F.col("rep").alias("_rep")).distinct(), "names")
    known = names.count() <= 1_000_000  # ids only
    narrow = docs.select(q(key).alias("id"), q(text).alias("text"))
    some = narrow.join(F.broadcast(names) if known else names, F.col("id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    sets = map_batches(some, full_sets, "class binary, set array<long>").join(wanted, "class", "left_semi")
    sets = stash(sets.groupBy("class").agg(F.first("set").alias("set")), "sets")

    limit = most_differing(percent)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sketch and full sets confirm, as links."""
        side = lambda c: look.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        d = pairs.join(side("a"), "a").join(side("b"), "b")
        fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differing(F.col("sa"), F.col("sb")) <= limit)
        d = stash(d.filter(fits).select("a", "b", "na", "nb"), "likely")
        d = d.join(sets.select(F.col("class").alias("b"), F.col("set").alias("tb")), "b").join(sets.select(F.col("class").alias("a"), F.col("set").alias("ta")), "a")
        d = d.withColumn("both", F.size(F.array_intersect("ta", "tb")))
        return d.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    links = stash(near(held.filter("class <> pivot").select(*pair("class", "pivot")).distinct()), "links")
    label = component_labels(links, wanted.select(F.col("class").alias("node")))

    def joined_up(label: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after more links: only the components that the links touch are labelled again."""
        end = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        edges = stash(links.join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "bridges")
        if edges.isEmpty():
            return label
        new = component_labels(edges).select(F.col("node").alias("_old"), F.col("label").alias("_new"))
        return stash(label.join(new, F.col("label") == F.col("_old"), "left").select("node", F.coalesce("_new", "label").alias("label")), "labels")

    def opened(rows: DataFrame, label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Rows with their labels, and of each bucket with several components the largest one and a member of it."""
        rows = stash(rows.select("band", "key", "class").join(label, F.col("class") == F.col("node")).drop("node"), "labelled")
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "class").alias("o"), F.col("class")))
        parts = rows.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c"), first.alias("one"))
        big = parts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "label", "one")).alias("big")).filter("k > 1")
        return rows, stash(big.select("band", "key", F.col("big.label").alias("big"), F.col("big.one.class").alias("other")), "open")

    # other pivots for buckets with several components: their small components meet a member of the largest one
    rows, big = opened(held.filter("size > 2"), label, 0)
    for turn in range(MORE_PIVOTS):
        if big.isEmpty():
            break
        meet = rows.join(big, ["band", "key"]).filter("label <> big").select(*pair("class", "other")).distinct()
        label = joined_up(label, near(meet))
        rows, big = opened(rows, label, turn + 1)

    # what is left: every class outside of a bucket's largest component meets all of the bucket in other components
    if not big.isEmpty():
        size = look.select(F.col("class").alias("_class"), "n", "sketch", "bands")
        rest = stash(rows.join(big.drop("other"), ["band", "key"]).join(size, F.col("class") == F.col("_class")).drop("_class"), "rest")
        x, y = rest.filter("label <> big").alias("x"), rest.alias("y")
        once = (F.col("y.label") == F.col("y.big")) | (F.col("x.class") < F.col("y.class"))  # two small components meet once
        meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once
        fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (differing(F.col("x.sketch"), F.col("y.sketch")) <= limit)
        # a pair that shares several bands meets in the first of them whose bucket is open
        agree = F.zip_with("x.bands", "y.bands", lambda a, b: a == b)
        more = x.join(y, meet & fits & (F.array_position(agree, True) - 1 == F.col("x.band")))
        label = joined_up(label, near(more.select(*pair("x.class", "y.class")).distinct()))
    return label.select(F.col("node").alias("class"), "label")


def named_rows(docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """id, row, n_shingles, label (NULL without words) and component_id of every row of ``docs``, stored."""
    made = classified(docs, text, key, bands_for(percent))
    label = labelled_classes(docs, made, text, key, percent)
    ids = made.filter("class is not null").groupBy("class").agg(F.min("id").alias("id"))
    whole = stash(ids.join(label, "class", "left").select("class", "id", F.coalesce("label", "class").alias("label")), "named")
    names = whole.groupBy("label").agg(F.min("id").alias("component_id"))
    whole = whole.join(names, "label").select("class", "label", "component_id")
    rows = made.select("id", "row", "n_shingles", "class").join(whole, "class", "left")
    return stash(rows.select("id", "row", "n_shingles", "label", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "components")


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id of every row of ``docs``."""
    return named_rows(docs, text, key, percent).select("id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = PERCENT) -> DataFrame:
    """One row of each component, columns untouched: of the id that names it, or without ids any one.

    Rows without words stay, repeated ones with an id once.
    """
    rows = named_rows(docs, text, key, percent)
    gone_id, gone_row = fresh(docs, "_gone_id", "_gone_row")
    first = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    other = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row")))
    gone = rows.join(first, "label").filter(other).select(F.col("id").alias(gone_id), F.col("row").alias(gone_row)).distinct()
    gone = stash(gone, "gone")
    hashed = F.xxhash64(q(text))
    same = q(key).eqNullSafe(F.col(gone_id)) & (hashed == F.col(gone_row))
    send = lambda d: F.broadcast(d) if d.count() <= 1_000_000 else d
    rest = docs.join(send(gone), same, "left_anti")
    # repeated rows of what stays
    twice = rows.filter("id is not null or label is not null").groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = stash(twice.select(F.col("id").alias(gone_id), F.col("row").alias(gone_row)), "repeated")
    if twice.isEmpty():
        return rest
    again = send(twice)
    single, several = rest.join(again, same, "left_anti"), rest.join(again, same, "left_semi")
    several = several.withColumn(gone_row, hashed).withColumn(gone_id, q(key)).dropDuplicates([gone_id, gone_row])
    return single.unionByName(several.select(*[q(c) for c in docs.columns]))


def dedup_query(docs: DataFrame) -> DataFrame:
    rows = components(docs.select("doc_id", "text"), percent=PERCENT)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
