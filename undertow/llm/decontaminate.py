"""Benchmark decontamination with suffix arrays over the training texts.

Each Arrow batch of documents is a shard.  Its words become numbers of the benchmark's vocabulary (0 for a word
that no item has: no match can start or pass there), and the suffixes that start at a known word are sorted as
deep as the longest test item reaches, by prefix doubling on the ones still tied.  Every test suffix that holds a
whole window is then binary-searched, one word after the other, for all suffixes at once.  The ranges found at the
window's depth give every place where a window occurs; places on one diagonal join to the longest verbatim matches.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words (one pass over the batches for each block, chained
in the same stage), so that what is broadcast stays bounded.  A text longer than a shard is cut into pieces that
overlap by the longest test item.

Edge cases: NULL or word-less texts and items match nothing; an item below ``window`` words is one window; items with
the same id count once; an item whose id is NULL is called by the empty text; repeated rows are judged each; an empty
benchmark leaves all rows clean.  Other columns pass untouched.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import fresh, map_batches, q, texts_of

WINDOW = 13
BLOCK_WORDS = 500_000
SHARD_WORDS = 1_000_000
#: A-Z become lower case; 0-9, a-z and everything beyond ASCII belong to words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
MATCH = T.StructType([T.StructField("item", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("item_start", "doc_start", "words")]])


def split_words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def probe_of(items: list[tuple[str, bytes]], window: int) -> SimpleNamespace:
    """One block of test items: vocabulary, concatenated word numbers, and the suffixes that hold a window."""
    names, vocabulary, ids = [], {}, []
    item, start, ends, need = [], [], [], []
    for name, text in items:
        words = split_words(text)
        if not words:
            continue
        m = min(window, len(words))
        for k in range(len(words) - m + 1):
            item.append(len(names))
            start.append(len(ids) + k)
            ends.append(len(ids) + len(words))
            need.append(m)
        names.append((name, len(ids)))
        ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
    item, start, ends, need = (np.array(x, np.int64) for x in (item, start, ends, need))
    depth = int((ends - start).max()) if len(item) else 0
    return SimpleNamespace(names=names, vocabulary=vocabulary, ids=np.array([*ids, 0], np.int64), item=item, start=start, need=need, depth=depth)


def suffix_array(ids: np.ndarray, largest: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order of their first ``depth`` words, and how many words each has before a 0."""
    n = len(ids)
    zeros = np.flatnonzero(ids == 0)
    starts = np.flatnonzero(ids)
    left = zeros[np.searchsorted(zeros, starts)] - starts  # ids ends with a 0
    bits = max(1, int(largest).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(len(starts), np.int64)
    for j in range(h):
        key = (key << bits) | np.where(j < left, ids[np.minimum(starts + j, n - 1)], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    slot = np.arange(len(starts))
    first = np.maximum.accumulate(np.where(new, slot, 0))  # rank: the first slot of the tie
    while h < depth:
        tied = np.flatnonzero(~new | ~np.r_[new[1:], True])
        if not len(tied):
            break
        rank = np.zeros(n + 1, np.int64)
        rank[starts[order]] = first + 1
        at = order[tied]
        second = np.where(h < left[at], rank[np.minimum(starts[at] + h, n)], 0)
        again = np.lexsort((second, first[tied]))
        order[tied] = at[again]
        f, s = first[tied][again], second[again]
        split = np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])]
        new[tied] = split | new[tied]
        first = np.maximum.accumulate(np.where(new, slot, 0))
        h *= 2
    return starts[order], left[order]


def bisect(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """First slot of [lo, hi) whose word is not below (``after``: above) the target; for all searches at once."""
    lo, hi = lo.copy(), hi.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        w = words[mid]
        right = w <= target[live] if after else w < target[live]
        lo[live] = np.where(right, mid + 1, lo[live])
        hi[live] = np.where(right, hi[live], mid)
    return lo


def occurrences(probe: SimpleNamespace, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, place) of every occurrence of a window in the shard."""
    sa, left = suffix_array(ids, len(probe.vocabulary), probe.depth)
    live = np.arange(len(probe.start))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    j = 0
    while live.size:
        words = np.where(j < left, ids[np.minimum(sa + j, len(ids) - 1)], 0)
        target = probe.ids[probe.start[live] + j]
        a = bisect(words, lo[live], hi[live], target, False)
        b = bisect(words, a, hi[live], target, True)
        lo[live], hi[live] = a, b
        live = live[a < b]
        j += 1
        whole = probe.need[live] == j
        if whole.any():
            found.append((live[whole], lo[live[whole]], hi[live[whole]]))
            live = live[~whole]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffix, a, b = (np.concatenate(x) for x in zip(*found))
    n = b - a
    slots = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return np.repeat(suffix, n), sa[slots]


def matches_of(probe: SimpleNamespace, texts: list[bytes]) -> tuple[list[int], list[list[dict]]]:
    """Per text: its number of words, and its longest verbatim matches of a window at least."""
    counts, out = [], [[] for _ in texts]
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def search() -> None:
        if not pieces or not probe.depth:
            return
        ids = np.concatenate([x for _, _, part in pieces for x in (part, [0])])
        begin = np.cumsum([0, *[len(part) + 1 for _, _, part in pieces]])
        suffix, place = occurrences(probe, ids)
        if not len(place):
            return
        item, off = probe.item[suffix], probe.start[suffix]
        order = np.lexsort((place, place - off, item))  # along the diagonals
        item, off, place, need = item[order], off[order], place[order], probe.need[suffix][order]
        new = np.r_[True, (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (off[1:] != off[:-1] + 1)]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(new)] - 1
        piece = np.searchsorted(begin, place[head], "right") - 1
        for k, h, t in zip(piece, head, tail):
            doc, start, _ = pieces[k]
            name, base = probe.names[item[h]]
            out[doc].append({"item": name, "item_start": int(off[h] - base), "doc_start": int(start + place[h] - begin[k]), "words": int(place[t] - place[h] + need[h])})

    get = probe.vocabulary.get
    for k, text in enumerate(texts):
        words = split_words(text)
        counts.append(len(words))
        if not words:
            continue
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        step = SHARD_WORDS
        for start in range(0, len(ids), step):
            part = ids[start : start + step + max(0, probe.depth - 1)]
            if held + len(part) > SHARD_WORDS and pieces:
                search()
                pieces, held = [], 0
            pieces.append((k, start, part))
            held += len(part)
    search()
    return counts, out


def append_matches(batches, *, held, at: int, old: int | None):
    probe = held.value
    for batch in batches:
        counts, found = matches_of(probe, texts_of(batch, at))
        columns = batch.columns
        if old is not None:
            found = [a + b for a, b in zip(batch.column(old).to_pylist(), found)]
            columns = columns[: old - 1]
        kind = pa.list_(pa.struct([("item", pa.string()), *[(n, pa.int64()) for n in ("item_start", "doc_start", "words")]]))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(found, kind)], names=[f"c{i}" for i in range(len(columns) + 2)])


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", *, window: int = WINDOW, keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """Columns ``keep`` (all) of ``docs`` with n_words and the matches; returns also these two columns' names."""
    spark = docs.sparkSession
    size = F.length(F.coalesce(q(item_text), F.lit(""))) + 1  # bounds the words of an item
    items = benchmark.select(F.coalesce(q(item).cast("string"), F.lit("")).alias("item"), q(item_text).alias("text"), size.alias("size"))
    total = items.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_WORDS * 4)))  # a word and its gap seldom take less than 4 characters
    n, found = fresh(docs, "n_words", "matches")
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[q(c) for c in dict.fromkeys([*keep, text])])
    at = rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(n, T.LongType()), T.StructField(found, T.ArrayType(MATCH))])
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # bounded by the block
        held = spark.sparkContext.broadcast(probe_of(sorted({(r["item"], (r["text"] or "").encode()) for r in part}), window))
        rows = map_batches(rows, partial(append_matches, held=held, at=at, old=len(schema) - 1 if k else None), schema)
    return rows.select(*[q(c) for c in [*keep, n, found]]), n, found


def hit_words(matches: Column) -> Column:
    """Words inside any match: intervals in order, each adds what lies beyond the ones before."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def contaminated(n: Column, hit: Column) -> Column:
    return (hit > 0) & (20 * hit >= n)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the benchmark does not contaminate, columns untouched."""
    rows, n, found = with_matches(docs, benchmark, text)
    return rows.filter(~contaminated(q(n), hit_words(q(found)))).select(*[q(c) for c in docs.columns])


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, n, found = with_matches(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform(found, lambda m: m["item"])))
    rows = rows.select("doc_id", "n_words", hit_words(F.col(found)).alias("n_hit"), items.alias("items"), F.array_max(F.transform(found, lambda m: m["words"])).alias("longest"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest_match"),
    )
