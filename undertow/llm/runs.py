"""Periodic runs of words by a suffix automaton with link-cut access.

A document's words are appended one by one to a suffix automaton.  The tree of its suffix links is kept as a link-cut
forest whose preferred paths are *coloured*: all states of one path were last seen ending at the same word.  Appending
word ``e`` opens the path from its state to the root; it meets segments, each with a colour ``e'`` (the previous end) and
the lengths of its states.  If the distance ``d = e - e'`` is one of those lengths, the last ``d`` words stand there twice
in a row: a square of period ``d``.  Afterwards the whole path has the colour ``e``.  Colours sit at the roots of the splay
trees, so nothing is pushed down, and a cloned state joins the path of the state that it was cloned from.  All paths
together are recoloured O(n log n) times, however often a word is repeated.

A run of period ``q`` shows a square of period ``q`` at every end from its ``2q``-th word on, because ``q`` is its smallest
period; the first one is extended word by word in both directions, the others fall into a run that is already known.

Only stretches of words that can hold a run enter the automaton: in a run of 12 words and two periods every word lies in
a window of six words that occurs twice (``stretches``), so most documents have none.  This drops no run.

A document is the unit of work: memory grows with the longest text, texts are never shuffled, and groups of equal
documents cost nothing beyond their rows.

Edge cases: a NULL, empty or blank text has no words, no run, four nulls and the digests of the empty text; a NULL id has
no decimal text, so its words stay as they are; repeated rows are answered each; runs of equal length are ordered by
start, then period; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import partial
from hashlib import sha256
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from undertow.llm.common import map_batches, q, texts_of

LEAST = 12  # words of a run
WINDOW = LEAST // 2  # a run of LEAST words or two periods repeats windows of so many words
ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton whose link tree is a link-cut forest coloured by last occurrence."""

    def __init__(self):
        self.next = [None, {}]  # state 1 is the start, 0 stands for no state
        self.length = [0, 0]
        self.link = [0, 0]
        self.up = [0, 0]  # parent in the splay tree, or path parent of a splay root
        self.left = [0, 0]  # towards the start
        self.right = [0, 0]
        self.colour = [-1, -1]  # valid at splay roots; -1: never seen
        self.last = 1

    def _state(self, length: int, link: int, edges: dict) -> int:
        for column, value in ((self.next, edges), (self.length, length), (self.link, link), (self.up, 0), (self.left, 0), (self.right, 0), (self.colour, -1)):
            column.append(value)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree; the colour moves with the root."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        while True:  # y is the parent of x inside the tree
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:
                above = up[z]
                first = y if (left[z] == y) == (left[y] == x) else x
                p = z if first == y else y
                self._turn(first, p)
                self._turn(x, up[x])
            else:
                above = z
                self._turn(x, y)
            colour_from = z if inner else y
            y = above
            if not y or (left[y] != x and right[y] != x):
                self.colour[x] = self.colour[colour_from]
                return

    def _turn(self, x: int, p: int) -> None:
        """Rotate ``x`` above its parent ``p``."""
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x

    def append(self, word, end: int) -> list[int]:
        """Add one word that ends at ``end``; periods of the squares that end there."""
        nexts, length, link = self.next, self.length, self.link
        p = self.last
        new = self._state(length[p] + 1, 0, {})
        while p and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            parent = nexts[p][word]
            if length[parent] != length[p] + 1:
                parent = self._clone(parent, length[p] + 1, p, word)
        link[new] = self.up[new] = parent
        self.last = new
        return self._open(new, end)

    def _clone(self, state: int, length: int, p: int, word) -> int:
        """Split ``state``: its short words move to a clone, which enters the same path right above it."""
        nexts, link = self.next, self.link
        clone = self._state(length, link[state], dict(nexts[state]))
        self._splay(state)
        above = self.left[clone] = self.left[state]
        if above:
            self.up[above] = clone
        self.left[state], self.up[clone] = clone, state
        link[state] = clone
        while p and nexts[p].get(word) == state:
            nexts[p][word] = clone
            p = link[p]
        return clone

    def _open(self, state: int, end: int) -> list[int]:
        """Recolour the path from ``state`` to the start; periods found on its segments."""
        up, right, colour, length = self.up, self.right, self.colour, self.length
        found, x, below, distance = [], state, 0, 0
        while x:
            self._splay(x)
            if distance > length[x]:  # of the segment below, whose shortest word is longer than this state's
                found.append(distance)
            seen, rest = colour[x], right[x]
            distance = end - seen if 0 <= seen and end - seen <= length[x] else 0
            if rest:
                colour[rest] = seen
            right[x] = below
            if below:
                up[below] = x
            below, x = x, up[x]
        if distance:  # the last segment holds the start, whose word is empty
            found.append(distance)
        self._splay(state)
        colour[state] = end
        return found


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) covered by windows of WINDOW words that occur twice in them; a run lies inside one."""
    done, todo = [], [(0, len(ids))]
    while todo:
        start, end = todo.pop()
        n = end - start - WINDOW + 1
        if n < 2 or end - start < LEAST:
            continue
        with np.errstate(over="ignore"):
            h = np.zeros(n, np.uint64)
            for k in range(WINDOW):
                h = (h ^ (h >> np.uint64(29))) * ODD + ids[start + k : start + k + n].astype(np.uint64) + np.uint64(1)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if not same.any():
            continue
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(end - start + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.r_[False, covered, False]))
        parts = [(start + int(a), start + int(b)) for a, b in zip(turns[::2], turns[1::2])]
        if parts == [(start, end)]:
            done.append((start, end))
        else:
            todo += parts
    return sorted(done)


def primes_of(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def extended(ids: np.ndarray, low: int, high: int, end: int, period: int) -> tuple[int, int]:
    """The stretch (start, end exclusive) inside [low, high) that keeps ``period`` around the square ending at ``end``."""
    start, stop, step = end - 2 * period + 1, end + 1, 64
    while start > low:  # in steps that double: linear in what is found
        a = max(low, start - step)
        bad = np.flatnonzero(ids[a:start] != ids[a + period : start + period])
        if bad.size:
            start = a + int(bad[-1]) + 1
            break
        start, step = a, step * 2
    step = 64
    while stop < high:
        b = min(high, stop + step)
        bad = np.flatnonzero(ids[stop:b] != ids[stop - period : b - period])
        if bad.size:
            stop += int(bad[0])
            break
        stop, step = b, step * 2
    return start, stop


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Every run (start, length, period) of a sequence of word numbers, by start, then period."""
    out = []
    for low, high in stretches(ids):
        tree, upto = Automaton(), {}
        for end, word in enumerate(ids[low:high].tolist(), low):
            for period in tree.append(word, end):
                if end < upto.get(period, -1):
                    continue
                start, stop = extended(ids, low, high, end, period)
                upto[period] = stop
                if stop - start < max(least, 2 * period):
                    continue
                part = ids[start:stop]
                if not any(np.array_equal(part[period // p :], part[: -(period // p)]) for p in primes_of(period)):
                    out.append((start, stop - start, period))
    return sorted(set(out), key=lambda r: (r[0], r[2], r[1]))


def repeated_tail(words: list[bytes], doc_id) -> list[bytes]:
    """The contract's words of a document: one in ten has a periodic tail."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def run_batches(batches, *, tails: bool):
    """id, text -> the columns of the contract, in batches."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
            words = text.split()
            if tails:
                words = repeated_tail(words, doc_id)
            numbers: dict[bytes, int] = {}
            runs = runs_of(np.fromiter(map(numbers.setdefault, words, count()), np.int64, len(words)))
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
            start, length, period = best or (None, None, None)
            rows.append((len(runs), start, length, period, 1000 * length // period if best else None, sha256(listed.encode()).hexdigest(), sha256(b" ".join(collapsed(words, runs))).hexdigest()))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]],
            names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        )


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", *, tails: bool = False) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text, one row per row of ``docs``.

    ``tails`` repeats the tail of one document in ten first, as the query asks for.
    """
    narrow = docs.select(q(key).alias("id"), q(text).alias("text"))
    schema = f"doc_id {dict(narrow.dtypes)['id']}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_batches(narrow, partial(run_batches, tails=tails), schema)


def collapse(docs: DataFrame, text: str = "text", key: str = "doc_id", *, out: str = "text") -> DataFrame:
    """key (as doc_id) and the text whose runs are collapsed to their first period, words joined by one space."""
    narrow = docs.select(q(key).alias("id"), q(text).alias("text"))

    def shorter(batches):
        for batch in batches:
            made = []
            for text in texts_of(batch, 1):
                words, numbers = text.split(), {}
                runs = runs_of(np.fromiter(map(numbers.setdefault, words, count()), np.int64, len(words)))
                made.append(b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", out])

    return map_batches(narrow, shorter, f"doc_id {dict(narrow.dtypes)['id']}, `{out}` string")


def runs_query(docs: DataFrame) -> DataFrame:
    return periodic_runs(docs.select("doc_id", "text"), tails=True)
