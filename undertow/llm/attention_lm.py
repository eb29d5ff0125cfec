"""Language-model scores: a causal self-attention model in numpy over subword ids, beside a unigram base.

Base.  Tokens are words and one end per text.  Their counts come from all training texts (partial counts per task, summed
by Spark).  A text needs the count of each of its tokens: the ``HEAD`` most frequent tokens - a size fixed by the parameter -
are broadcast, all others are joined by token, so nothing that grows with the corpus is sent around.

Model.  Words become subword ids of a public byte-level vocabulary (loaded by path, never trained).  One causal attention
layer looks at the last ``CONTEXT`` ids: keys, values and queries are rows of tables over the ``INPUTS`` most frequent ids
(all others share bins), with a learned bias per distance; its state predicts one of ``CLASSES`` classes of ids, and the
class gives the id by its relative frequency.  Subword counts cover all training texts; every id has a probability above 0,
and they sum to one.

The spelling of a word is what the ids inside it know better than any wider view: the probability of an id after the first of
its word is ``alpha + beta * attention``, where alpha is the discounted share of the id after the one or two ids before it in
the word and beta what the discounts leave.  These counts come from the words and their counts; the ``GRAMS`` most frequent ones
are broadcast (a size fixed by the parameter).  A word with an id that these do not settle - its sequence is not among them, and its context
may have others - leaves the task with what attention says of these ids, and gets their shares from the whole table by a join.  A word as a whole is
``GATE`` times its relative frequency in training, plus the rest of one times the product over its ids; words beyond the
broadcast head get their frequency by the join that the base takes too.  The sum over all words stays at most one.

Training is data-parallel and takes every training text in every round: a hash of id and text deals the texts to shares of
about ``SHARE`` tokens and orders them in each (so nothing depends on how the table is partitioned).  In each of ``ROUNDS`` rounds
every share starts from the same weights and takes Adam steps over all its windows, and Spark averages the weights by the
number of windows.

Scoring.  A text's ids are cut into windows of ``STEP`` ids that overlap by ``CONTEXT`` ids of context: each id is scored once,
with the ids before it in view; windows of all texts in a batch go through masked attention together.

Edge cases: NULL and empty texts consist of the end alone; without training texts the base is log10(1 / 1) per token and the
model is untrained (uniform); repeated rows are scored alike, each; texts of any length are scored whole.  Other columns
are not looked at, whatever they are called.
"""

from __future__ import annotations

import base64
from functools import lru_cache, partial
from itertools import chain, repeat
from math import log10
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import fold, map_batches, q, stash, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: of that vocabulary
HEAD = 100_000
INPUTS, CLASSES = 1024, 96
WIDTH = 16
CONTEXT, STEP = 8, 16
ROUNDS = 1
GRAMS = 500_000  # id sequences inside words that are broadcast; words that need others take a join
DISCOUNT = 0.5
GATE = 0.5  # weight of a word's own frequency against its spelling in context
SHARE = 250_000  # tokens of a share of the training texts: its steps follow one another
BLOCK = 96  # windows scored at once
LONG = 100_000  # words of a text that is scored in pieces
TRAIN_BLOCK = 192  # windows of one training step
RATE = 0.02
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"  # no word is a line break
MOST_CACHED = 400_000


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, and the end."""
    words = text.translate(LOWER).split()
    words.append(END)
    return words


@lru_cache(maxsize=2)
def vocabulary(path: str) -> SimpleNamespace:
    """The public vocabulary, read once per worker: its coder, its size with the end, and which ids begin with a blank."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = max(ranks.values()) + 2
    opens = np.zeros(size, bool)
    opens[[n for piece, n in ranks.items() if piece.startswith(b" ")]] = True
    return SimpleNamespace(coder=tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size=size, opens=opens)


def inner(pieces: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are not the first of their word (words begin at ``at``), the id before each and the one before that (``size``: none)."""
    opening = np.zeros(len(pieces) + 1, bool)
    opening[at] = True
    where = np.flatnonzero(~opening[:-1])
    return where, pieces[where - 1].astype(np.int64), np.where(opening[where - 1], size, pieces[where - 2]).astype(np.int64)


class Grams:
    """Discounted shares of ids after the one or two ids before them in a word, and what each such context leaves to shorter ones.

    Taken from columns a (-1: only one id before), b, id, n, and of the context t and k: how often it occurred at all, and with how many ids.
    ``whole``: these rows are all there are.
    """

    def __init__(self, size: int, a: np.ndarray, b: np.ndarray, one: np.ndarray, n: np.ndarray, t: np.ndarray, k: np.ndarray, whole: bool = True):
        self.size, self.whole = size, whole
        context = self.code(a.astype(np.int64), b.astype(np.int64))
        key, share = context * (size + 2) + one, (n - DISCOUNT) / t
        order = np.argsort(key)
        self.key, self.share = key[order], share[order]
        self.context, first, held = np.unique(context, return_index=True, return_counts=True)
        self.left = DISCOUNT * k[first] / t[first]
        self.missing = held < k[first]  # contexts with ids that are not here
        one = self.context[: np.searchsorted(self.context, size + 2)]  # contexts of one id are that id
        self.left_one, self.missing_one = np.ones(size + 2), np.ones(size + 2, bool)
        self.left_one[one], self.missing_one[one] = self.left[: len(one)], self.missing[: len(one)]

    def code(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        return (a + 1) * (self.size + 2) + b

    @staticmethod
    def found(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``at`` are among the keys, and their places there."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(at)  # in order, one search goes on where the last one ended
        at = at[order]
        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == at)
        return order[hit], place[hit]

    def parts(self, pieces: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """alpha and beta of every id of words that begin at ``at``, and whether rows that are not here may change them."""
        where, b, a = inner(pieces, at, self.size)
        alpha, beta, unsure = np.zeros(len(pieces)), np.ones(len(pieces)), np.zeros(len(pieces), bool)
        one, context = pieces[where].astype(np.int64), self.code(a, b)
        share, left, missing = np.zeros((2, len(where))), np.ones((2, len(where))), np.ones((2, len(where)), bool)
        left[0], missing[0] = self.left_one[b], self.missing_one[b]
        hit, place = self.found(self.key, b * (self.size + 2) + one)
        share[0, hit] = self.share[place]
        known, place = self.found(self.context, context)
        left[1, known], missing[1, known] = self.left[place], self.missing[place]
        hit, place = self.found(self.key, context[known] * (self.size + 2) + one[known])
        share[1, known[hit]] = self.share[place]
        alpha[where] = share[0] * left[1] + share[1]
        beta[where] = left[0] * left[1]
        if not self.whole:
            unsure[where] = ((share == 0) & missing).any(axis=0)
        return alpha, beta, unsure


class Subwords:
    """Words to ids, with the words met so far at hand (forgotten when they become too many).

    ``counts`` gives a number for each word (-1 if it has none), looked up once per word met.
    """

    def __init__(self, path: str, counts: dict[bytes, int] | None = None, grams: Grams | None = None):
        public = vocabulary(path)
        self.coder, self.size = public.coder, public.size
        self.opens = public.opens  # these ids open a word, as no word holds a blank
        self.counts, self.grams = counts or {}, grams
        self.forget()

    def forget(self) -> None:
        self.known = {END: 0}  # words to consecutive numbers
        self.flat, self.used = np.full(1 << 16, self.size - 1, np.int32), 1
        self.alpha, self.beta, self.open = np.zeros(1 << 16), np.ones(1 << 16), np.zeros(1 << 16, bool)
        self.start, self.sizes = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)
        self.count = np.full(1 << 14, self.counts.get(END, -1), np.int64)
        self.unsure = np.zeros(1 << 14, bool)

    def learn(self, words: list[bytes]) -> None:
        """Pieces of words not met before, encoded in one go."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        pieces = np.array(self.coder.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int32)
        at = np.flatnonzero(self.opens[pieces])
        first, last, end = len(self.known) - len(words), len(self.known), self.used + len(pieces)
        while end > len(self.flat):
            self.flat, self.alpha, self.beta, self.open = (np.r_[x, np.zeros_like(x)] for x in (self.flat, self.alpha, self.beta, self.open))
        while last > len(self.start):
            self.start, self.sizes, self.count, self.unsure = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.sizes, self.count, self.unsure))
        self.flat[self.used : end] = pieces
        if self.grams is not None:
            self.alpha[self.used : end], self.beta[self.used : end], self.open[self.used : end] = self.grams.parts(pieces, at)
            self.unsure[first:last] = np.logical_or.reduceat(self.open[self.used : end], at)
        self.start[first:last] = self.used + at
        self.sizes[first:last] = np.diff(np.r_[at, len(pieces)])
        if self.counts:
            self.count[first:last] = np.fromiter(map(self.counts.get, words, repeat(-1)), np.int64, len(words))
        else:
            self.count[first:last] = -1
        self.used = end

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of every word; its pieces are known afterwards."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            self.learn(list(dict.fromkeys(fresh)))
            at[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return at

    def pieces(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of numbered words in order, and how many each word has."""
        n = self.sizes[at]
        return self.flat[self.places(at)], n

    def places(self, at: np.ndarray) -> np.ndarray:
        """Where the ids of numbered words stand, in order."""
        n = self.sizes[at]
        return np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each word has."""
        if len(self.known) > MOST_CACHED:
            self.forget()
        return self.pieces(self.numbers(words))


def grouped(texts: list[bytes], most: int = 200_000):
    """Lists of texts of at most about ``most`` bytes; a long text is alone."""
    part, size = [], 0
    for i, text in enumerate(texts):
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append((i, text))
        size += len(text)
    if part:
        yield part


def count_batches(batches, *, path: str, limit: int = MOST_CACHED):
    """text -> (token or NULL, id or NULL, n): counts of words and of subword ids in each task."""
    subwords = Subwords(path)
    ids, seen = np.zeros(subwords.size, np.int64), np.zeros(0, np.int64)

    def words_out():
        nonlocal seen
        n = seen
        ids[:] += np.bincount(subwords.flat[: subwords.used], np.repeat(n, subwords.sizes[: len(n)]), subwords.size).astype(np.int64)
        words, used = list(subwords.known), np.flatnonzero(n)
        subwords.forget()
        seen = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in used], pa.binary()), pa.nulls(len(used), pa.int64()), pa.array(n[used])], names=["token", "id", "n"])

    for batch in batches:
        for part in grouped(texts_of(batch, 0)):
            at = subwords.numbers(list(chain.from_iterable(tokens(t) for _, t in part)))
            more = np.bincount(at, minlength=len(subwords.known))
            more[: len(seen)] += seen
            seen = more
        if len(seen) > limit:
            yield words_out()
    if len(seen):
        yield words_out()
    used = np.flatnonzero(ids)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.binary()), pa.array(used, pa.int64()), pa.array(ids[used], pa.int64())], names=["token", "id", "n"])


def gram_batches(batches, *, path: str, limit: int = 1_000_000):
    """token, n -> (a, b, id, n): how often an id follows one (a = -1) or two ids in a word; a is the vocabulary's size at its start."""
    subwords = Subwords(path)
    held, size = [], 0

    def out():
        rows, n = np.concatenate([r for r, _ in held], axis=1), np.concatenate([n for _, n in held])
        key, of = np.unique(((rows[0] + 1) * (subwords.size + 2) + rows[1]) * (subwords.size + 2) + rows[2], return_inverse=True)
        context, one = np.divmod(key, subwords.size + 2)
        a, b = np.divmod(context, subwords.size + 2)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a - 1, b, one, np.bincount(of, n).astype(np.int64))], names=["a", "b", "id", "n"])

    for batch in batches:
        pieces, sizes = subwords.ids(texts_of(batch, 0))
        where, b, a = inner(pieces, np.cumsum(sizes) - sizes, subwords.size)
        n = np.repeat(batch.column(1).to_numpy(), sizes)[where]
        one = pieces[where].astype(np.int64)
        held += [(np.stack([np.full_like(b, -1), b, one]), n), (np.stack([a, b, one]), n)]
        size += 2 * len(where)
        if size > limit:
            yield out()
            held, size = [], 0
    if size:
        yield out()


# ---- the model: weights are one flat vector, so that averaging is a sum by position

SHAPES = {"query": (INPUTS, WIDTH), "key": (INPUTS, WIDTH), "value": (INPUTS, WIDTH), "own": (INPUTS, WIDTH), "bias": (CONTEXT + 1,), "out": (WIDTH, CLASSES), "out_bias": (CLASSES,)}
ENDS = np.cumsum([np.prod(s) for s in SHAPES.values()]).tolist()
SIZE = ENDS[-1]


def unpacked(w: np.ndarray) -> SimpleNamespace:
    return SimpleNamespace(**{name: w[first:last].reshape(shape) for (name, shape), first, last in zip(SHAPES.items(), [0, *ENDS], ENDS)})


def start_weights(class_share: np.ndarray) -> np.ndarray:
    w = (np.random.default_rng(11).standard_normal(SIZE) * 0.1).astype(np.float32)
    m = unpacked(w)
    m.bias[:] = 0
    m.out_bias[:] = np.log(np.maximum(class_share, 1e-9))
    return w


def ranked_ids(counts: np.ndarray) -> SimpleNamespace:
    """Input row and class of every id by frequency rank, and log10 of its share in the class (add-one)."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    own_in, own_class = INPUTS - 32, CLASSES - 16
    row = np.where(rank < own_in, rank, own_in + np.minimum(31, np.log2(1 + np.maximum(0, rank - own_in) / 64).astype(np.int64)))
    bins = np.minimum(15, (2 * np.log2(1 + np.maximum(0, rank - own_class) / 32)).astype(np.int64))
    kind = np.where(rank < own_class, rank, own_class + bins)
    mass = counts + 1.0
    of_class = np.bincount(kind, weights=mass, minlength=CLASSES)
    return SimpleNamespace(row=row.astype(np.int32), kind=kind.astype(np.int32), share=np.log10(mass / of_class[kind]), class_share=of_class / of_class.sum(), trained=bool(counts.sum()))


#: Distance of a key column from a query row; those beyond the context or ahead of the query are masked.
DISTANCE = (np.arange(STEP)[:, None] + CONTEXT) - np.arange(CONTEXT + STEP)[None, :]
SEEN = (DISTANCE >= 0) & (DISTANCE <= CONTEXT)
NEAR = np.clip(DISTANCE, 0, CONTEXT)
PENALTY = np.where(SEEN, 0.0, -1e9).astype(np.float32)


def laid_out(m: SimpleNamespace) -> SimpleNamespace:
    """Weights as the passes take them.  Ones beside the values add up the attention, and what is added beside them makes tanh return one: the factor of the
    biases, which stand below the output weights.

    ``calm``: attention exponents cannot leave single precision, so no maximum per row has to be taken off first;
    ``top``: no class can score above it (states lie between -1 and 1); ``flat``: nor so far below that all vanish.
    """
    longest = [np.einsum("ij,ij->i", x, x).max() for x in (m.query, m.key)]
    reach = np.sqrt(longest[0] * longest[1] / WIDTH) + np.abs(m.bias).max()
    wide = np.abs(m.out).sum(axis=0)
    top = float((wide + m.out_bias).max())
    value, own = np.ones((INPUTS, WIDTH + 1), m.value.dtype), np.full((INPUTS, WIDTH + 1), 30, m.own.dtype)
    value[:, :WIDTH], own[:, :WIDTH] = m.value, m.own
    return SimpleNamespace(
        query=m.query * np.float32(WIDTH**-0.5), key=m.key, value=value, own=own, mask=m.bias[NEAR] + PENALTY,
        out=np.concatenate([m.out, m.out_bias[None, :] - m.out.dtype.type(top)]), calm=bool(reach < 40), flat=top - float((m.out_bias - wide).max()) < 80,
    )


def states(m: SimpleNamespace, rows: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, SimpleNamespace]:
    """rows: (windows, CONTEXT + STEP) input rows; real: which of them exist.

    States of the last STEP places of each window, a one behind each, and what led to them: the attention before it is divided by its sum,
    one by this sum, and what attention gathers.
    """
    own = rows[:, CONTEXT:]
    query, key, value = m.query.take(own, axis=0), m.key.take(rows, axis=0), m.value.take(rows, axis=0)
    a = np.matmul(query, key.transpose(0, 2, 1))
    a += m.mask
    short = np.flatnonzero(~real.all(axis=1))  # where a text begins or ends
    a[short] += np.where(real[short], np.float32(0), np.float32(-1e9))[:, None, :]
    if not m.calm:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    seen = np.matmul(a, value)
    each = 1 / np.maximum(seen[:, :, WIDTH:], seen.dtype.type(1e-30))  # nothing may be in view behind the end of a text
    seen *= each
    h = m.own.take(own, axis=0)
    h += seen
    np.tanh(h, out=h)
    return h.reshape(-1, WIDTH + 1), SimpleNamespace(query=query, key=key, value=value, a=a, each=each, seen=seen)


def windows(rows: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts laid end to end: the row of each column, whether it is the text's own, and what the last STEP places are to predict (-1: nothing).

    Column c of a window predicts the id after it; a text begins with an invisible id of row ``first`` in front of it.
    """
    blocks = 1 - (-sizes // STEP)  # one in front of each text, for the context of its first window
    ends = np.cumsum(blocks)
    begin = (ends - blocks + 1) * STEP
    place = np.arange(len(rows)) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
    row, real, kind = np.full(ends[-1] * STEP, first, rows.dtype), np.zeros(ends[-1] * STEP, bool), np.full(ends[-1] * STEP, -1, kinds.dtype)
    row[place], real[place], kind[place] = rows, True, kinds
    real[begin - 1] = True
    keep = np.ones(ends[-1], bool)
    keep[ends - blocks] = False
    keep = np.flatnonzero(keep)
    row, real = (np.lib.stride_tricks.sliding_window_view(x, CONTEXT + STEP)[STEP - CONTEXT - 1 :: STEP][keep - 1] for x in (row, real))
    return row, real, kind.reshape(-1, STEP)[keep]


def row_sums(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input rows met, and the sum of what was found at each."""
    at = at.reshape(-1).astype(np.uint16)  # INPUTS rows: sorted by digits
    order = np.argsort(at, kind="stable")
    at = at[order]
    new = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    first = np.flatnonzero(new)
    pairs = d.reshape(-1, d.shape[-1]).take(order, axis=0)
    if d.dtype == np.float32:
        pairs = pairs.view(np.complex64)  # numpy goes down every column by itself: pairs are half as many
    return at[first], np.add.reduceat(pairs, first, axis=0).view(d.dtype)


def gradient(m: SimpleNamespace, rows: np.ndarray, real: np.ndarray, kinds: np.ndarray, room: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """Gradient of the mean log loss over a block of windows; kinds is -1 where no id is to be predicted.

    Scores of classes are the widest arrays: they are passed over as seldom as can be, so factors per place go to the narrow side of each product.
    ``room`` for the gradient and for these scores can be given, so that it is not asked for at every step.
    """
    laid = laid_out(m)
    g, space = room or (np.empty(SIZE, np.float32), None)
    h, made = states(laid, rows, real)
    z = np.matmul(h, laid.out, out=None if space is None else space[: len(h)])
    if not laid.flat:
        z -= z.max(axis=1, keepdims=True)
    flat = kinds.reshape(-1)
    use = np.flatnonzero(flat >= 0)
    each, hit = max(1, len(use)), use * CLASSES + flat[use]
    score = z.reshape(-1)[hit]
    np.exp(z, out=z)
    total = z @ np.ones(CLASSES, z.dtype)
    loss = float((np.log(total[use]) - score).sum()) / each
    z.reshape(-1)[hit] -= total[use]
    factor = (np.where(flat >= 0, 1 / each, 0) / total).astype(z.dtype)[:, None]
    g.fill(0)
    out = unpacked(g)
    below = z.T @ (h * factor)
    out.out[:], out.out_bias[:] = below[:, :WIDTH].T, below[:, WIDTH]
    dh = np.zeros_like(h)
    np.matmul(z, laid.out[:WIDTH].T, out=dh[:, :WIDTH])
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    dh *= factor
    back = dh.copy()  # by what was gathered, and behind it by the sum of the attention
    back[:, WIDTH] = -np.einsum("ij,ij->i", dh, made.seen.reshape(dh.shape))
    back = back.reshape(made.seen.shape)
    back *= made.each
    ds = np.matmul(back, made.value.transpose(0, 2, 1))
    ds *= made.a
    out.bias[:] = np.bincount(NEAR.reshape(-1), np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1), CONTEXT + 1)
    d = np.empty((*made.a.shape[:2], 2 * WIDTH), z.dtype)
    np.matmul(ds, made.key, out=d[:, :, :WIDTH])
    d[:, :, WIDTH:] = dh.reshape(back.shape)[:, :, :WIDTH]
    at, sums = row_sums(rows[:, CONTEXT:], d)
    out.query[at], out.own[at] = sums[:, :WIDTH] * np.float32(WIDTH**-0.5), sums[:, WIDTH:]
    d = np.empty((*rows.shape, 2 * WIDTH), z.dtype)
    np.matmul(ds.transpose(0, 2, 1), made.query, out=d[:, :, :WIDTH])
    np.matmul(made.a.transpose(0, 2, 1), back[:, :, :WIDTH], out=d[:, :, WIDTH:])
    at, sums = row_sums(rows, d)
    out.key[at], out.value[at] = sums[:, :WIDTH], sums[:, WIDTH:]
    return g, loss


class Steps:
    """Adam steps over the windows of one share, from the weights given; every step but the last takes ``TRAIN_BLOCK`` windows."""

    def __init__(self, w: np.ndarray):
        self.w, self.m1, self.m2 = w.copy(), np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
        self.step, self.seen, self.held, self.pending = 0, 0, [], 0
        self.room = np.empty(SIZE, np.float32), np.empty((TRAIN_BLOCK * STEP, CLASSES), np.float32)

    def add(self, *windows_: np.ndarray) -> None:
        self.held.append(windows_)
        self.pending += len(windows_[0])
        if self.pending >= 32 * TRAIN_BLOCK:
            self.learn(self.pending - self.pending % TRAIN_BLOCK)

    def learn(self, upto: int) -> None:
        rows, real, kinds = (np.concatenate(x) for x in zip(*self.held))
        for at in range(0, upto, TRAIN_BLOCK):
            part = slice(at, min(at + TRAIN_BLOCK, upto))
            g, _ = gradient(unpacked(self.w), rows[part], real[part], kinds[part], self.room)
            self.step += 1
            self.m1 *= 0.9
            self.m1 += 0.1 * g
            g *= g
            g *= 0.01
            self.m2 *= 0.99
            self.m2 += g
            rate = np.float32(RATE / (1 + 0.02 * self.step) / (1 - 0.9**self.step))
            np.multiply(self.m2, 1 / (1 - 0.99**self.step), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(self.m1, g, out=g)
            g *= rate
            self.w -= g
        self.seen += upto
        self.held, self.pending = [(rows[upto:], real[upto:], kinds[upto:])], len(rows) - upto

    def finish(self) -> None:
        if self.pending:
            self.learn(self.pending)


def train_batches(batches, *, path: str, held):
    """share, text (whole shares, in order) -> (position, weight x windows, windows), summed over the task's shares."""
    plan, w = held.value
    subwords = Subwords(path)
    total, seen, share, steps = np.zeros(SIZE), 0, None, None

    def close() -> None:
        nonlocal total, seen
        if steps is not None:
            steps.finish()
            total += steps.w.astype(np.float64) * steps.seen
            seen += steps.seen

    def learn(ids: np.ndarray, sizes: np.ndarray, known: int = 0) -> None:
        """Windows of texts end to end; the first ``known`` ids are only looked at."""
        kinds = plan.kind[ids]
        kinds[:known] = -1
        steps.add(*windows(plan.row[ids], kinds, sizes, plan.row[subwords.size - 1]))

    for batch in batches:
        shares, raw = batch.column(0).to_numpy(), texts_of(batch, 1)
        cuts = [0, *(np.flatnonzero(shares[1:] != shares[:-1]) + 1).tolist(), len(raw)]
        for first, last in zip(cuts, cuts[1:]):
            if steps is None or shares[first] != share:
                close()
                share, steps = shares[first], Steps(w)
            for part in grouped(raw[first:last], 20_000):
                lists = [tokens(t) for _, t in part]
                if len(lists[0]) > LONG:  # alone, and learned in pieces; ids in view are carried over
                    tail = np.zeros(0, np.int32)
                    for at in range(0, len(lists[0]), LONG):
                        ids, _ = subwords.ids(lists[0][at : at + LONG])
                        both = np.r_[tail, ids]
                        learn(both, np.array([len(both)]), len(tail))
                        tail = both[-(CONTEXT + 1) :]
                    continue
                ids, n = subwords.ids(list(chain.from_iterable(lists)))
                ends = np.cumsum([len(x) for x in lists])
                learn(ids, np.diff(np.r_[0, np.cumsum(n)[ends - 1]]))
    close()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE), pa.int64()), pa.array(total), pa.array(np.full(SIZE, float(seen)))], names=["at", "w", "n"])


def spelled(subwords: Subwords, numbers: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of every numbered word by its ids: what attention says of them, with their share inside words.

    Ids whose shares the broadcast does not settle are left out; how many there are in each word, and what attention says of them, is given beside.
    """
    at, n = subwords.places(numbers), subwords.sizes[numbers]
    first = np.cumsum(n) - n
    if subwords.grams is None:
        return np.add.reduceat(logs, first), np.zeros(len(n), np.int64), np.zeros(0)
    open_ = np.flatnonzero(subwords.open[at])
    asked = np.bincount(np.searchsorted(first, open_, "right") - 1, minlength=len(n))
    mixed = np.exp(logs * np.log(10))
    mixed *= subwords.beta[at]
    mixed += subwords.alpha[at]
    mixed[open_] = 1
    return np.add.reduceat(np.log10(mixed), first), asked, logs[open_]


def word_logs(model: SimpleNamespace, subwords: Subwords, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spelled`` for the words of texts of the given sizes, in context; words are given by their numbers."""
    ends = np.cumsum(sizes)
    if (sizes > LONG).any():  # a very long text goes in pieces; ids in view are carried over
        made = [(long_logs(model, subwords, at) if len(at) > LONG else word_logs(model, subwords, at, np.array([len(at)]))) for at in np.split(numbers, ends[:-1])]
        return tuple(np.concatenate(x) for x in zip(*made))
    ids, n = subwords.pieces(numbers)
    return spelled(subwords, numbers, id_logs(model, ids, np.diff(np.r_[0, np.cumsum(n)[ends - 1]]), subwords.size - 1))


def id_logs(model: SimpleNamespace, ids: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """log10 probability of every id, each scored once; blocks are small enough for a core's cache."""
    m = laid_out(unpacked(model.weights))
    row, real, kind = windows(model.plan.row[ids], model.plan.kind[ids], sizes, model.plan.row[first])
    kind, one = kind.reshape(-1), np.ones(CLASSES, np.float32)
    out, room = np.empty(len(kind), np.float32), np.empty((BLOCK * STEP, CLASSES), np.float32)
    for at in range(0, len(row), BLOCK):
        h, _ = states(m, row[at : at + BLOCK], real[at : at + BLOCK])
        k = kind[at * STEP : at * STEP + len(h)]
        z = np.matmul(h, m.out, out=room[: len(h)])
        if not m.flat:
            z -= z.max(axis=1, keepdims=True)
        own = z.reshape(-1)[np.arange(0, CLASSES * len(k), CLASSES) + k]  # of places that predict nothing, any score will do
        np.exp(z, out=z)
        out[at * STEP : at * STEP + len(h)] = own - np.log(z @ one)
    out = out[kind >= 0].astype(np.float64)
    return out / np.log(10) + model.plan.share[ids]


def long_logs(model: SimpleNamespace, subwords: Subwords, numbers: np.ndarray, piece: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spelled`` for a very long text, in pieces that overlap by the context."""
    made, tail = [], np.zeros(0, np.int32)
    for at in range(0, len(numbers), piece):
        ids, _ = subwords.pieces(numbers[at : at + piece])
        logs = id_logs(model, np.r_[tail, ids], np.array([len(tail) + len(ids)]), subwords.size - 1)
        made.append(spelled(subwords, numbers[at : at + piece], logs[len(tail) :]))
        tail = np.r_[tail, ids][-(CONTEXT + 1) :]
    return tuple(np.concatenate(x) for x in zip(*made))


def lists_of(sizes: np.ndarray, items: pa.Array) -> pa.ListArray:
    """Items in order as lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), items)


def score_batches(batches, *, path: str, held):
    """doc_id, held_out, text -> scores; tokens that the broadcast does not settle are listed.

    Those beyond the head have no count yet; those with ids beyond the broadcast sequences come with what attention says of these ids.
    """
    model = held.value
    subwords = Subwords(path, model.head, model.grams)
    unit = log10(model.n + model.v + 1)
    row_number = TaskContext.get().partitionId() << 33
    for batch in batches:
        made, rare_words, unsure_words = [], [], []
        for part in grouped(texts_of(batch, 2)):
            if len(subwords.known) > MOST_CACHED:
                subwords.forget()
            lists = [tokens(t) for _, t in part]
            words, sizes = list(chain.from_iterable(lists)), np.array([len(x) for x in lists])
            first, at = np.cumsum(sizes) - sizes, subwords.numbers(words)
            logs, asked, values = word_logs(model, subwords, at, sizes)
            c = subwords.count[at]
            inside, sure = c >= 0, asked == 0
            worth = logs
            if model.n:  # a word outside the head counts as spelled, until the join adds its frequency; an unsure one is left to the join
                worth = log10(1 - GATE) + logs
                worth[inside] = np.log10(GATE / model.n * c[inside] + (1 - GATE) * 10 ** logs[inside])
                worth[~sure] = 0
            base = np.where(inside, np.log10(np.maximum(c, 0) + 1.0), 0.0)
            rare, unsure = ~inside & sure, ~sure
            known, n_rare, n_unsure = (np.add.reduceat(x, first, dtype=np.int64) for x in (c > 0, rare, unsure))
            j, k = np.flatnonzero(rare), np.flatnonzero(unsure)
            rare_words += [words[i] for i in j.tolist()]
            unsure_words += [words[i] for i in k.tolist()]
            made.append((sizes, known, np.add.reduceat(base, first) - sizes * unit, np.add.reduceat(worth, first), n_rare, n_unsure, logs[j], logs[k], c[k], asked[k], values))
        sizes, known, base, score, n_rare, n_unsure, rare_logs, unsure_logs, c, asked, values = (np.concatenate(x) for x in zip(*made))
        uid = np.arange(row_number, row_number + len(sizes))
        row_number += len(sizes)
        rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_logs)], ["token", "spelled"])
        unsure = [pa.array(unsure_words, pa.binary()), pa.array(unsure_logs), pa.array(c, pa.int64(), mask=c < 0), lists_of(asked, pa.array(values))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid, pa.int64()), batch.column(0), batch.column(1), *(pa.array(x) for x in (sizes, known, base, score)), lists_of(n_rare, rare),
             lists_of(n_unsure, pa.StructArray.from_arrays(unsure, ["token", "spelled", "held", "logs"]))],
            names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "unsure"],
        )


def trained(rows: DataFrame, text: str = "text", key: str = "doc_id", *, path: str = VOCABULARY) -> tuple[SimpleNamespace, DataFrame]:
    """The model from all of ``rows``, and the table of token counts."""
    spark = rows.sparkSession
    texts = rows.select(q(text).alias("text"))
    counts = stash(map_batches(texts, partial(count_batches, path=path), "token binary, id long, n long").groupBy("token", "id").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter("token is not null").select("token", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = words.orderBy(F.col("n").desc(), "token").limit(HEAD).toArrow()
    subwords = Subwords(path)
    ids = np.zeros(subwords.size)
    found = counts.filter("id is not null").select("id", "n").toArrow()  # at most the vocabulary
    ids[found["id"].to_numpy()] = found["n"].to_numpy()
    plan = ranked_ids(ids)
    weights = start_weights(plan.class_share)
    order = F.xxhash64(q(key).cast("string"), q(text))  # the key too: copies of one text are spread
    shares = rows.select(F.pmod(order, F.lit(-(-n // SHARE))).alias("share"), order.alias("order"), q(text).alias("text")) if plan.trained else None
    for _ in range(ROUNDS if plan.trained else 0):
        held = spark.sparkContext.broadcast((plan, weights))
        whole = shares.repartition("share").sortWithinPartitions("share", "order", "text").select("share", "text")
        parts = map_batches(whole, partial(train_batches, path=path, held=held), "at long, w double, n double")
        mean = parts.groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()
        if mean.num_rows:
            weights = weights.copy()
            weights[mean["at"].to_numpy()] = mean["w"].to_numpy().astype(np.float32)
    table = dict(zip(head["token"].to_pylist(), head["n"].to_pylist()))
    grams, every = spelling(words, subwords.size, path)
    return SimpleNamespace(plan=plan, weights=weights, head=table, n=n, v=v, grams=grams, every=every), words


def spelling(words: DataFrame, size: int, path: str) -> tuple[Grams, DataFrame]:
    """The ``GRAMS`` most frequent id sequences inside words, each beside the count of its context (at most a vocabulary of rows), and the table of all."""
    grams = map_batches(words, partial(gram_batches, path=path), "a long, b long, id long, n long").groupBy("a", "b", "id").agg(F.sum("n").alias("n"))
    context = Window.partitionBy("a", "b")
    every = stash(grams.withColumns({"t": F.sum("n").over(context), "k": F.count(F.lit(1)).over(context)}), "grams")
    top = every.orderBy(F.col("n").desc(), "a", "b", "id").limit(GRAMS).toArrow()
    return Grams(size, *(top[c].to_numpy() for c in ("a", "b", "id", "n", "t", "k")), whole=every.count() <= GRAMS), every


def place_batches(batches, *, path: str, held):
    """token -> (token, at, a, b, id) for every id of the token that the broadcast does not settle."""
    subwords = Subwords(path, None, held.value.grams)
    for batch in batches:
        words = texts_of(batch, 0)
        pieces, sizes = subwords.ids(words)
        first = np.cumsum(sizes) - sizes
        where, b, a = inner(pieces, first, subwords.size)
        asked = subwords.open[subwords.places(subwords.numbers(words))][where]
        where, b, a = where[asked], b[asked], a[asked]
        of = np.repeat(np.arange(len(words)), sizes)[where]
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in of], pa.binary()), *(pa.array(x, pa.int64()) for x in (where - first[of], a, b, pieces[where]))], names=["token", "at", "a", "b", "id"]
        )


def shares_by_join(tokens_: DataFrame, every: DataFrame, path: str, held) -> DataFrame:
    """token, parts: alpha and beta of every id of the token that the broadcast does not settle, in order, from the table of all id sequences."""
    table = every.select("a", "b", "id", ((F.col("n") - DISCOUNT) / F.col("t")).alias("v")).unionAll(
        every.select("a", "b", F.lit(-1).cast("long"), (F.lit(DISCOUNT) * F.col("k") / F.col("t"))).distinct()  # what the context leaves
    )
    places = map_batches(tokens_, partial(place_batches, path=path, held=held), "token binary, at long, a long, b long, id long")
    looked = [(name, a, one) for a, tag in ((F.lit(-1).cast("long"), "1"), (F.col("a"), "2")) for name, one in ((f"share{tag}", F.col("id")), (f"left{tag}", F.lit(-1).cast("long")))]
    asked = places.select("token", "at", "b", F.inline(F.array(*[F.struct(F.lit(name).alias("what"), a.alias("a"), one.alias("id")) for name, a, one in looked])))
    found = asked.join(table, ["a", "b", "id"], "left").groupBy("token", "at").agg(*[F.max(F.when(F.col("what") == name, F.col("v"))).alias(name) for name, _, _ in looked])
    left1, left2 = (F.coalesce(c, F.lit(1.0)) for c in ("left1", "left2"))
    alpha = F.coalesce("share1", F.lit(0.0)) * left2 + F.coalesce("share2", F.lit(0.0))
    parts = F.sort_array(F.collect_list(F.struct("at", alpha.alias("alpha"), (left1 * left2).alias("beta"))))
    return found.groupBy("token").agg(parts.alias("parts"))


def score(docs: DataFrame, model: SimpleNamespace, words: DataFrame, text: str = "text", key: str = "doc_id", held_out: Column | None = None, *, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    sent = SimpleNamespace(**{name: x for name, x in vars(model).items() if name != "every"})
    held = docs.sparkSession.sparkContext.broadcast(sent)
    narrow = docs.select(q(key).alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), q(text).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    fields = "token: binary, spelled: double"
    listed = f"rare array<struct<{fields}>>, unsure array<struct<{fields}, held: long, logs: array<double>>>"
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, {listed}"
    made = stash(map_batches(narrow, partial(score_batches, path=path, held=held), schema), "scores")
    rare = made.select("uid", F.inline("rare")).select("*", F.lit(None).cast("long").alias("held"), F.lit(True).alias("sure"))
    if not model.grams.whole:
        unsure = made.select("uid", F.inline("unsure"))
        parts = shares_by_join(unsure.select("token").distinct(), model.every, path, held)
        mixed = F.zip_with("logs", "parts", lambda x, p: F.log10(p["alpha"] + p["beta"] * F.pow(F.lit(10.0), x)))
        whole = F.col("spelled") + F.aggregate(mixed, F.lit(0.0), lambda total, x: total + x)
        rare = rare.unionAll(unsure.join(parts, "token").select("uid", "token", whole.alias("spelled"), "held", F.lit(False).alias("sure")))
    found = rare.join(words, "token", "left").filter("not sure or n is not null").withColumn("c", F.coalesce("held", "n"))
    late, given = F.col("held").isNull() & F.col("n").isNotNull(), F.lit(log10(1 - GATE)) + F.col("spelled")
    mixture = F.log10(F.lit(GATE / max(model.n, 1)) * F.col("c") + F.lit(1 - GATE) * F.pow(F.lit(10.0), F.col("spelled")))
    more = found.groupBy("uid").agg(
        F.count(F.when(late, 1)).alias("more_known"), F.sum(F.when(late, F.log10(F.col("n") + 1))).alias("more_base"),
        F.sum(F.when(F.col("c") > 0, mixture).otherwise(given) - F.when(F.col("sure"), given).otherwise(0.0)).alias("more_score"),
    )
    rows = made.drop("rare", "unsure").join(more, "uid", "left")
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def lm_query(docs: DataFrame) -> DataFrame:
    out = fold(q("doc_id"), 7) == 2
    model, words = trained(docs.filter(~out))
    return score(docs, model, words, held_out=out)
