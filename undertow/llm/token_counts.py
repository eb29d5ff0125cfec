"""Edit-aware token counts: segment trees over pre-tokens.

A text is cut into pre-tokens by the vocabulary's pattern; each is encoded by itself, so a text's tokens are the sum over
its pre-tokens.  A document keeps its pre-tokens in leaves of ``LEAF`` with a tree of subtree sums (characters and tokens)
above them.  An edit finds its place by descending the tree, goes back far enough that nothing before it could have looked
at the changed characters, cuts and encodes anew from there, and stops as soon as a boundary falls on an old one behind the
edit: from such a boundary on the old cut is the new one, as the pattern never looks back.  Only the leaves touched are
replaced, and the sums above them.

The operator takes documents with an array of edits (start, end, replacement, in code points of the stored text, applied
together) and gives the tokens before and after, and how many pre-tokens were encoded again. ``edited`` also takes and gives the
trees: the leaves are a column beside the text, so the next edits start from the stored tree and encode only what they touch.
``n_built`` counts the pre-tokens encoded because no tree was stored.

Edge cases: a stored tree that is NULL, broken or made from another text (its crc32 tells) is built anew and counted in ``n_built``
(a tree of another vocabulary cannot be told); NULL and empty texts have 0 tokens; edits are ordered by start, those that overlap an earlier one or lie outside
the text are left out and counted as skipped; an edit with a NULL field is skipped; insertions (start = end) and
deletions (empty replacement) are edits; repeated rows are counted each; other columns pass untouched.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.llm.common import fresh, map_batches, q

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: of that vocabulary
LEAF = 64
AHEAD = 2  # characters beyond its end that a pre-token's cut may depend on
MOST_CACHED = 200_000
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())]))
TREE = T.StructType(
    [
        T.StructField("text_crc32", T.LongType()),
        T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))]))),
    ]
)


class Counter:
    """Tokens of a pre-token; those met so far are at hand."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > MOST_CACHED:
                self.known.clear()
            n = self.known[piece] = len(self.coder.encode_ordinary(piece))
        return n

    def leaves(self, pieces: list[str]) -> list[tuple[list[int], list[int]]]:
        self.encoded += len(pieces)
        known = self.known
        tokens = [known[p] if p in known else self.count(p) for p in pieces]
        sizes = list(map(len, pieces))
        return [(sizes[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]


class Tree:
    """Leaves of (characters, tokens) per pre-token, and a tree of their sums."""

    def __init__(self, leaves: list[tuple[list[int], list[int]]]):
        self.leaves = leaves
        self.build()

    def build(self) -> None:
        self.width = 1
        while self.width < max(1, len(self.leaves)):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (sizes, tokens) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(sizes), sum(tokens)
        for i in range(self.width - 1, 0, -1):
            self.pull(i)

    def pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """Leaf that holds a character (the last one beyond the end), and the characters before it."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if char >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def replace(self, first: int, last: int, leaves: list[tuple[list[int], list[int]]]) -> None:
        """Put ``leaves`` where the leaves [first, last) were."""
        if len(leaves) != last - first:
            self.leaves[first:last] = leaves
            self.build()
            return
        for i, leaf in zip(range(first, last), leaves):
            self.leaves[i] = leaf
            at = self.width + i
            self.chars[at], self.tokens[at] = sum(leaf[0]), sum(leaf[1])
            while at > 1:
                at //= 2
                self.pull(at)


def edit_once(tree: Tree, counter: Counter, text: str, start: int, end: int, replacement: str) -> str:
    """Apply one edit to text and tree."""
    new = text[:start] + replacement + text[end:]
    if not text:
        tree.replace(0, len(tree.leaves), counter.leaves(counter.cut.findall(new)))
        return new
    first, before = tree.leaf_at(max(0, start - AHEAD - 1))
    sizes = tree.leaves[first][0]
    # the last boundary in this leaf that no change can move
    k, at = 0, before
    while k < len(sizes) and at + sizes[k] + AHEAD <= start:
        at += sizes[k]
        k += 1
    if k == 0 and first and at + AHEAD > start:  # the boundary lies in the leaf before
        first -= 1
        sizes = tree.leaves[first][0]
        before -= sum(sizes)
        k, at = 0, before
        while k < len(sizes) and at + sizes[k] + AHEAD <= start:
            at += sizes[k]
            k += 1
    head = k
    shift = len(replacement) - (end - start)
    # old boundaries behind the edit, leaf by leaf
    last, upto = tree.leaf_at(min(end, len(text) - 1))
    places: list[int] = []

    def bounds(leaf: int, begin: int) -> list[int]:
        out = [begin]
        for size in tree.leaves[leaf][0]:
            out.append(out[-1] + size)
        return out

    places = bounds(last, upto)
    pieces: list[str] = []
    tail: tuple[list[int], list[int]] = ([], [])
    done = len(new)
    for m in counter.cut.finditer(new, at):
        pieces.append(m[0])
        old = m.end() - shift
        if old < end:
            continue
        while old > places[-1] and last + 1 < len(tree.leaves):
            last += 1
            places = bounds(last, places[-1])
        j = bisect_right(places, old) - 1
        if places[j] == old:
            tail = (tree.leaves[last][0][j:], tree.leaves[last][1][j:])
            done = m.end()
            break
    made = counter.leaves(pieces)
    keep = (tree.leaves[first][0][:head], tree.leaves[first][1][:head])
    sizes = [*keep[0], *[s for leaf in made for s in leaf[0]], *tail[0]]
    tokens = [*keep[1], *[t for leaf in made for t in leaf[1]], *tail[1]]
    stop = last + 1 if done < len(new) or tail[0] else len(tree.leaves)
    if done == len(new):
        stop = len(tree.leaves)
    # as many leaves as before where it is possible, so that only sums change
    n = max(1, stop - first)
    step = -(-len(sizes) // n) if len(sizes) <= 2 * LEAF * n else LEAF
    leaves = [(sizes[i : i + step], tokens[i : i + step]) for i in range(0, len(sizes), step)] if sizes else []
    while len(leaves) < n and len(sizes) <= 2 * LEAF * n:
        leaves.append(([], []))
    tree.replace(first, stop, leaves)
    return new


def stored(tree: dict | None, text: str) -> Tree | None:
    """The tree of a stored column, if it was made from this text."""
    if not tree or tree["text_crc32"] != zlib.crc32(text.encode("utf-8", "surrogatepass")):
        return None
    leaves = [((leaf or {}).get("sizes"), (leaf or {}).get("tokens")) for leaf in tree["leaves"] or []]
    if any(s is None or t is None or len(s) != len(t) or None in s or None in t for s, t in leaves):
        return None
    return Tree(leaves) if sum(sum(s) for s, _ in leaves) == len(text) else None


def edit_document(counter: Counter, text: str, tree: Tree | None, edits) -> tuple[list[int], str, Tree]:
    """Counts in the order of ``NAMES``, the text after all edits, and its tree."""
    counter.encoded = 0
    if tree is None:
        tree = Tree(counter.leaves(counter.cut.findall(text)))
    before, built = tree.total, counter.encoded
    todo, upto = [], 0
    known = [e for e in edits or [] if e and None not in e.values()]
    skipped = len(edits or []) - len(known)
    for e in sorted(known, key=lambda e: (e["start"], e["end"])):
        if e["start"] < upto or e["end"] < e["start"] or e["end"] > len(text):
            skipped += 1
            continue
        todo.append(e)
        upto = e["end"]
    counter.encoded = 0
    for e in reversed(todo):  # places before an edit do not move
        text = edit_once(tree, counter, text, e["start"], e["end"], e["replacement"])
    return [before, tree.total, len(todo), skipped, counter.encoded, built], text, tree


def applied(counter: Counter, text: str, edits) -> tuple[int, int, int, int, int]:
    """Tokens before, tokens after, edits applied, edits skipped, pre-tokens encoded again."""
    return tuple(edit_document(counter, text, None, edits)[0][:5])


NAMES = ("n_tokens", "n_tokens_after", "n_edits", "n_skipped", "n_reencoded", "n_built")
KEPT = pa.struct([("text_crc32", pa.int64()), ("leaves", pa.list_(pa.struct([("sizes", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])))])


def count_batches(batches, *, path: str, keep: int, trees: bool):
    """Columns to keep, text, edits and perhaps tree -> kept columns, counts and perhaps text and tree after the edits."""
    counter = Counter(path)
    for batch in batches:
        texts, edits = (batch.column(keep + i).to_pylist() for i in (0, 1))
        old = batch.column(keep + 2) if trees else None
        counts, after, made = [], [], []
        for i, (text, e) in enumerate(zip(texts, edits)):
            tree = stored(old[i].as_py(), text or "") if trees else None
            n, new, tree = edit_document(counter, text or "", tree, e)
            counts.append(n)
            if trees:
                after.append(None if text is None and not new else new)
                made.append({"text_crc32": zlib.crc32(new.encode("utf-8", "surrogatepass")), "leaves": [{"sizes": s, "tokens": t} for s, t in tree.leaves]})
        columns = [*batch.columns[:keep], *[pa.array([n[i] for n in counts], pa.int64()) for i in range(len(NAMES))]]
        if trees:
            columns += [pa.array(after, pa.string()), pa.array(made, KEPT)]
        yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def _counted(docs: DataFrame, edits: str | None, text: str, tree: str | None, keep: list[str], path: str, trees: bool) -> tuple[DataFrame, list[str]]:
    names = fresh(docs, *NAMES, *(("text_after", "tree_after") if trees else ()))
    t, e, k = fresh(docs, "_text", "_edits", "_tree")
    given = (F.lit(None) if edits is None else q(edits)).cast(EDITS).alias(e)
    rows = docs.select(*[q(c) for c in keep], q(text).alias(t), given, *([(F.lit(None) if tree is None else q(tree)).cast(TREE).alias(k)] if trees else []))
    n = len(keep)
    made = [T.StructField(x, T.LongType()) for x in names[: len(NAMES)]]
    if trees:
        made += [T.StructField(names[-2], T.StringType()), T.StructField(names[-1], TREE)]
    return map_batches(rows, partial(count_batches, path=path, keep=n, trees=trees), T.StructType([*rows.schema.fields[:n], *made])), names


def with_counts(docs: DataFrame, edits: str, text: str = "text", *, keep: list[str] | None = None, path: str = VOCABULARY) -> tuple[DataFrame, list[str]]:
    """Columns ``keep`` (all) of ``docs`` with the counts; returns also the names of the six new columns."""
    return _counted(docs, edits, text, None, docs.columns if keep is None else keep, path, False)


def edited(
    docs: DataFrame, edits: str | None = None, text: str = "text", tree: str | None = None, *, keep: list[str] | None = None, path: str = VOCABULARY
) -> tuple[DataFrame, list[str]]:
    """Like ``with_counts``, with two more columns: the text after the edits and its tree, to be stored beside it.

    Given back as ``text`` and ``tree`` with the next edits, a document is not cut and encoded as a whole again. Without
    ``edits`` the trees are only built.
    """
    return _counted(docs, edits, text, tree, docs.columns if keep is None else keep, path, True)


# ---- edits of the query: personal data and keys give way to a mark

PRIVATE = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{32,}\b|\b\d{12,19}\b")


def redact_batches(batches):
    """id, text -> id, text, edits that replace addresses, long numbers and keys."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))
    for batch in batches:
        texts = batch.column(1).to_pylist()
        found = [[{"start": m.start(), "end": m.end(), "replacement": "<private>"} for m in PRIVATE.finditer(t or "")] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["doc_id", "text", "edits"])


def redactions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    narrow = docs.select(q(key).alias("doc_id"), q(text).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return map_batches(narrow, redact_batches, f"doc_id {kind}, text string, edits array<struct<start: long, end: long, replacement: string>>")


def token_query(docs: DataFrame) -> DataFrame:
    """Tokens of every document before and after its private data give way to a mark."""
    rows, names = with_counts(redactions(docs), "edits", keep=["doc_id"])
    return rows.select("doc_id", *[F.col(a).alias(b) for a, b in zip(names, NAMES)])
