"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often a byte followed a context of up to ``order`` bytes.  Where a
context has not seen the next byte, the model escapes to the next shorter one (method C: a context with n bytes of d
kinds escapes with d / (n + d)), and at last to 1/256 for every byte.  Statistics are frozen after training, so the
code length of (context, byte) is a constant: the trees of all languages become, per order, one sorted table of grams
(context and byte packed into one number) with a column of bits for every language.  A text's code length is the exact
sum over all its bytes; the language with the shortest one wins, the score is its posterior under equal priors.

Training counts every gram of every training row (partial counts per batch, summed by Spark).  The driver receives the
sums of all distinct grams that occur at least ``least`` times, and every worker the tables made from them: none is left
out, so they grow with the kinds of grams a language has (not with its texts) and must fit in memory.

Bytes are prepared alike in training and prediction: A-Z become lower case, ASCII digits, punctuation and white space
become one space.

Edge cases: NULL texts and texts without a letter are ``und`` with score 0; rows with a NULL language or text do not
teach; without any training row everything is ``und``; equal code lengths go to the first language in order; repeated
rows are predicted alike; other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import fold, map_batches, q, texts_of

ORDER = 3
LEAST = 1
CHUNK = 1 << 21  # bytes that are looked up at once
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def prepared(text: bytes) -> bytes:
    return b" ".join(text.translate(CLEAN).split())


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """All grams of a length, packed with the first byte highest."""
    n = len(data) - length + 1
    key = np.zeros(max(0, n), np.int64)
    for k in range(length):
        key = (key << 8) | data[k : k + n]
    return key


def count_batches(batches, *, order: int):
    """lang, text -> lang, gram of ``order`` + 1 bytes, count; one row per gram and batch of texts."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
            by.setdefault(lang, []).append(b" " * order + prepared(text) + b" ")
        names, keys, counts = [], [], []
        for lang, texts in by.items():
            part, size = [], 0
            for k, text in enumerate(texts):
                part.append(grams(np.frombuffer(text, np.uint8).astype(np.int64), order + 1))
                size += len(text)
                if size > CHUNK or k == len(texts) - 1:
                    key, n = np.unique(np.concatenate(part), return_counts=True)
                    names += [lang] * len(key)
                    keys.append(key)
                    counts.append(n)
                    part, size = [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], names=["lang", "gram", "n"])


def trained(rows: DataFrame, text: str = "text", lang: str = "lang", *, order: int = ORDER, least: int = LEAST) -> SimpleNamespace:
    """Frozen statistics from all of ``rows``."""
    known = rows.filter(q(lang).isNotNull() & q(text).isNotNull()).select(q(lang).alias("lang"), q(text).alias("text"))
    sums = map_batches(known, partial(count_batches, order=order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    kept = sums.toArrow()
    return frozen(kept["lang"].to_pylist(), kept["gram"].to_numpy(), kept["n"].to_numpy(), order)


def frozen(langs: list[str], gram: np.ndarray, n: np.ndarray, order: int) -> SimpleNamespace:
    """Per gram length 1 .. order + 1: sorted grams, bits per language, and bits of an escape below each context."""
    names = sorted(set(langs))
    column = {x: k for k, x in enumerate(names)}
    which = np.fromiter(map(column.__getitem__, langs), np.int64, len(langs))
    made = SimpleNamespace(names=names, order=order, keys=[], bits=[], escape=[])
    counts = []
    for length in range(order + 2):  # length 0: the empty context
        key = gram & ((1 << (8 * length)) - 1) if length < 8 else gram
        keys, at = np.unique(key, return_inverse=True)
        table = np.zeros((len(keys), len(names)))
        np.add.at(table, (at, which), n)
        counts.append((keys, table))
    below = np.full((1, len(names)), 8.0)  # before any byte: 1/256
    for length in range(order + 2):
        keys, table = counts[length]
        if length:
            context, total, kinds = contexts
            c = np.searchsorted(context, keys >> 8)
            n_, d_ = total[c], kinds[c]
            if length == 1:
                shorter = np.repeat(below, len(keys), axis=0)
            else:
                lower = counts[length - 1][0]
                shorter = made.bits[-1][np.searchsorted(lower, keys & ((1 << (8 * (length - 1))) - 1))].astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(table / (n_ + d_))
                out = np.where(n_ > 0, -np.log2(d_ / (n_ + d_)), 0.0)  # a context never met says nothing
            made.keys.append(keys)
            made.bits.append(np.where(table > 0, seen, out + shorter).astype(np.float32))
            made.escape.append((context, np.where(total > 0, -np.log2(np.where(total > 0, kinds, 1) / np.where(total > 0, total + kinds, 1)), 0.0).astype(np.float32)))
        if length <= order:
            # followers of each context of this length, from the grams one byte longer
            longer, more = counts[length + 1]
            context, at = np.unique(longer >> 8, return_inverse=True)
            total, kinds = np.zeros((len(context), len(names))), np.zeros((len(context), len(names)))
            np.add.at(total, at, more)
            np.add.at(kinds, at, more > 0)
            contexts = context, total, kinds
    return made


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def bits_of(model: SimpleNamespace, key: np.ndarray) -> np.ndarray:
    """Bits of each gram (context and byte) under each language."""
    at, seen = find(model.keys[-1], key)
    out = model.bits[-1][at]
    rest = np.flatnonzero(~seen)
    if rest.size:
        out[rest] = 0
    for length in range(model.order + 1, 0, -1):
        if not rest.size:
            return out
        mask = (1 << (8 * length)) - 1
        if length <= model.order:
            at, seen = find(model.keys[length - 1], key[rest] & mask)
            out[rest[seen]] += model.bits[length - 1][at[seen]]
            rest = rest[~seen]
        if rest.size:
            context, escape = model.escape[length - 1]
            at, seen = find(context, (key[rest] & mask) >> 8)
            out[rest[seen]] += escape[at[seen]]
    if rest.size:
        out[rest] += np.float32(8.0)
    return out


def code_lengths(model: SimpleNamespace, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language; texts are joined and cut into chunks, sums are exact per text."""
    total = np.zeros((len(texts), len(model.names)))
    pad = b" " * model.order
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            sizes = np.array([len(k) for _, k in held])
            bits = bits_of(model, np.concatenate([k for _, k in held]))
            ends = np.r_[0, np.cumsum(sizes)[:-1]]
            np.add.at(total, [i for i, _ in held], np.add.reduceat(bits, ends, axis=0, dtype=np.float64))
        held, size = [], 0

    for i, text in enumerate(texts):
        whole = pad + text + b" "
        for start in range(0, len(whole) - model.order, CHUNK):
            piece = np.frombuffer(whole[start : start + CHUNK + model.order], np.uint8).astype(np.int64)
            held.append((i, grams(piece, model.order + 1)))
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    return total


def predict_batches(batches, *, held):
    model = held.value
    for batch in batches:
        raw = texts_of(batch, 1)
        letters = [has_letter(t) for t in raw]
        total = code_lengths(model, [prepared(t) if ok else b"" for t, ok in zip(raw, letters)]) if model.names else None
        names, scores = [], []
        for i, ok in enumerate(letters):
            if not ok or total is None:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(total[i]))
            names.append(model.names[best])
            scores.append(float(1 / np.exp2(np.maximum(total[i, best] - total[i], -1000.0)).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


ASCII_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def has_letter(text: bytes) -> bool:
    """Bytes beyond ASCII may or may not be letters: only then the text itself is asked."""
    return bool(text.translate(None, ASCII_LETTERS)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def predict(docs: DataFrame, model: SimpleNamespace, text: str = "text", key: str = "doc_id", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(q(key).alias("doc_id"), q(text).alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    kind = dict(narrow.dtypes)["doc_id"]
    return map_batches(narrow, partial(predict_batches, held=held), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    out = fold(q("doc_id"), 5) == 0
    return predict(docs, trained(docs.filter(~out)), held_out=out)
