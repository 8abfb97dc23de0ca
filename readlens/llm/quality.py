"""Quality by an interpolated modified Kneser-Ney model of words, trained on trusted text.

Words are open: runs of letters, runs of digits and runs of blanks other than one space, and every mark and every
character of three or four bytes (Chinese, Japanese, Korean ...) alone.  Pairs of a word and the one before it are counted
over all trusted documents, as are the words, by keys of 64 bits in DataFrames that grow with them.  The query's model
(``entry`` = 1) has an entry for every word and pair that occurs; its keys are counted and joined in ``PARTS`` parts, one after the
other, so that a part's shuffles are gone before the next part's.  A caller may prune it: with a larger ``entry``, pairs that
occur less often, and words that occur once, count in every statistic (discounts, contexts, continuations) but have no entry
of their own, and what they would hold goes to the interpolation.  A word without an entry is spelled: below the words lies a Kneser-Ney model of ``ORDER`` characters in 64
classes, a table of 2 * 64**4 values that only tells how odd a new word looks.

An interpolated model of pairs (v, w) splits into terms that add up: what w costs when it is spelled, what it saves if
it has an entry, what v adds for a pair without one, and what the pair saves if it has one.  So the model is one
table (key, value), and a text's loss is the sum of the values of its keys.  The ``HEAD`` most frequent keys, which
most of any text consists of, are held by every task, so no common word is ever shuffled; the rarer ones are joined.

Counts are kept in two halves: a document is scored by the model of the half that it, by its id's
hash, isn't in, so that trusted documents don't look better for having been counted.  A document's perplexity, per
character, counts
``PRIOR`` further characters at that model's entropy over the other half, so that short texts don't stand out by
chance.  A document is kept if its perplexity is at most the
``KEEP_QUANTILE`` of the trusted documents in its language (of all trusted documents, where its language has none;
``percentile_approx`` with a rank error of 1e-4).

Cases: null and empty texts have no characters, the prior's perplexity, and are not kept; null lang is a language of its
own; without any trusted document the model is uniform and everything with text is kept; repeated rows are scored row
by row and counted as often as they occur; repeated labels count once; a null doc_id is never trusted; texts of any length
are scored whole, some megabytes of texts at a time; further columns are ignored; words are known by 64-bit hashes; an
empty table gives no rows."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlens.llm.common import (U, broadcast_value, drop_shuffles, fixed_size_sum, frees, maybe_in, membership, mix, only, range_hashes,
                                 row_slices, scratch_path, stored, string_batch, within)
from readlens.plans.materialize import delete_folder, lifetime

SYMBOLS, ORDER, SLICES = 64, 4, 64
PRIOR = 300
KEEP_QUANTILE = 0.995
#: The most frequent keys of the model, at most this many, are held by every task (12 bytes each); the others are joined.
HEAD, COUNTED_TO = 1 << 22, 4096
#: In a pruned model, pairs have an entry from so many occurrences on, words from two on; with 1, all have one.
ENTRY = 3
#: The whole model's keys are counted, and joined with the documents, in this many parts, one after the other.
PARTS = 4
#: Bits of the filter for the keys that are joined.
RARE_BITS = 1 << 28
#: Bytes of trusted texts whose words are counted at once.
COUNT_BYTES = 1 << 22
#: Bytes of trusted texts whose n-grams of characters are counted at once, and how many different ones a task holds.
GRAM_BYTES, GRAMS_HELD = 1 << 18, 1 << 22


def _classes() -> np.ndarray:
    """Byte to symbol: a-z 0-25, A-Z 26-51, digits 52, blank 53, line end 54, common marks 55-58, other ASCII 59,
    bytes of non-ASCII characters 60-63 by their low bits."""
    out = np.full(256, 59, dtype=np.int32)
    codes = np.arange(256)
    out[0x61:0x7B] = np.arange(26)
    out[0x41:0x5B] = 26 + np.arange(26)
    out[0x30:0x3A] = 52
    out[[0x20, 0x09]] = 53
    out[[0x0A, 0x0D]] = 54
    out[ord(".")], out[ord(",")], out[ord("'")], out[ord("-")] = 55, 56, 57, 58
    out[codes >= 0x80] = 60 + (codes[codes >= 0x80] & 3)
    return out


CLASS = _classes()
#: Step of a packed log probability, and the loss that each byte stands for.
STEP = 0.06
LOSS = STEP * np.arange(256)


def _kinds() -> np.ndarray:
    """Byte to kind of word: blanks 0, letters 1 (two-byte characters too), digits 2, marks 3, longer characters 4."""
    out = np.full(256, 3, dtype=np.int8)
    out[0x41:0x5B] = out[0x61:0x7B] = out[0xC0:0xE0] = 1
    out[0x30:0x3A] = 2
    out[0xE0:] = 4
    out[[0x20, *range(0x09, 0x0E)]] = 0
    return out


KIND = _kinds()
#: What stands before the first word and after the last; what keeps the keys of both halves' models apart.
START, END = U(0x5BD1E995C2B2AE35), U(0x27D4EB2F165667C5)
MODEL = mix(np.array([11, 12]))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text) of each word; single spaces only part words."""
    n = len(data)
    later = (data & 0xC0) == 0x80  # bytes within a character
    kind = KIND[data][np.maximum.accumulate(np.where(later, 0, np.arange(n)))]
    begin = kind >= 3
    begin[1:] |= kind[1:] != kind[:-1]
    begin &= ~later
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)[: len(starts)]
    word = (ends - starts > 1) | (data[starts] != 0x20)
    starts, ends = starts[word], ends[word]
    return range_hashes(data, starts, ends), starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _pairs(key: np.ndarray, text: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of the word before, key of the word, text) of every pair, from START to END, where words have these keys and
    texts stand for these halves."""
    of = np.repeat(np.arange(len(half)), np.bincount(text, minlength=len(half)) + 1)
    before, word = (_model_key(np.repeat(x, 2), np.arange(2))[half[of]] for x in (START, END))
    at = np.arange(len(key)) + text
    before[at + 1] = word[at] = key
    return before, word, of


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a pair, from those of its words in the same half's model."""
    return (mix(mix(before + U(1)) + word) & ~U(1)) | (word & U(1))


def _part_of(key: np.ndarray) -> np.ndarray:
    return (key.view(U) >> U(1)) % U(PARTS)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What each word costs by its characters and the blank after it."""
    size = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)
    letters = data[np.minimum(at, len(data) - 1)]
    letters[offsets[1:] - 1] = 0x20
    index, _ = _grams(letters, offsets, 0x20)
    return np.add.reduceat(LOSS[table[index]], offsets[:-1]) if len(starts) else np.zeros(0)


def _grams(data: np.ndarray, offsets: np.ndarray, lead: int = 0x0A) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram index at each character, text of each): texts are led in by line ends."""
    sizes = np.diff(offsets)
    pad = ORDER - 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.full(len(data) + pad * len(sizes), CLASS[lead], dtype=np.int64)
    at = np.arange(len(data)) + pad * (text + 1)
    padded[at] = CLASS[data]
    index = np.zeros(len(data), dtype=np.int64)
    for back in range(pad, -1, -1):
        index = index * SYMBOLS + padded[at - back]
    return index, text


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)).cast("int")


def count_ngrams(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of ``text`` by ``half`` (0 or 1), added up in Spark shard by shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what occurs, not the whole table, which has room for 2 * 64**4 counts
        grams, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            half, (data, offsets) = batch.column(0).to_numpy(), string_batch(batch.column(1))
            for i, j in row_slices(offsets, GRAM_BYTES):
                index, text = _grams(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                index += half[i:j][text] * SYMBOLS**ORDER
                found, n = np.unique(index, return_counts=True)
                grams, at = np.unique(np.concatenate([grams, found]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([total, n]), minlength=len(grams)).astype(np.int64)
                if len(grams) > GRAMS_HELD:
                    yield from slices_of(grams, total)
                    grams, total = grams[:0], total[:0]
        yield from slices_of(grams, total)

    def slices_of(grams: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = SYMBOLS**ORDER // SLICES
        ends = np.searchsorted(grams, size * np.arange(2 * SLICES + 1))
        for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if z > a:
                part = np.zeros(size, dtype=np.uint32)
                part[grams[a:z] - k * size] = total[a:z]
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "packed": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    counts = fixed_size_sum(only(texts, "half", "text").mapInArrow(count, "slice int, packed binary"), np.uint32, 2 * SLICES)
    return counts.reshape(2, -1)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more (Chen and Goodman)."""
    return _discounts_of([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def _discounts_of(n: list[int]) -> np.ndarray:
    """The same from how many n-grams have a count of 1, 2, 3 and 4."""
    if min(n) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [k + 1 - (k + 2 if k < 3 else 4) * y * n[k + 1] / n[k] if k < 3 else 0.0 for k in range(3)]
    return np.clip(np.array(d), 0.0, [0.0, 1.0, 2.0, 3.0])


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Log probability of each n-gram's last symbol."""
    if not len(counts) or not counts.any():
        return np.full(SYMBOLS**ORDER, -np.log(SYMBOLS), dtype=np.float32)
    # lower orders count the different symbols that come before
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.append((tables[-1].reshape(SYMBOLS, SYMBOLS**order) > 0).sum(axis=0))
    p = np.full((1, SYMBOLS), 1.0 / SYMBOLS, dtype=np.float32)
    for c in reversed(tables):
        d = _discounts(c).astype(np.float32)
        blocks = c.reshape(-1, *p.shape)  # by the first symbol; all use the same lower order
        out = np.empty(blocks.shape, dtype=np.float32)
        for count, found in zip(blocks, out, strict=True):
            take = d[np.minimum(count, 3).astype(np.int8)]
            total = count.sum(axis=1, keepdims=True, dtype=np.float32)
            with np.errstate(invalid="ignore", divide="ignore"):
                seen = (count.astype(np.float32) - take + take.sum(axis=1, keepdims=True) * p) / total
            found[:] = np.where(total > 0, seen, p)
        p = out.reshape(-1, SYMBOLS)
    return np.log(np.maximum(p, 1e-12, out=p), out=p).ravel()


def pack(logp: np.ndarray) -> bytes:
    """A table of log probabilities, one byte each in steps of ``STEP``, compressed: unseen contexts repeat theirs."""
    return zlib.compress(np.clip(np.rint(logp / -STEP), 0, 255).astype(np.uint8).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    """The table's bytes; ``LOSS`` has what each stands for."""
    return np.frombuffer(zlib.decompress(packed), dtype=np.uint8)


_TABLES: dict[int, np.ndarray] = {}


def _table(packed: bytes) -> np.ndarray:
    """One unpacked table for each Python worker and model."""
    key = hash(packed)
    if key not in _TABLES:
        if len(_TABLES) > 3:
            _TABLES.clear()
        _TABLES[key] = unpack(packed)
    return _TABLES[key]


def spelling(texts: DataFrame) -> list[bytes]:
    """The packed character models of half 0 and 1."""
    return [pack(kneser_ney(c)) for c in count_ngrams(texts)]


def _model_key(key: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The key of a word or pair in the model of a half, which its last bit tells."""
    return (mix(key ^ MODEL[half]) & ~U(1)) | half.astype(U)


def _signed(key: np.ndarray) -> pa.Array:
    return pa.array(key.view(np.int64))


#: Kinds of counted rows: a pair, a word, the starts and the ends of texts; and what ``_kept`` counts of the rows it drops.
PAIR, WORD, STARTS, ENDS = range(4)
PAIRS_OF = (10, 11, 12, 13)  # pairs that occur 1, 2, 3 and 4 times
PAIRS_ALL, WORDS_ONCE = 14, 15
COUNTED = "key long, n long, kind int, part int"


def counted(texts: DataFrame) -> DataFrame:
    """(key, n, kind, part): how often each pair of words and each word occurs in the half its key tells, and the first
    partition of ``texts`` that has it."""

    def batch_of(key: np.ndarray, n: np.ndarray, kind: int) -> pa.RecordBatch:
        same = (pa.array(np.full(len(key), x, dtype=np.int32)) for x in (kind, TaskContext.get().partitionId()))
        return pa.RecordBatch.from_arrays([_signed(key), pa.array(n.astype(np.int64)), *same], names=["key", "n", "kind", "part"])

    @frees
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, (data, offsets) = batch.column(0).to_numpy(), string_batch(batch.column(1))
            for i, j in row_slices(offsets, COUNT_BYTES):
                part, own, h = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], half[i:j]
                if not len(part):
                    continue
                hashes, _, _, text = _words(part, own)
                words = _model_key(hashes, h[text])
                before, word, of = _pairs(words, text, h)
                full = np.diff(own) > 0
                sel = full[of]
                yield batch_of(*np.unique(_pair_key(before[sel], word[sel]), return_counts=True), PAIR)
                yield batch_of(*np.unique(words, return_counts=True), WORD)
                for kind, name in ((STARTS, START), (ENDS, END)):
                    yield batch_of(*np.unique(_model_key(np.repeat(name, int(full.sum())), h[full]), return_counts=True), kind)

    rows = only(texts, "half", "text").mapInArrow(count, COUNTED)
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"), F.min("part").alias("part"))


def _half_of(key: str = "key") -> Column:
    return F.col(key).bitwiseAND(F.lit(1)).cast("int")


def count_pairs(texts: DataFrame) -> DataFrame:
    """(key, half, n): every pair of words with how often it occurs."""
    return counted(texts).where(F.col("kind") == PAIR).select("key", _half_of().alias("half"), "n")


def _kept(rows: DataFrame, least: int = 2) -> DataFrame:
    """The counted rows that the model is made of, those from ``least`` occurrences on, and (half, n, kind, null) rows that
    say how many pairs and words there are."""

    @frees
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            key, n, kind = (batch.column(i).to_numpy() for i in (0, 1, 2))
            half = key & 1
            for h in (0, 1):
                own, words = n[(half == h) & (kind == PAIR)], n[(half == h) & (kind == WORD)]
                for k, name in enumerate(PAIRS_OF, 1):
                    seen[h, name] = seen.get((h, name), 0) + int((own == k).sum())
                seen[h, PAIRS_ALL] = seen.get((h, PAIRS_ALL), 0) + len(own)
                seen[h, WORDS_ONCE] = seen.get((h, WORDS_ONCE), 0) + int((words == 1).sum())
            yield batch.filter(pa.array((n >= least) | (kind >= STARTS)))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array(list(seen.values()), pa.int64()),
                                          pa.array([k for _, k in seen], pa.int32()), pa.nulls(len(seen), pa.int32())], names=["key", "n", "kind", "part"])

    return rows.mapInArrow(keep, COUNTED)


def _placed(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    return mix(key.astype(U) ^ mix(part.astype(U) + U(1)))


def _described(texts: DataFrame, kept: DataFrame, spell: list[bytes], by_part: bool = True) -> DataFrame:
    """``kept`` (key, n, kind) with what its keys stand for, read from the trusted texts once more: the keys v and w of a
    pair's words, what a word costs by its characters (spelled).  ``by_part``: each only from the partition named with
    it, so that what is frequent isn't sent by every task."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_signed(_placed(*(batch.column(i).to_numpy() for i in (0, 1))))], names=["key"])

    named = kept.select("key", "part").mapInArrow(places, "key long") if by_part else kept
    shared = broadcast_value(texts.sparkSession, (membership(named, "key"), spell))

    @frees
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, spell = shared.value
        here = np.array([TaskContext.get().partitionId()])

        def some(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The distinct keys that may be wanted, and where each first stands."""
            at = np.flatnonzero(maybe_in(wanted, _placed(key, here) if by_part else key))
            key, first = np.unique(key[at], return_index=True)
            return key, at[first]

        def batch_of(key: np.ndarray, v: pa.Array | None, w: pa.Array | None, spelled: np.ndarray | None) -> pa.RecordBatch:
            empty = pa.nulls(len(key), pa.int64())
            cost = pa.nulls(len(key), pa.float32()) if spelled is None else pa.array(spelled.astype(np.float32))
            return pa.RecordBatch.from_arrays([_signed(key), v or empty, w or empty, cost], names=["key", "v", "w", "spelled"])

        for batch in batches:
            half, (data, offsets) = batch.column(0).to_numpy(), string_batch(batch.column(1))
            for i, j in row_slices(offsets, COUNT_BYTES):
                part, own, h = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], half[i:j]
                if not len(part):
                    continue
                hashes, starts, ends, text = _words(part, own)
                words = _model_key(hashes, h[text])
                before, word, of = _pairs(words, text, h)
                full = np.diff(own) > 0
                sel = np.flatnonzero(full[of])
                key, at = some(_pair_key(before[sel], word[sel]))
                yield batch_of(key, *(_signed(x[sel[at]]) for x in (before, word)), None)
                for m in (0, 1):
                    mine, table = np.flatnonzero((h == m)[text]), _table(spell[m])
                    key, at = some(words[mine])
                    yield batch_of(key, None, None, _spelled(part, starts[mine[at]], ends[mine[at]], table))
                    key, at = some(_model_key(np.repeat(END, int((full & (h == m)).sum())), np.array([m])))
                    yield batch_of(key, None, None, _spelled(part, at * 0, at * 0, table))

    found = only(texts, "half", "text").mapInArrow(find, "key long, v long, w long, spelled float")
    return found.groupBy("key").agg(*(F.max(c).alias(c) for c in ("v", "w", "spelled"))).join(kept.select("key", "n", "kind"), "key")


def _by_half(values: list, half: Column) -> Column:
    return F.when(half == 0, F.lit(float(values[0]))).otherwise(F.lit(float(values[1])))


def _off(count: str, d: list[np.ndarray], half: Column) -> Column:
    """The discount of a count."""
    at = F.least(F.col(count), F.lit(3))
    return F.when(at == 1, _by_half([x[1] for x in d], half)).when(at == 2, _by_half([x[2] for x in d], half)).otherwise(_by_half([x[3] for x in d], half))


def train(texts: DataFrame, spell: list[bytes], entry: int = ENTRY, path: str | None = None) -> tuple[DataFrame, list[float]]:
    """The model (key, value, n), stored at ``path``, and for each half what every word costs before anything is known of it.

    Every statistic is that of all pairs: where ``entry`` is above 1, a word's tokens that no pair seen twice accounts for
    are pairs seen once, each a different one.  Only the entries of pairs seen less than ``entry`` times are left out, and
    what they would have held goes to the interpolation."""
    path = path or scratch_path(texts.sparkSession, "quality-model")
    with lifetime():
        model, left = _trained(texts, spell, entry)
        model.write.parquet(path)
    drop_shuffles(texts.sparkSession)
    return texts.sparkSession.read.schema(model.schema).parquet(path), [-np.log(x) for x in left]


def _trained(texts: DataFrame, spell: list[bytes], entry: int) -> tuple[DataFrame, list[float]]:
    spark, least = texts.sparkSession, min(entry, 2)
    kept = stored(_kept(counted(texts), least), "quality-kept")
    drop_shuffles(spark)
    numbers = {(r["key"], r["kind"]): r["n"] for r in kept.where(F.col("kind") >= PAIRS_OF[0]).groupBy("key", "kind").agg(F.sum("n").alias("n")).collect()}  # 12 rows
    half, zero = _half_of(), F.lit(0).cast("long")
    d = [_discounts_of([numbers.get((h, k), 0) for k in PAIRS_OF]) for h in (0, 1)]
    total = [max(1, numbers.get((h, PAIRS_ALL), 0)) for h in (0, 1)]  # different pairs of a half: the sum of c
    once = [numbers.get((h, WORDS_ONCE), 0) if least > 1 else 0 for h in (0, 1)]  # words without an entry
    entries = kept.where(F.col("kind").isin(PAIR, WORD, ENDS))
    known = stored(_described(texts, entries, spell), "quality-entries")
    if known.count() != entries.count():  # ``texts`` didn't come in the same partitions again
        known = stored(_described(texts, entries, spell, by_part=False), "quality-entries")
    drop_shuffles(spark)
    pairs = known.where(F.col("kind") == PAIR)

    # words: c is the number of different words before a word
    after = pairs.groupBy(F.col("w").alias("key")).agg(F.sum("n").alias("in_pairs"), F.count(F.lit(1)).alias("pairs"))
    words = known.where(F.col("kind").isin(WORD, ENDS)).join(after, "key", "left").select(
        "key", "n", "spelled", (F.col("n") - F.coalesce("in_pairs", zero) + F.coalesce("pairs", zero)).alias("c"))
    words, left = _word_losses(stored(words, "quality-words"), total, once)

    # contexts: what pairs with an entry give up, and all that the others have
    own = pairs.where(F.col("n") >= entry)
    of_v = own.groupBy(F.col("v").alias("key")).agg(F.sum("n").alias("in_pairs"), F.sum(_off("n", d, half)).alias("off"))
    contexts = kept.where(F.col("kind").isin(WORD, STARTS)).join(of_v, "key").select(
        "key", F.col("n").alias("total"), F.greatest((F.col("off") + F.col("n") - F.col("in_pairs")) / F.col("n"), F.lit(1e-6) / F.col("n")).alias("rest"))
    contexts = stored(contexts, "quality-contexts")
    both = own.join(contexts.withColumnRenamed("key", "v"), "v").join(words.select(F.col("key").alias("w"), "loss"), "w")
    single = words.select("key", F.col("saved").alias("value"), "n").unionByName(contexts.select("key", (-F.log("rest")).alias("value"), F.col("total").alias("n"))) \
        .groupBy("key").agg(F.sum("value").alias("value"), F.max("n").alias("n"))
    drop_shuffles(spark)
    return single.unionByName(_saved_by_pairs(both, d)).select("key", F.col("value").cast("float").alias("value"), "n"), left


def _saved_by_pairs(pairs: DataFrame, d: list[np.ndarray]) -> DataFrame:
    """(key, value, n) of pairs with their contexts (total, rest) and what their words cost (loss)."""
    lower, own = F.col("rest") * F.exp(-F.col("loss")), F.col("n") - _off("n", d, _half_of())
    return pairs.select("key", (F.log(lower) - F.log(own / F.col("total") + lower)).alias("value"), "n")


def _word_losses(words: DataFrame, total: list[int], once: list[int]) -> tuple[DataFrame, list[float]]:
    """``words`` (spelled, c: the number of different words before a word) with what each costs and what it saves against its
    spelling; and what is left of each half to the spelling."""
    half = _half_of()
    shape = {(r["half"], r["c"]): r["k"] for r in words.groupBy(half.alias("half"), F.least("c", F.lit(5)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 10 rows
    dw = [_discounts_of([shape.get((h, k), 0) + (once[h] if k == 1 else 0) for k in (1, 2, 3, 4)]) for h in (0, 1)]
    taken = [sum(k * dw[h][min(c, 3)] for (x, c), k in shape.items() if x == h) + once[h] for h in (0, 1)]
    left = [max(t, 1e-6) / n if n > 1 else 1.0 for t, n in zip(taken, total, strict=True)]
    p = (F.col("c") - _off("c", dw, half)) / _by_half(total, half) + _by_half(left, half) * F.exp(-F.col("spelled"))
    return words.withColumns({"loss": -F.log(p), "saved": -F.log(p) + F.log(_by_half(left, half)) - F.col("spelled")}), left


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- a model with an entry for every word and pair, part by part -----------------------
def pair_counts(texts: DataFrame, part: int) -> DataFrame:
    """(v, w, n): the keys of the words of each pair in this part and how often it occurs, pairs of a first word together."""

    @frees
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, (data, offsets) = batch.column(0).to_numpy(), string_batch(batch.column(1))
            for i, j in row_slices(offsets, COUNT_BYTES):
                part_data, own, h = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], half[i:j]
                if not len(part_data):
                    continue
                hashes, _, _, text = _words(part_data, own)
                before, word, of = _pairs(_model_key(hashes, h[text]), text, h)
                key = _pair_key(before, word)
                mine = np.flatnonzero((np.diff(own) > 0)[of] & (_part_of(key) == part))
                _, first, n = np.unique(key[mine], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(_signed(x[mine[first]]) for x in (before, word)), pa.array(n.astype(np.int64))], names=["v", "w", "n"])

    rows = only(texts, "half", "text").mapInArrow(count, "v long, w long, n long")
    return rows.groupBy("v", "w").agg(F.sum("n").alias("n")).sortWithinPartitions("v")


def word_counts(texts: DataFrame, spell: list[bytes]) -> DataFrame:
    """(key, n, spelled): how often each word, and the starts (never spelled) and ends of texts, occur; what a word costs by its
    characters."""

    @frees
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(key: np.ndarray, n: np.ndarray, cost: np.ndarray | None) -> pa.RecordBatch:
            spelled = pa.nulls(len(key), pa.float32()) if cost is None else pa.array(cost.astype(np.float32))
            return pa.RecordBatch.from_arrays([_signed(key), pa.array(n.astype(np.int64)), spelled], names=["key", "n", "spelled"])

        for batch in batches:
            half, (data, offsets) = batch.column(0).to_numpy(), string_batch(batch.column(1))
            for i, j in row_slices(offsets, COUNT_BYTES):
                part, own, h = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], half[i:j]
                if not len(part):
                    continue
                hashes, starts, ends, text = _words(part, own)
                full = np.diff(own) > 0
                for m in (0, 1):
                    mine, table, texts_of_m = np.flatnonzero((h == m)[text]), _table(spell[m]), int((full & (h == m)).sum())
                    found, at, n = np.unique(hashes[mine], return_index=True, return_counts=True)
                    yield batch_of(_model_key(found, np.repeat(m, len(found))), n, _spelled(part, starts[mine[at]], ends[mine[at]], table))
                    if texts_of_m:
                        n, zero = np.array([texts_of_m]), np.array([0])
                        yield batch_of(_model_key(np.array([START]), np.array([m])), n, None)
                        yield batch_of(_model_key(np.array([END]), np.array([m])), n, _spelled(part, zero, zero, table))

    rows = only(texts, "half", "text").mapInArrow(count, "key long, n long, spelled float")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("spelled").alias("spelled"))


def _word_table(pairs: DataFrame, words: DataFrame) -> tuple[DataFrame, list[np.ndarray], list[float]]:
    """(key, n, loss, rest, value): what each word costs, what its context leaves to the interpolation, the value of its own
    entry; the discounts of pairs; and what is left of each half to the spelling."""
    spark, half = pairs.sparkSession, _half_of()
    times = {(r["half"], r["n"]): r["k"] for r in pairs.groupBy(_half_of("v").alias("half"), F.least("n", F.lit(5)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 10 rows
    d = [_discounts_of([times.get((h, k), 0) for k in (1, 2, 3, 4)]) for h in (0, 1)]
    total = [max(1, sum(k for (x, _), k in times.items() if x == h)) for h in (0, 1)]
    after = stored(pairs.groupBy(F.col("w").alias("key")).agg(F.count(F.lit(1)).alias("c")), "quality-after")
    drop_shuffles(spark)
    contexts = stored(pairs.groupBy(F.col("v").alias("key")).agg(F.sum(_off("n", d, _half_of("v"))).alias("off")), "quality-contexts")
    drop_shuffles(spark)
    words = stored(words.join(after, "key", "left").join(contexts, "key", "left"), "quality-words")  # starts have no c, ends no context
    known, left = _word_losses(words.where("c is not null"), total, [0, 0])
    starts = words.where("c is null").withColumns({"loss": F.lit(0.0), "saved": F.lit(0.0)})
    rest = F.greatest(F.col("off") / F.col("n"), F.lit(1e-6) / F.col("n"))
    table = known.unionByName(starts).withColumn("rest", F.when(F.col("off").isNotNull(), rest).otherwise(F.lit(1.0)))
    numbers = {"loss": F.col("loss"), "rest": F.col("rest"), "value": F.col("saved") - F.log("rest")}
    return stored(table.select("key", "n", *(c.cast("double").alias(k) for k, c in numbers.items())), "quality-word-table"), d, left


def _pair_values(pairs: DataFrame, words: DataFrame, d: list[np.ndarray]) -> DataFrame:
    """(key, value, n) of the pairs (v, w, n): the most frequent words are held by every task, pairs with others are joined
    with those."""
    (keys, total, rest, loss), others = _split(words.withColumn("total", F.col("n").cast("double")), ["key", "total", "rest", "loss"], HEAD // 3)
    shared = broadcast_value(pairs.sparkSession, (keys, total, rest, loss))

    @frees
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total, rest, loss = shared.value

        def of(values: np.ndarray, at: np.ndarray, hit: np.ndarray) -> pa.Array:
            return pa.array(values[at], mask=~hit) if len(values) else pa.nulls(len(at), pa.float64())

        for batch in batches:
            v, w = (batch.column(i).to_numpy() for i in (0, 1))
            of_v, of_w = _found(keys, v), _found(keys, w)
            yield pa.RecordBatch.from_arrays([_signed(_pair_key(v.view(U), w.view(U))), *batch.columns, of(total, *of_v), of(rest, *of_v), of(loss, *of_w)],
                                             names=["key", "v", "w", "n", "total", "rest", "loss"])

    found = pairs.select("v", "w", "n").mapInArrow(find, "key long, v long, w long, n long, total double, rest double, loss double")
    if others is None:
        return _saved_by_pairs(found, d)
    begun = found.where("total is null").drop("total", "rest").join(others.select(F.col("key").alias("v"), "total", "rest"), "v")
    placed = found.where("total is not null")
    ended = placed.unionByName(begun).where("loss is null").drop("loss").join(others.select(F.col("key").alias("w"), "loss"), "w")
    return _saved_by_pairs(placed.unionByName(begun).where("loss is not null").unionByName(ended), d)


def _whole_losses(docs: DataFrame, texts: DataFrame, texts_path: str, spell: list[bytes]) -> DataFrame:
    """``losses`` by a model with an entry for every word and pair.  The keys are dealt to ``PARTS`` parts.  Parts are counted
    one after the other, and then each is joined with all documents and dropped, so that the shuffles of only one part
    are on disk at a time.  The texts, stored at ``texts_path``, are dropped when all are counted."""
    spark, paths, pairs = texts.sparkSession, [scratch_path(texts.sparkSession, "quality-pairs") for _ in range(PARTS)], []
    for part, path in enumerate(paths):
        pairs.append(_written(pair_counts(texts, part), path))
        drop_shuffles(spark)
    words, d, left = _word_table(functools.reduce(DataFrame.unionByName, pairs), stored(word_counts(texts, spell), "quality-word-counts"))
    delete_folder(spark, texts_path)
    scored = []
    for part, path in enumerate(paths):
        with lifetime():
            values = _pair_values(pairs[part], words, d).unionByName(words.where(F.shiftrightunsigned("key", 1) % PARTS == part).select("key", "value", "n"))
            model = _written(values.select("key", F.col("value").cast("float").alias("value"), "n"), scratch_path(spark, "quality-model"))
            delete_folder(spark, path)
            drop_shuffles(spark)
            scored.append(_written(losses(docs, model, spell, [-np.log(x) for x in left], part), path))
        drop_shuffles(spark)
    # a row's losses come once for each part, those of equal rows together
    same = ["doc_id", "lang", "half", "n_symbols", "text_hash"]
    found = functools.reduce(DataFrame.unionByName, scored).groupBy(*same).agg(F.sum("loss").alias("loss"), (F.count(F.lit(1)) / PARTS).cast("long").alias("rows"))
    return found.select(*same, (F.col("loss") / F.col("rows")).alias("loss"), F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")


_DTYPES = {"long": np.int64, "float": np.float32, "double": np.float64}


def _split(model: DataFrame, columns: list[str], most: int) -> tuple[list[np.ndarray], DataFrame | None]:
    """The columns of the most frequent keys (the first column), at most ``most`` of them, in order of the key; and the others,
    or None."""
    often = F.least("n", F.lit(COUNTED_TO)).cast("long")
    sizes = sorted(((r["n"], r["k"]) for r in model.groupBy(often.alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # COUNTED_TO rows at most
    held, least = 0, COUNTED_TO + 1
    for n, k in sizes:
        if held + k > most:
            break
        held, least = held + k, n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy().tobytes()], pa.binary()) for i in range(len(columns))], names=columns)

    parts = model.where(often >= least).select(columns).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns)).collect()  # ``most`` keys, some bytes each
    held = [np.frombuffer(b"".join(r[c] for r in parts), dtype=_DTYPES[model.schema[c].dataType.typeName()]) for c in columns]
    order = np.argsort(held[0])
    everything = least <= (sizes[-1][0] if sizes else 0) or not sizes
    return [x[order] for x in held], None if everything else model.where(often < least).select(columns)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among the sorted ``keys``, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def losses(docs: DataFrame, model: DataFrame, spell: list[bytes], unknown: list[float], of_part: int | None = None) -> DataFrame:
    """(doc_id, lang, half, n_symbols, text_hash, loss) of every row: a row's keys are looked up among the most frequent ones
    where it is read; the distinct others that the model may have are joined with it.  ``of_part``: the model has the keys of
    this part only, and so has the loss; what words cost before any key is known belongs to part 0."""
    share = 1 if of_part is None else 2
    (keys_held, values_held), rest = _split(model, ["key", "value"], HEAD // share)
    known = membership(rest, "key", RARE_BITS // share) if rest is not None else np.zeros(0, dtype=np.uint8)
    shared = broadcast_value(docs.sparkSession, (spell, unknown, keys_held, values_held, known))

    @frees
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("lang", pa.string()),
                            ("half", pa.int32()), ("n_symbols", pa.int64()), ("loss", pa.float64()), ("text_hash", pa.int64())])
        spell, unknown, keys_held, values_held, known = shared.value
        for batch in batches:
            data, offsets = string_batch(batch.column(2))
            half, row, loss = batch.column(3).to_numpy(), batch.column(4).to_numpy(), np.zeros(batch.num_rows)
            for i, j in row_slices(offsets):
                part, own = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
                if not len(part):
                    continue
                hashes, starts, ends, text = _words(part, own)
                full, other = np.diff(own) > 0, 1 - half[i:j]
                words = _model_key(hashes, other[text])
                before, word, of = _pairs(words, text, other)
                end_word = np.array([0])
                for h in (0, 1) if not of_part else ():  # the models of the other half
                    mine = (other == h)[text]
                    spelled = _spelled(part, starts[mine], ends[mine], _table(spell[h])) + unknown[h]
                    closing = _spelled(part, end_word, end_word, _table(spell[h]))[0] + unknown[h]
                    loss[i:j] += np.bincount(text[mine], weights=spelled, minlength=j - i) + np.where(full & (other == h), closing, 0)
                lead = np.flatnonzero(full)
                sel = full[of]
                key = np.concatenate([words, *(_model_key(np.repeat(x, len(lead)), other[lead]) for x in (START, END)), _pair_key(before[sel], word[sel])]).view(np.int64)
                of = np.concatenate([text, lead, lead, of[sel]])
                if of_part is not None:
                    mine = np.flatnonzero(_part_of(key) == of_part)
                    key, of = key[mine], of[mine]
                if len(keys_held):
                    order = np.argsort(key)  # look-ups in order stay in the processor's cache
                    key, of = key[order], of[order]
                    at, hit = _found(keys_held, key)
                    loss[i:j] += np.bincount(of[hit], weights=values_held[at[hit]], minlength=j - i)
                    key, of = key[~hit], of[~hit]
                some = maybe_in(known, key)
                key, of = key[some], of[some]
                order = np.lexsort((key, of))
                key, of = key[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]))[: len(key)]
                n = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(row[i:j][of[first]]), pa.array(key[first]), pa.array(n.astype(np.int32)), *(
                    pa.nulls(len(first), t.type) for t in list(schema)[3:])], schema=schema)
            # the row itself, under a key of its own
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(mix(row.astype(U)).view(np.int64)), pa.array(np.zeros(len(row), dtype=np.int32)), batch.column(0),
                                              batch.column(1), pa.array(half), pa.array(np.diff(offsets)), pa.array(loss), batch.column(5)], schema=schema)

    rows = docs.select("doc_id", "lang", "text", _half(F.col("doc_id")).alias("half"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_hash")) \
        .mapInArrow(keys, "row long, key long, n int, doc_id long, lang string, half int, n_symbols long, loss double, text_hash long")
    if rest is None:
        return rows.drop("row", "key", "n")
    found = rows.join(rest, "key", "left").groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "lang", "half", "n_symbols", "text_hash")),
        (F.max("loss") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("value"))), F.lit(0.0))).alias("loss"))
    return found.drop("row")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = KEEP_QUANTILE, entry: int = ENTRY) -> DataFrame:
    """Per document: doc_id, lang, perplexity, threshold, keep.  Trusted documents are those labelled quality 1.  Pairs have
    an entry in the model from ``entry`` occurrences on."""
    trusted = only(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null") \
        .select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = only(docs, "doc_id", "lang", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = rows.sparkSession
    path = scratch_path(spark, "quality-losses")
    with lifetime():
        # first by a bit table of fixed size, which lets a few others through; the join leaves the trusted ones
        near = within(rows, "doc_id", membership(trusted, "doc_id"))
        texts_path = scratch_path(spark, "quality-texts")
        texts = _written(near.join(trusted, "doc_id", "left_semi").select(_half(F.col("doc_id")).alias("half"), "text"), texts_path)  # read several times
        drop_shuffles(spark)
        spell = spelling(texts)
        if entry > 1:
            model, unknown = train(texts, spell, entry)
            delete_folder(spark, texts_path)
            found = losses(rows, model, spell, unknown)
        else:
            found = _whole_losses(rows, texts, texts_path, spell)
        found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    drop_shuffles(spark)
    sums = {r.half: r for r in found.join(trusted, "doc_id", "left_semi").groupBy("half").agg(
        F.sum("loss").alias("loss"), F.sum("n_symbols").alias("n")).collect()}  # one row a half
    entropy = [sums[h].loss / sums[h].n if h in sums and sums[h].n else np.log(SYMBOLS) for h in (0, 1)]
    value = F.exp((F.col("loss") + PRIOR * _by_half(entropy, F.col("half"))) / (F.col("n_symbols") + PRIOR))
    scored = found.select("doc_id", "lang", "n_symbols", value.alias("perplexity"))
    per_doc = scored.where("n_symbols > 0").join(trusted, "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10000)
    by_lang = per_doc.groupBy("lang").agg(cut.alias("own"))
    everywhere = per_doc.agg(cut.alias("all"))
    out = scored.alias("s").join(by_lang.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang")), "left") \
        .join(F.broadcast(everywhere), F.lit(True), "left")  # one row
    threshold = F.coalesce("own", "all")
    keep = (F.col("n_symbols") > 0) & (F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))))
    return out.select("doc_id", F.col("s.lang").alias("lang"), "perplexity", threshold.alias("threshold"), keep.alias("keep"))
