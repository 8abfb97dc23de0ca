"""The word-pair model and the scores of ``op6_quality`` against a model written out in plain Python."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlens.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["the", "a", "dog", "cat", "runs", "sleeps", "über", "Qx", *(f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(24))]
    texts = [" ".join(r.choices(words, weights=[30, 20, *[3] * (len(words) - 2)], k=r.randint(1, 40))) for _ in range(n)]
    return [(i, t, r.choice(["en", "en", "de", None])) for i, t in enumerate(texts)] + [(n, "", "en"), (n + 1, None, "en"), (n + 2, "zzz qqq", "fr")]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return [0.0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))]


class Model:
    """Interpolated modified Kneser-Ney of word pairs over a table of spellings; words that occur once and pairs that occur
    less than three times have no entry, and their share goes to the interpolation."""

    def __init__(self, texts, spelled):
        self.spelled, self.pairs, self.times = spelled, collections.Counter(), collections.Counter()
        for t in texts:
            w = ["<", *t.split(" "), ">"]
            self.pairs.update(zip(w, w[1:], strict=False))
            self.times.update(w)
        self.d = discounts(self.pairs.values())
        self.before = collections.Counter(w for _, w in self.pairs)
        self.dw = discounts(self.before.values())
        self.all = len(self.pairs)
        self.left = sum(self.dw[min(c, 3)] if self.has(w) else c for w, c in self.before.items()) / self.all

    def has(self, w):
        return self.times[w] > 1 or w in "<>"

    def word(self, w):
        rest = self.left * math.exp(-self.spelled(w))
        c = self.before[w]
        return (c - self.dw[min(c, 3)]) / self.all + rest if c and self.has(w) else rest

    def pair(self, v, w):
        mine = {x: n for (y, x), n in self.pairs.items() if y == v}
        if not mine or not self.has(v):
            return self.word(w)
        total, n = sum(mine.values()), mine.get(w, 0)
        rest = sum(self.d[3] if k > 2 else k for k in mine.values()) / total
        return (n - self.d[3] if n > 2 else 0.0) / total + rest * self.word(w)

    def loss(self, text):
        w = ["<", *text.split(" "), ">"]
        return -sum(math.log(self.pair(a, b)) for a, b in zip(w, w[1:], strict=False))


def speller(table):
    """What a word costs by its characters, read from the character model alone."""
    logs = quality.unpack(table)

    def cost(w):
        if w == ">":  # a blank for the end of a text
            raw = np.frombuffer(b" ", dtype=np.uint8)
            return float(quality._spelled(raw, np.array([0]), np.array([0]), logs)[0])
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        return float(quality._spelled(raw, np.array([0]), np.array([len(raw)]), logs)[0])

    return cost


@pytest.mark.parametrize("seed,head", [(1, quality.HEAD), (2, 40), (3, 0)])
def test_losses_and_classes_equal_a_plain_model(spark, monkeypatch, seed, head):
    monkeypatch.setattr(quality, "HEAD", head)  # all keys held, some, or none
    monkeypatch.setattr(quality, "COUNT_BYTES", 500)
    rows = rows_of(seed, 120)
    trusted = {i for i, *_ in rows if i % 3 == 0}
    df = spark.createDataFrame(rows, SCHEMA)
    half = {r.doc_id: r.h for r in df.select("doc_id", quality._half(F.col("doc_id")).alias("h")).collect()}
    texts = df.where(F.col("doc_id").isin(sorted(trusted))).select(quality._half(F.col("doc_id")).alias("half"), "text")
    spell = quality.spelling(texts)
    model, unknown = quality.train(texts, spell)
    got = {r.doc_id: r for r in quality.losses(df, model, spell, unknown).collect()}
    plain = [Model([t for i, t, _ in rows if i in trusted and half[i] == h and t], speller(spell[h])) for h in (0, 1)]
    assert min(len(m.pairs) for m in plain) > 100
    want = {i: plain[1 - half[i]].loss(t) if t else 0.0 for i, t, _ in rows}
    assert set(got) == set(want)
    for i, t, lang in rows:
        assert (got[i].lang, got[i].n_symbols) == (lang, len((t or "").encode()))
        assert got[i].loss == pytest.approx(want[i], rel=1e-5, abs=1e-3), (i, t)

    # thresholds: each language's quantile over its trusted documents; fr has none, so all of them count
    labels = spark.createDataFrame([(i, int(i in trusted)) for i, *_ in rows], "doc_id long, quality int")
    entropy = []
    for h in (0, 1):
        mine = [i for i, t, _ in rows if i in trusted and half[i] == h and t]
        entropy.append(sum(want[i] for i in mine) / sum(got[i].n_symbols for i in mine))
    value = {i: math.exp((want[i] + quality.PRIOR * entropy[half[i]]) / (got[i].n_symbols + quality.PRIOR)) for i in want}

    def cut(ids):
        v = sorted(value[i] for i in ids)
        return v[max(1, math.ceil(len(v) * 0.9)) - 1] if v else None

    scored = {r.doc_id: r for r in quality.classify(df, labels, 0.9).collect()}
    by_lang = {la: cut([i for i, t, x in rows if x == la and i in trusted and t]) for la in {x for *_, x in rows}}
    everywhere = cut([i for i, t, _ in rows if i in trusted and t])
    for i, t, lang in rows:
        limit = by_lang[lang] if by_lang[lang] is not None else everywhere
        assert scored[i].perplexity == pytest.approx(value[i], rel=1e-4)
        assert scored[i].threshold == pytest.approx(limit, rel=1e-4)
        if abs(value[i] - limit) > 1e-3:
            assert scored[i].keep == (bool(t) and value[i] <= limit)


def test_pairs_are_counted_over_tasks_and_halves(spark):
    rows = [(0, "a b a b"), (0, "a b"), (1, "b"), (0, None), (1, ""), (0, "a b")]
    texts = spark.createDataFrame(rows, "half int, text string").repartition(4)
    counted = quality.count_pairs(texts).collect()
    by_half = collections.Counter()
    for r in counted:
        by_half[r.half] += r.n
    # words and the end of each text; single spaces are no words
    assert by_half == {0: 5 + 3 + 3, 1: 2}
    assert sorted(r.n for r in counted if r.half == 0) == [1, 3, 3, 4] and sorted(r.n for r in counted if r.half == 1) == [1, 1]


def test_words_of_pairs_come_from_the_partition_named_with_them(spark, tmp_path):
    rows = [(i % 2, " ".join(["a b c", "c b a", "b b"][: 1 + i % 3])) for i in range(40)]
    spark.createDataFrame(rows, "half int, text string").repartition(5).write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    quality._kept(quality.counted(texts)).write.parquet(f"{tmp_path}/k")
    kept = spark.read.parquet(f"{tmp_path}/k").where(F.col("kind").isin(quality.PAIR, quality.WORD, quality.ENDS))
    spell = quality.spelling(texts)
    every = sorted(map(tuple, quality._described(texts, kept, spell, by_part=False).collect()))
    assert len(every) == kept.count() > 20
    assert sorted(map(tuple, quality._described(texts, kept, spell).collect())) == every
    assert quality._described(texts, kept.withColumn("part", F.lit(99)), spell).count() < len(every)  # which train() notices


class WholeModel(Model):
    """Every word and every pair that occurs has an entry."""

    def has(self, w):
        return self.times[w] > 0

    def pair(self, v, w):
        mine = {x: n for (y, x), n in self.pairs.items() if y == v}
        if not mine:
            return self.word(w)
        total, n = sum(mine.values()), mine.get(w, 0)
        return (n - self.d[min(n, 3)]) / total + sum(self.d[min(k, 3)] for k in mine.values()) / total * self.word(w)


@pytest.mark.parametrize("head", [quality.HEAD, 0])
def test_the_query_has_an_entry_for_every_word_and_pair(spark, monkeypatch, tmp_path, head):
    from readlens.llm import registry

    monkeypatch.setattr(quality, "HEAD", head)  # all keys held, or none
    rows = rows_of(7, 120)
    trusted = sorted(i for i, *_ in rows if i % 3 == 0)
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    half = {r.doc_id: r.h for r in df.select("doc_id", quality._half(F.col("doc_id")).alias("h")).collect()}
    spell = quality.spelling(df.where(F.col("doc_id").isin(trusted)).select(quality._half(F.col("doc_id")).alias("half"), "text"))
    plain = [WholeModel([t for i, t, _ in rows if i in trusted and half[i] == h and t], speller(spell[h])) for h in (0, 1)]
    assert min(sum(n < 3 for n in m.pairs.values()) for m in plain) > 50
    want = {i: plain[1 - half[i]].loss(t) if t else 0.0 for i, t, _ in rows}
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    entropy = [sum(want[i] for i in trusted if half[i] == h) / sum(size[i] for i in trusted if half[i] == h) for h in (0, 1)]
    got = {r.doc_id: r.perplexity for r in registry.queries()["op6_quality"](spark, str(tmp_path)).collect()}
    for i in want:
        assert got[i] == pytest.approx(math.exp((want[i] + quality.PRIOR * entropy[half[i]]) / (size[i] + quality.PRIOR)), rel=1e-4), i


@pytest.mark.parametrize("head", [quality.HEAD, 40])
def test_the_whole_model_is_joined_part_by_part(spark, monkeypatch, head):
    """No table of all pairs is joined at once; what the parts add up to is the loss by one model, for repeated rows too."""
    monkeypatch.setattr(quality, "HEAD", head)
    rows = rows_of(11, 60)
    rows += [*rows[:7], (None, "the dog runs", "en"), (None, "the dog runs", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    trusted = df.where("doc_id % 3 = 0").dropDuplicates(["doc_id"])
    texts = trusted.select(quality._half(F.col("doc_id")).alias("half"), "text")
    spell = quality.spelling(texts)
    model, unknown = quality.train(texts, spell, 1)
    want = sorted((str(r.doc_id), r.n_symbols, r.loss) for r in quality.losses(df, model, spell, unknown).collect())
    sizes, scored = [], quality.losses

    def noting(docs, part, *rest):
        sizes.append(part.count())
        return scored(docs, part, *rest)

    monkeypatch.setattr(quality, "losses", noting)
    path = quality.scratch_path(spark, "texts")
    got = quality._whole_losses(df, quality._written(texts, path), path, spell)
    got = sorted((str(r.doc_id), r.n_symbols, r.loss) for r in got.collect())
    assert len(got) == len(want) == len(rows)
    for g, w in zip(got, want, strict=True):
        assert g == (*w[:2], pytest.approx(w[2], rel=1e-5, abs=1e-3))
    assert sum(sizes) == model.count() and max(sizes) < 0.4 * sum(sizes)


def test_character_counts_are_the_same_in_parts(spark, monkeypatch):
    texts = spark.createDataFrame([(i % 2, t) for i, (_, t, _) in enumerate(rows_of(4, 80))], "half int, text string").repartition(3)
    whole = quality.count_ngrams(texts)
    assert whole.sum(axis=1).tolist() == [sum(len((r.text or "").encode()) for r in texts.collect() if r.half == h) for h in (0, 1)]
    monkeypatch.setattr(quality, "GRAM_BYTES", 100)
    monkeypatch.setattr(quality, "GRAMS_HELD", 50)
    assert (quality.count_ngrams(texts) == whole).all()
