"""Operators on documents against brute force, with the awkward cases of ``edge_cases``."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from edge_cases import LONG, documents, lower, table, with_clashes
from pyspark.sql import functions as F

from readlens.llm import decontaminate, fingerprints, jaccard_join, langid, linededup, mixing, quality, tokens
from readlens.llm.registry import token_path

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ---- fingerprints ------------------------------------------------------------------
def test_fingerprints_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None and r[0] != 14]
    got = {r.doc_id: r for r in fingerprints.fingerprints(with_clashes(table(spark, rows)), parts=5).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        v, e, n = (fingerprints.vector(x) for x in (text, edited, after))
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (fingerprints.to_text(v), fingerprints.to_text(e))
        assert g.near_edited == pytest.approx(fingerprints.likeness(v, e)) and 0 <= g.near_next <= 1
        assert g.near_next == pytest.approx(fingerprints.likeness(v, n))


def test_fingerprints_all_cases_and_empty(spark):
    assert fingerprints.fingerprints(table(spark), parts=3).count() == len(documents())
    assert fingerprints.fingerprints(table(spark, [])).count() == 0
    one = fingerprints.fingerprints(table(spark, documents()[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_is_homomorphic():
    lines = ["one two three four", "", "five six", "one two three four", "seven"]
    whole = fingerprints.to_text(fingerprints.vector("\n".join(lines)))
    assert whole == fingerprints.to_text(fingerprints.vector("\n".join(reversed(lines))))
    built = fingerprints.to_text(fingerprints.vector(""))
    for x in lines:
        built = fingerprints.add(built, x)
    assert built == whole
    assert fingerprints.subtract(whole, "seven") == fingerprints.to_text(fingerprints.vector("\n".join(lines[:-1])))
    assert whole != fingerprints.to_text(fingerprints.vector("\n".join(lines[:-1])))


# ---- Jaccard join --------------------------------------------------------------------
def shingles(text):
    w = SPACED.findall(lower(text))
    return {tuple(w[a: a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)] += [i] if i is not None else []
    return sorted(((i, len(s), (min(least[find(a)]) if least[find(a)] else None) if s else i) for a, (i, s) in enumerate(sets)), key=repr)


def family(seed, base_words, copies, share):
    """Near copies of one text, at every distance up to ``share``."""
    r = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(base_words)]
    out = [base]
    for c in range(copies):
        words = list(base)
        for at in r.integers(0, base_words, int(share * base_words * (c + 1) / copies / 5)):
            words[at] = f"e{c}x{at}"
        out.append(words)
    return [" ".join(w) for w in out]


def test_components_brute_force(spark):
    assert rows_of(jaccard_join.components(with_clashes(table(spark))), "doc_id", "n_shingles", "component_id") == brute_components(documents())


def test_components_of_families(spark, monkeypatch):
    texts = family(1, 200, 60, 0.6) + family(2, 60, 90, 0.45) + family(3, 12, 30, 0.9) + [f"own text number {i} stands here alone" for i in range(40)]
    passage = " ".join(f"common{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"t{k}x{i}" for i in range(k)) for k in range(1, 60)]
    rows = [(i + 1, t, None, None, None) for i, t in enumerate(texts)]
    want = brute_components(rows)
    assert len({c for *_, c in want}) < len(want)
    assert rows_of(jaccard_join.components(table(spark, rows)), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard_join, "SMALL_CELL", 3)  # cells that pass through, and more pivots
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 3)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 7)
    monkeypatch.setattr(jaccard_join, "PART_ROWS", 50)
    assert rows_of(jaccard_join.components(table(spark, rows)), "doc_id", "n_shingles", "component_id") == want


def test_a_large_component_meets_others_in_blocks(spark, monkeypatch):
    """A pair of a member of a large component and another text of its cell is compared, but is no row."""
    base = [f"w{i}" for i in range(100)]

    def changed(name, *at):
        return " ".join(f"{name}x{i}" if i in at else w for i, w in enumerate(base))

    ball = {k: changed(f"a{k}", 50 + k) for k in range(40)}
    others = {100 + k: changed(f"b{k}", 50 + k, 65 + k, 80 + k) for k in range(14)} | {200: changed("c", 53, 54, 56), 201: changed("d", 70, 71, 73)}
    texts = ball | others
    sets = {k: shingles(t) for k, t in texts.items()}
    todo = spark.createDataFrame([(cell, k, len(s), 120, 0 if k in ball else k, 2) for cell in (1, 2) for k, s in sets.items()],
                                 "cell long, node long, n int, cap int, root long, cells long")
    measured = spark.createDataFrame([(k, 0, len(s & sets[0]), len(s | sets[0])) for k, s in sets.items() if k], jaccard_join.LINKS)
    pairs, linked = [], jaccard_join.linked

    def counting(df, texts):
        pairs.append(df.count())
        return linked(df, texts)

    monkeypatch.setattr(jaccard_join, "linked", counting)
    want = {(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    between = {(a, b) for a, b in want if b not in ball}
    assert between
    for block, small in ((6, 64), (6, 3), (64, 3)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "SMALL_CELL", small)
        found = {(min(r.a, r.b), max(r.a, r.b)) for r in jaccard_join._rest(todo, measured, spark.createDataFrame(list(texts.items()), "node long, text string")).collect()}
        assert between <= found <= want
    assert max(pairs) < len(others) * len(ball) / 2, pairs


def test_components_empty_and_stage(spark):
    assert jaccard_join.components(table(spark, [])).count() == 0
    kept = jaccard_join.keep_first(with_clashes(table(spark)))
    assert kept.columns == with_clashes(table(spark)).columns
    assert kept_rows(kept) == brute_first(documents())


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def brute_first(rows):
    """One row of each component, the one with the least id (null last); all rows without words."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            if s and sets[b] and 100 * len(s & sets[b]) >= 80 * len(s | sets[b]):
                root[find(a)] = find(b)
    out, best = [], {}
    for a, r in enumerate(rows):
        if not sets[a]:
            out.append((r[0], r[1]))
        else:
            best.setdefault(find(a), []).append((r[0] is None, r[0], r[1]))
    return sorted(out + [min(v, key=lambda x: (x[0], x[1] or 0))[1:] for v in best.values()], key=repr)


def test_keep_first_row_by_row(spark):
    t, u = documents()[0][1], documents()[3][1]
    rows = [(1, t), (1, t), (2, t), (None, t), (None, u), (None, u), (3, "alone in the world with these words"), (3, "another text under the same number"),
            (None, "no number and no copy at all here"), (5, None), (5, ""), (None, " ")]
    docs = table(spark, [(i, x, None, None, None) for i, x in rows])
    want = [(1, t), (None, u), (3, "alone in the world with these words"), (3, "another text under the same number"),
            (None, "no number and no copy at all here"), (5, None), (5, ""), (None, " ")]
    for parts in (1, 5):
        assert kept_rows(jaccard_join.keep_first(docs.repartition(parts))) == sorted(want, key=repr)
    # of rows that differ in other columns only, reruns keep the same one
    docs = table(spark, [(1, t, lang, source, None) for lang in ("en", None, "de") for source in ("b", "a")])
    kept = [r for _ in range(2) for r in jaccard_join.keep_first(docs.repartition(3)).collect()]
    assert len(kept) == 2 and kept[0] == kept[1]


def test_all_links(spark, monkeypatch):
    base = " ".join(f"b{i}" for i in range(60))
    texts = [" ".join([base, *(f"t{i}x{k}" for k in range(i % 14))]) for i in range(40)] + family(6, 200, 20, 0.4)
    texts.append(texts[3])  # a copy: no text of its own
    sets = [shingles(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    own = sorted(first.values())
    want = {(a, b) for a in own for b in own if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    degree = collections.Counter(x for pair in want for x in pair)
    assert len(want) > 5 * len(own)
    for block in (256, 3):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = [(r.doc_a, r.doc_b) for r in jaccard_join.linked_pairs(docs).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        counts = {r.doc_id: r.n_links for r in jaccard_join.components(docs).collect()}
        assert counts == {i: degree[first[frozenset(s)]] for i, s in enumerate(sets)}


def test_connected_components(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.root for x in jaccard_join.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_connected_components_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART_ROWS", 20)
    test_connected_components(spark)


def test_few_edges_are_closed_without_shuffles(spark, monkeypatch):
    """The driver keeps a thread for every shuffle of the last minute."""
    steps, kept = [], jaccard_join.materialize

    def noting(df, *mode):
        steps.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return kept(df, *mode)

    monkeypatch.setattr(jaccard_join, "materialize", noting)
    got = {x.node: x.root for x in jaccard_join.connected_components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 10)}
    assert len(steps) > 2 and not any(steps[1:]), steps


def test_links_are_closed_once(spark, monkeypatch):
    """One search for components after the pivots and one, from its result, with the links of the rest."""
    rows = [(i + 1, t, None, None, None) for i, t in enumerate(family(5, 40, 60, 0.6))]
    seen, closed = [], jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda edges: seen.append(1) or closed(edges))
    assert rows_of(jaccard_join.components(table(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert len(seen) <= 2


# ---- decontamination -----------------------------------------------------------------
BENCH = [(1, documents()[0][1]), (2, documents()[3][1].title()), (3, "hi"), (4, None), (5, "!!"), (None, "12 34"), (3, "日本語 テスト"), (10, "wizards box quietly near an old stone bridge the quick brown")]


def brute_hits(rows, bench):
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = ALNUM.findall(lower(text))
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a: a + n])].add(item)
    out = []
    for i, text, *_ in rows:
        w, hit, items = ALNUM.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a: a + n]) in windows:
                    hit.update(range(a, a + n))
                    items |= windows[tuple(w[a: a + n])]
        names = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [400_000, 8])
def test_decontamination_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate.mark_benchmark_words, "__defaults__", ("hits", 10, limit))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.report(with_clashes(table(spark)), bench)
    assert rows_of(got, *got.columns) == brute_hits(documents(), BENCH)


def test_decontamination_removal(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = with_clashes(table(spark))
    kept = decontaminate.decontaminate(docs, bench)
    clean = [r[0] for r in brute_hits(documents(), BENCH) if not r[-1]]
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    cut = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, mode="span").collect()}
    assert cut[3].text == " indeed" and cut[3].n_chars == 7
    assert cut[4].text == "" and cut[6].text == documents()[5][1]
    assert cut[16].text == "\n" + documents()[5][1] + "\n"  # neighbouring runs go with what is between them
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, mode="?")
    assert decontaminate.report(table(spark, []), bench).count() == 0
    assert decontaminate.report(table(spark), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


# ---- mixing --------------------------------------------------------------------------
def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > cap * sizes[s]}
        if not full:
            target.update({s: level * w[s] for s in free})
            break
        target.update({s: cap * sizes[s] for s in full})
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return target


def many_sources(n=3000, seed=1):
    r = np.random.default_rng(seed)
    source = r.choice(["a", "b", "c", "d", "é", None], n, p=[0.5, 0.2, 0.2, 0.05, 0.03, 0.02])
    return [(i, " ".join(["w"] * int(r.lognormal(3, 1))), None, s, None) for i, s in enumerate(source)]


def test_mixing_targets_and_balance(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)  # several rounds
    rows = many_sources()
    got = mixing.mix_sources(with_clashes(table(spark, rows))).toPandas()
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = collections.Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    target = brute_targets(sizes)
    taken = collections.Counter()
    for r in got.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    again = mixing.mix_sources(table(spark, rows).repartition(3)).toPandas()
    assert again.set_index("doc_id").taken.to_dict() == got.set_index("doc_id").taken.to_dict()


def test_mixing_cases_and_stage(spark):
    got = mixing.mix_sources(table(spark))
    assert got.count() == len(documents()) and got.where("taken > 3 * size").count() == 0
    assert mixing.mix_sources(table(spark, [])).count() == 0
    docs = with_clashes(table(spark))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in n.items() if v}


# ---- language ------------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_language_cases(spark):
    got = langid.predictions(with_clashes(table(spark)))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(documents())
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (7, 8, 9, 10))
    assert rows[15].lang_pred != "und" and rows[1].lang_pred == rows[2].lang_pred
    unlabelled = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predictions(unlabelled).collect()} == {"und"}
    assert langid.predictions(table(spark, [])).count() == 0
    kept = langid.keep_identified(with_clashes(table(spark)), langid.train(table(spark)))
    assert kept.columns == with_clashes(table(spark)).columns
    assert not {7, 8, 9, 10} & {r.doc_id for r in kept.collect()}


# ---- quality -------------------------------------------------------------------------
def test_kneser_ney_is_a_distribution_and_matches_the_formula(monkeypatch):
    monkeypatch.setattr(quality, "SYMBOLS", 4)
    monkeypatch.setattr(quality, "ORDER", 3)
    r = np.random.default_rng(2)
    counts = np.minimum(r.geometric(0.4, 64) - 1, 9).astype(np.uint32)
    p = np.exp(quality.kneser_ney(counts)).reshape(16, 4)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and (p > 0).all()
    c3 = counts.reshape(4, 4, 4)
    c2 = (c3 > 0).sum(axis=0)
    c1 = (c2 > 0).sum(axis=0)
    d3, d2, d1 = quality._discounts(c3), quality._discounts(c2), quality._discounts(c1)

    def one(c, d, total, lower):
        gamma = sum(d[min(x, 3)] for x in total)
        return lower if not sum(total) else max(c - d[min(c, 3)], 0) / sum(total) + gamma / sum(total) * lower

    for a in range(4):
        for b in range(4):
            for w in range(4):
                lower = one(c2[b, w], d2, c2[b], one(c1[w], d1, c1, 0.25))
                assert p[4 * a + b, w] == pytest.approx(one(int(c3[a, b, w]), d3, c3[a, b], lower), rel=1e-4)


def test_ngram_counts(spark):
    docs = table(spark).withColumn("half", F.lit(1))
    got = quality.count_ngrams(docs)
    want = collections.Counter()
    for _, text, *_ in documents():
        s = [int(quality.CLASS[b]) for b in b"\n\n\n" + (text or "").encode()]
        want.update(tuple(s[i - 3: i + 1]) for i in range(3, len(s)))
    flat = {int(np.ravel_multi_index(k, (64,) * 4)): v for k, v in want.items()}
    assert {int(i): int(got[1][i]) for i in np.flatnonzero(got[1])} == flat and not got[0].any()


def test_quality_keeps_clean_and_drops_noise(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.2


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (4, 1)], "doc_id long, quality int")
    got = quality.classify(with_clashes(table(spark)), labels)
    assert got.count() == len(documents())
    assert not [r for r in got.collect() if r.doc_id in (7, 8) and r.keep]
    none = quality.classify(table(spark), labels.where("false"))
    assert {r.doc_id for r in none.where("not keep").collect()} == {7, 8, None}
    assert quality.classify(table(spark, []), labels).count() == 0


def test_quality_evidence_grows_with_trusted_words(spark):
    """Shuffled words of a script with no letters of its own class are told from the trusted order of words."""
    r = np.random.default_rng(8)
    words = ["".join(chr(0x430 + int(c)) for c in r.integers(0, 32, 6)) for _ in range(60)]
    follow = {w: words[(i * 7 + 3) % 60] for i, w in enumerate(words)}

    def chain(seed):
        out = [words[seed % 60]]
        while len(out) < 80:
            out.append(follow[out[-1]])
        return out

    rows = [(i, " ".join(chain(i)), "ru", "a", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(r.permutation(chain(i))), "ru", "a", 0) for i in range(20)]
    rows += [(2000 + i, " ".join(chain(i)), "ru", "a", 0) for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    keep = {x.doc_id: x.keep for x in quality.classify(table(spark, rows), labels).collect()}
    assert len(keep) == 240 and not any(keep[1000 + i] for i in range(20))
    assert all(keep[2000 + i] for i in range(20))
    few = quality.count_pairs(spark.createDataFrame([(0, "a 1 a 1"), (0, "a 2 本本")], "half int, text string"))
    # start a, a 1, 1 a, 1 end; start a, a 2, 2 本, 本 本, 本 end
    assert sorted(x.n for x in few.collect()) == [1, 1, 1, 1, 1, 1, 2, 2]


# ---- line dedup ----------------------------------------------------------------------
def brute_lines(rows, least=50):
    order = sorted({(i is None, i or 0, t) for i, t, *_ in rows if t is not None}, key=lambda x: x[:2])
    seen, gone = {}, collections.defaultdict(set)
    for place, (_, i, text) in enumerate(order):
        lines = text.split("\n")
        words = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            total = 0
            for b in range(a, min(len(lines), a + 40)):
                total += words[b]
                if total >= least:
                    key = tuple(lines[a: b + 1])
                    if seen.setdefault(key, (place, a)) < (place, a):
                        gone[i].update(range(a, b + 1))
    return gone


def test_line_dedup_brute_force(spark):
    r = np.random.default_rng(9)
    pool = [" ".join(f"l{k}w{j}" for j in range(int(r.integers(0, 30)))) for k in range(60)]
    rows = []
    for i in range(120):
        at = int(r.integers(0, 50))
        mine = pool[at: at + int(r.integers(1, 12))] + [f"line {i} {j}" for j in range(int(r.integers(0, 4)))] + pool[:: int(r.integers(5, 30))]
        rows.append((i + 1, "\n".join(mine), None, None, None))
    gone = brute_lines(rows)
    assert sum(map(len, gone.values())) > 100
    for x in linededup.dedup_lines(with_clashes(table(spark, rows))).collect():
        lines = rows[x.doc_id - 1][1].split("\n")
        assert x.text == "\n".join(t for k, t in enumerate(lines) if k not in gone[x.doc_id]) and x.n_deleted == len(gone[x.doc_id])


def test_line_dedup_cases(spark):
    got = linededup.dedup_lines(table(spark))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(documents()) and rows[7].text is None and rows[8].text == ""
    assert rows[16].n_deleted == 0 and rows[17].text == "x" and rows[11].text == LONG
    assert linededup.dedup_lines(table(spark, [])).count() == 0


# ---- token ids -----------------------------------------------------------------------
def test_elias_fano_round_trip():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (1000, 3), (1000, 10**9), (4097, 4097)):
        v = np.sort(r.integers(0, top, n))
        f = tokens.EliasFano.from_bytes(tokens.EliasFano.encode(v).to_bytes())
        assert (f.decode() == v).all() and [f.select(i) for i in range(0, n, 7)] == v[::7].tolist()
        if n == 1000 and top == 10**9:
            assert 8 * len(f.to_bytes()) < n * (2 + np.log2(top / n) + 2)
    with pytest.raises(IndexError):
        tokens.EliasFano.encode(np.array([1])).select(1)


def brute_tokens(rows, path, width="<u4"):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(path), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype=width)
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_round_trip(spark, name, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 500)
    odd = ["don't!'s it's İstanbul ŉ", "<|endoftext|> a<|startoftext|>b", "a\xa0b c ΣΑΣ ας", "x\x0by\x1cz", "´ª² ½ ٣", "'S 'RE we'LL ''s"]
    rows = documents() + [(100 + i, t, None, None, None) for i, t in enumerate(odd)]
    got = tokens.token_id_output(with_clashes(table(spark, rows)), token_path(name))
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == brute_tokens(rows, token_path(name))


def test_token_ids_empty(spark):
    assert tokens.token_id_output(table(spark, []), token_path()).count() == 0


def test_encoder_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    enc = tokens.Encoder(token_path())
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(9)) for i in range(20)]
    assert [enc.encode([t])[0] for t in texts] == enc._whole(texts)
    assert enc.encode(texts) == enc._whole(texts)
