"""Prefix trie, circulant MinHash and source divergence against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from edge_cases import LONG, documents, lower, table, with_clashes
from pyspark.sql import functions as F

from readlens.llm import divergence, minhash, prefixtrie

SPACED = re.compile("[^\x20\x09-\x0d]+")
TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
CHAT_SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ---- prefix trie ---------------------------------------------------------------------
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(rows):
    chats = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            chats[c].append(((turn is not None, turn or 0), role or "", text or ""))
    chats = {c: [t[1:] for t in sorted(v)] for c, v in chats.items()}
    built = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(chats.get(c - c % 20, [])[:h]) + tuple(own[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)

    def below(prefix):
        return [p for p in members if p[: len(prefix)] == prefix]

    out = []
    for p, convs in members.items():
        sub = below(p)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(p))))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), children[p], sum(not children[q] for q in sub),
                    sum((len(members[q]) - 1) * len(SPACED.findall(q[-1][1])) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed, convs, most, words=3):
    r = random.Random(seed)
    texts = [None, "", *(" ".join(r.choice(["a", "Bé", "c\td", " "]) for _ in range(k)) for k in range(1, words))]
    return [(r.choice([c, c, c, c, None]), r.choice([None, t, t, t]), r.choice(["user", "assistant", None]), r.choice(texts))
            for c in r.sample(range(3 * convs), convs) for t in range(r.randint(0, most))]


@pytest.mark.parametrize("seed,convs,most", [(1, 60, 1), (2, 60, 3), (3, 80, 9), (4, 30, 40)])
def test_trie_brute_force(spark, seed, convs, most):
    rows = chats(seed, convs, most)
    df = spark.createDataFrame(rows, CHAT_SCHEMA)
    for name in ("pos", "n1", "own", "base", "part", "words", "depth"):
        df = df.withColumn(name, F.lit("own"))
    assert rows_of(prefixtrie.prefix_trie(df), *NODE) == brute_trie(rows)


def test_trie_of_one_very_long_conversation_and_many_equal_ones(spark):
    # 20 .. 39 share the long head; half of the conversations are exact copies
    rows = [(20, t, "user", f"turn {t}") for t in range(1000)] + [(21, t, "user", f"turn {t}") for t in range(700)] \
        + [(c, t, "user", "hello there") for c in range(100, 160) for t in range(2)] + [(40, 0, "user", LONG)]
    got = rows_of(prefixtrie.prefix_trie(spark.createDataFrame(rows, CHAT_SCHEMA).repartition(7)), *NODE)
    assert [r for r in got if r[1] in (0, 1, 2)] == [r for r in brute_trie(rows) if r[1] in (0, 1, 2)]
    assert len(got) == len(brute_trie(rows))


def test_trie_of_nothing(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], CHAT_SCHEMA)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], CHAT_SCHEMA)).count() == 0
    # crc32("1") % 4 is 3: conversation 1 loses its only turn and has no base, so only the root is left
    got = rows_of(prefixtrie.prefix_trie(spark.createDataFrame([(1, 1, "user", "x")], CHAT_SCHEMA)), *NODE)
    assert got == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_trie_rows_numbered_across_partitions(spark):
    rows = [(7, t % 50, "user", f"text {t % 10}") for t in range(600)]
    df = prefixtrie.numbered(spark.createDataFrame(rows, CHAT_SCHEMA).repartition(5))
    assert sorted(r.pos for r in df.select("pos").collect()) == list(range(600))


# ---- circulant MinHash ---------------------------------------------------------------
def shingles(text, k=3):
    words = SPACED.findall(lower(text))
    return {tuple(words[i: i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d, d == (least.get(top(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_texts(seed, groups, each, words):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
        for _ in range(each):
            own = list(base)
            for _ in range(r.randint(0, max(1, words // 25))):
                own[r.randrange(words)] = f"x{g}{r.randint(0, 30)}"
            out.append(" ".join(own))
    r.shuffle(out)
    return list(enumerate(out))


OUT = ("doc_id", "n_shingles", "component_id", "kept")


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("groups,each,words", [(25, 8, 60), (3, 90, 120), (60, 4, 9)])
def test_minhash_equals_all_pairs(spark, groups, each, words):
    rows = near_texts(groups, groups, each, words)
    assert rows_of(minhash.near_duplicates(docs_of(spark, rows)), *OUT) == brute_components(rows)


def test_minhash_blocks_and_parts(spark, monkeypatch):
    # no pivot round settles everything, and every group is dealt over several cells
    for name, value in (("PIVOT_ROUNDS", 1), ("PARTNERS", 3), ("BLOCK", 4), ("BLOCK_SHINGLES", 500)):
        monkeypatch.setattr(minhash, name, value)
    rows = near_texts(5, 4, 40, 80)
    assert rows_of(minhash.near_duplicates(docs_of(spark, rows)), *OUT) == brute_components(rows)


def test_minhash_at_the_threshold(spark):
    # 20 words have 18 shingles; texts that share 17 of 20 are linked (0.85), 16 of 20 aren't
    words = [f"w{i}" for i in range(22)]
    a, b, c = words[:21], words[2:22] + ["z"], words[:20]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(words))]
    assert rows_of(minhash.near_duplicates(docs_of(spark, rows)), *OUT) == brute_components(rows)


def test_minhash_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in documents()]
    want = [(d, n, c, kept or (d is None and c is None)) for d, n, c, kept in brute_components(rows)]
    assert rows_of(minhash.near_duplicates(with_clashes(table(spark))), *OUT) == sorted(want, key=repr)
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_minhash_signature_is_two_permutations_and_shifts():
    sigma, shifted = minhash.tables()
    size = 1 << minhash.UNIVERSE_BITS
    pi = shifted[:, 0]
    assert len(np.unique(sigma)) == len(np.unique(pi)) == size
    s = np.array([3, 2**63, 2**64 - 1, 12345678901234567890], dtype=np.uint64)
    places = sigma[(s >> np.uint64(64 - minhash.UNIVERSE_BITS)).astype(np.int64)].astype(np.int64)
    want = [min(int(pi[(p + k) % size]) for p in places) for k in range(minhash.BANDS * minhash.ROWS)]
    assert minhash.signature(s).tolist() == want


def test_minhash_signatures_estimate_jaccard():
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 1300, dtype=np.int64).astype(np.uint64)
    a, b = minhash.signature(np.unique(x[:1150])), minhash.signature(np.unique(x[150:]))
    assert abs((a == b).mean() - 1000 / 1300) < 0.12


# ---- source divergence -----------------------------------------------------------------
def brute_divergence(rows, least=10):
    groups, df, counts = collections.defaultdict(set), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in ((t or "", la or "", s or "") for _, t, la, s, _ in rows):
        terms = TERMS.findall(lower(text))
        groups[lang].add(source)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= least]

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1000000000 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), collections.Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, item.decode(), -v, k) for part, found, most in (("pair", pair, None), ("term", term, 10)) for k, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


def audit_rows(seed, n):
    r = random.Random(seed)
    words = ["a", "Ab", "é", "日本", "x1y", "z_z", "Zz", *(f"w{chr(97 + i)}" for i in range(20))]
    out = []
    for i in range(n):
        source = r.choice([None, "", "s1", "s2", "s3", "é"])
        mine = words[len(source or ""):] if r.random() < 0.5 else words
        text = r.choice([None, "", "12 34", "same text ab AB", " ".join(r.choices(mine, k=r.randint(1, 30)))])
        out.append((i, text, r.choice([None, "", "en", "en", "en", "de"]), source, None))
    return out


def test_divergence_brute_force(spark, monkeypatch):
    rows = audit_rows(1, 400)
    want = brute_divergence(rows)
    assert {"pair", "term"} == {r[2] for r in want}
    df = with_clashes(table(spark, rows))
    assert rows_of(divergence.divergence(df), *AUDIT) == want
    # small buffers: folded and added up in many pieces
    monkeypatch.setattr(divergence, "FOLDED", 500)
    monkeypatch.setattr(divergence, "HELD", 10)
    assert rows_of(divergence.divergence(df.repartition(9)), *AUDIT) == want


def test_divergence_awkward_rows(spark):
    assert rows_of(divergence.divergence(with_clashes(table(spark))), *AUDIT) == brute_divergence(documents())
    assert divergence.divergence(table(spark, [])).count() == 0
    # a third of all rows is one text
    rows = audit_rows(2, 200) + [(i, "same text in every source Same", "en", f"s{i % 4}", None) for i in range(100)]
    assert rows_of(divergence.divergence(table(spark, rows)), *AUDIT) == brute_divergence(rows)


def test_divergence_tokenizes_long_texts_in_slices(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("abÉ \n1Z") for _ in range(5000)) + "y" * 200
    want = divergence.term_counts(text.encode())
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert divergence.term_counts(text.encode()) == want == collections.Counter(t.encode() for t in TERMS.findall(lower(text)))


def test_divergence_shares_beyond_64_bits(spark):
    n, total, kept = 9 * 10**18, 9 * 10**18 + 12345, 1000
    df = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    assert df.select(divergence._share("n", "total", "kept")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# ---- the SQL forms -------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op2_jaccard_join", "op3_decontaminate", "op11_prefix_trie", "op12_minhash_dedup", "op13_source_divergence"])
def test_sql_gives_the_same_rows(spark, name):
    from readlens.llm import registry

    sf = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).to_arrow_table().select(got.columns).to_pylist()
    assert rows_of(got, *got.columns) == sorted((tuple(r[c] for c in got.columns) for r in want), key=repr)
