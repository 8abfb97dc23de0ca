"""Operators against plain-Python brute force on random small inputs
(random text dates with junk, hot entities, NULL ids)."""

import random
import re
from collections import Counter, defaultdict

import pytest

from readlens.functions.expr import MONTH_ABBREVIATIONS
from readlens.operators import attention as at
from readlens.operators import genres as gn

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def random_rows(seed, n=1500):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        book = rnd.choice(["1"] * 30 + [str(i) for i in range(2, 25)] + [None, "x"])  # book 1 is hot
        kind = rnd.random()
        if kind < 0.05:
            d = None
        elif kind < 0.08:
            d = ""
        elif kind < 0.10:
            d = "Tue Foo 03 08:19:07 -0800 2015"
        else:
            y = rnd.choice([2001, 2002, 2003, 2004, 2005, 101])
            d = f"{rnd.choice(WEEKDAYS)} {rnd.choice(MONTH_ABBREVIATIONS)} {rnd.randint(1, 28):02d} 10:00:00 -0800 {y:04d}"
        rows.append((book, d))
    return rows


def py_year(d):
    m = re.search(r"(\d{4})$", d) if d else None
    return int(m.group(1)) if m else None


def py_month(d):
    m = re.match(r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+\d{1,2}\s", d) if d else None
    return MONTH_ABBREVIATIONS.index(m.group(1)) + 1 if m and m.group(1) in MONTH_ABBREVIATIONS else None


def py_long(s):
    try:
        return int(s)
    except (TypeError, ValueError):
        return None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_attention_features_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "book_id string, date_added string")
    monthly = Counter()
    for b, d in rows:
        y, m = py_year(d), py_month(d)
        if d and y is not None and m is not None:
            monthly[(py_long(b), y * 100 + m)] += 1
    got_monthly = {(r.book_id, r.yyyymm): r.n_month for r in at.monthly_counts(df).collect()}
    assert got_monthly == dict(monthly)

    per = defaultdict(list)
    for (b, ym), n in monthly.items():
        if b is not None:
            per[b].append((ym, n))
    expected = {}
    for b, items in per.items():
        total = sum(n for _, n in items)
        if total < 10:
            continue
        first = min(ym for ym, _ in items)
        peak_ym, peak_n = sorted(items, key=lambda t: (-t[1], t[0]))[0]
        idx = lambda v: (v // 100) * 12 + v % 100 - 1
        expected[b] = (total, first, peak_ym, peak_n, peak_n / total, idx(peak_ym) - idx(first))
    got = {r.book_id: tuple(r)[1:] for r in at.attention_features(at.monthly_counts(df), 10).collect()}
    assert got == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_demand_share_and_culprits_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = random_rows(seed)
    inter = spark.createDataFrame(rows, "book_id string, date_added string")
    genre_rows = [(str(b), rnd.choice(["a", "b", "c"])) for b in range(1, 25) for _ in range(rnd.randint(0, 2))]
    genre_rows.append((None, "a"))
    membership = spark.createDataFrame(genre_rows, "book_id string, genre string")

    years = [(b, py_year(d)) for b, d in rows if d]
    years = [(b, y) for b, y in years if y is not None]
    totals = Counter(y for _, y in years)
    by_book = defaultdict(list)
    for b, g in genre_rows:
        if b is not None:
            by_book[b].append(g)
    counts = Counter()
    for b, y in years:
        for g in by_book.get(b, []):
            counts[(y, g)] += 1
    expected = {(y, g): (n, totals[y], n / totals[y]) for (y, g), n in counts.items()}
    got = {(r.added_year, r.genre): tuple(r)[2:] for r in gn.demand_share(inter, membership).collect()}
    assert got == expected

    hybrid = membership.where("genre = 'a'").select("book_id")
    hyb = {b for b, g in genre_rows if g == "a" and b is not None}
    window = [b for b, d in rows if d is not None and (py_year(d) or 0) in range(2002, 2005)]
    total_all = len(window)
    per_book = Counter(b for b in window if b in hyb)
    total_rom = sum(per_book.values())
    tot = gn.window_totals(inter, hybrid, 2002, 2004).first()
    assert (tot.total_all, tot.total_rom) == (total_all, total_rom)
    books = spark.createDataFrame([(str(b), f"t{b}") for b in range(1, 25)], "book_id string, title string")
    top = gn.spike_culprits(inter, hybrid, books, 2002, 2004, k=3).collect()
    ranked = sorted(per_book.items(), key=lambda t: (-t[1], t[0]))[:3]
    assert [(r.book_id, r.n_romantasy_interactions) for r in top] == ranked
    for r in top:
        assert r.share_within_romantasy == pytest.approx(r.n_romantasy_interactions / total_rom)
        assert r.share_of_total == pytest.approx(r.n_romantasy_interactions / total_all)
