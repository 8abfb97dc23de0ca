"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

1. *Duplicate-text collapse.*  Each task first folds its own copies of a text; the folded rows are dealt by (lang,
   text hash) and read in order, so that each distinct text of a language stands once, with how often each source
   has it.  A text that a third of all rows share leaves each task a few times, not once a row.
2. *Tokenize once.*  The distinct text is tokenized and its term counts are added with those multiplicities: count and
   number of documents per (lang, source, term).  A task adds up as it goes and hands its sums on when they reach
   ``HELD`` terms, so memory doesn't grow with the input.
3. *Sparse pair evaluation.*  A term that a source lacks has the same share p0 for all such terms.  With f(p, q) the
   divergence of two shares and f00 that of two p0, the value of a pair of sources is
   ``V f00 + A(a, b) + A(b, a) + C(a, b)``, where A sums f(p, p0 of the other) - f00 over the terms of one source (by distinct
   counts, not terms), and C corrects the terms that both have.  Only the last is a join of terms, and it has no row for a
   term that either lacks.

All arithmetic is exact: shares come from 38-digit decimals, since counts times 10**9 can pass 64 bits, and all later
values fit a long (p is 10**9 + 1 at most).

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, found in the UTF-8 bytes; a language keeps those in at least ``MIN_DOCS`` of its
documents.

Cases: null text, lang and source are empty strings, and so group with those; a text without terms still makes its
(lang, source) occur; repeated rows are documents of their own; equal values rank by UTF-8 order of the items; a text of any
length is tokenized in slices that end between terms; further columns are ignored; a language of one source has no pair rows,
one without kept terms has pair values 0 and no term rows; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlens.llm.common import frees, materialize, only

MIN_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Bytes of distinct texts a task folds before it hands them on, terms it adds up, and bytes tokenized at once.
FOLDED, HELD, SLICE = 8 << 20, 200_000, 1 << 20
#: UTF-8 bytes of a text with A-Z lower-cased and a space for each byte that is not part of a term.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8."""
    if len(text) <= SLICE:
        return Counter(text.translate(_BYTES).split())
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and _BYTES[text[end]] != 0x20:  # not within a term
            end += 1
        out.update(text[at:end].translate(_BYTES).split())
        at = end
    return out


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, key, text, sources, times): texts folded within each task; all rows of a (lang, key) end up next to each other."""

    @frees
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], tuple[bytes, Counter]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array([t for t, _ in held.values()], pa.binary()).cast(pa.string()),
                pa.array([list(c) for _, c in held.values()], pa.list_(pa.string())), pa.array([list(c.values()) for _, c in held.values()], pa.list_(pa.int64()))],
                names=["lang", "key", "text", "sources", "times"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                text = body.as_py()
                key = (lang, hashlib.blake2b(text, digest_size=16).digest())
                if key not in held:
                    held[key] = (text, Counter())
                    size += len(text) + 200
                held[key][1][source] += 1
                if size > FOLDED:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    whole = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    folded = whole.mapInArrow(fold, "lang string, key binary, text string, sources array<string>, times array<long>")
    return folded.repartition("lang", "key").sortWithinPartitions("lang", "key")


def _added_up(folded: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): sums of a task's distinct texts; term '' stands for the source itself."""

    @frees
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        now, text, by_source = None, b"", Counter()

        def close() -> int:
            """Adds the text at hand to the sums; returns the number of sums."""
            if now is None:
                return 0
            terms = term_counts(text)
            for source, times in by_source.items():
                all_n, all_docs = n.setdefault((now[0], source), Counter()), docs.setdefault((now[0], source), Counter())
                all_docs[b""] += times
                if times == 1:
                    all_n.update(terms)
                    all_docs.update(list(terms))
                else:
                    all_n.update({t: c * times for t, c in terms.items()})
                    all_docs.update(dict.fromkeys(terms, times))
            return sum(map(len, docs.values()))

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in docs.items():
                counts = n[lang, source]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                    pa.array([counts[t] for t in terms], pa.int64()), pa.array(list(terms.values()), pa.int64())], names=["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, key, body, sources, times in zip(*(batch.column(i).to_pylist() for i in (0, 1)), texts, *(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
                if (lang, key) != now:
                    if close() > HELD:
                        yield from out()
                    now, text, by_source = (lang, key), body.as_py(), Counter()
                by_source.update(dict(zip(sources, times, strict=True)))
        close()
        yield from out()

    return folded.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 kept)); null where nothing is kept."""
    wide = "decimal(38, 0)"
    return F.expr(f"case when {kept} > 0 then 1 + (cast({SCALE} as {wide}) * (cast({n} as {wide}) + 2)) div (cast({total} as {wide}) + 2 * cast({kept} as {wide})) end")


def _apart(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q))"""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank (module docstring)."""
    # one shuffle of the tasks' sums, which both the language's document counts and the rows of kept terms are read from:
    # both read every column, so that they are taken from the same exchange and no text is tokenized twice
    sums = _added_up(collapsed(only(docs, "lang", "source", "text"))).repartition("lang", "term")
    found = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.max(F.length("source")).alias("any")) \
        .where(((F.col("docs") >= MIN_DOCS) | (F.col("term") == "")) & F.col("any").isNotNull()).select("lang", "term", "lang_n")
    kept = materialize(sums.join(found.hint("shuffle_hash"), ["lang", "term"]).groupBy("lang", "term", "source")
                       .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max("lang_n").alias("lang_n")))
    posted = kept.where("term <> ''")
    zero = F.lit(0).cast("long")
    per_lang = posted.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    in_source = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = kept.where("term = ''").select("lang", "source").join(per_lang, "lang", "left").join(in_source, ["lang", "source"], "left") \
        .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("kept", "lang_total", "total", "own")))
    groups = materialize(groups.withColumn("p0", _share("0", "total", "kept")))
    shares = materialize(posted.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", _share("n", "total", "kept").alias("p"), _share("lang_n", "lang_total", "kept").alias("q")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value")) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)

    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "kept", F.col("own").alias("a_own"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = one.join(two, "lang").where("a <> b")  # the rows asked for
    # A(a, b): a's terms by their share, against the p0 of the others
    by_share = shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("source", "a").withColumnRenamed("p0", "a0")
    others = groups.select("lang", F.col("p0").alias("b0")).distinct()
    one_sided = by_share.join(others, "lang").groupBy("lang", "a", "b0").agg(F.sum(F.col("k") * (_apart("p", "b0") - _apart("a0", "b0"))).alias("a_sum"))
    # C(a, b): terms of both, each pair once
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(
        F.sum(_apart("pa", "pb") - _apart("pa", "b0") - _apart("a0", "pb") + _apart("a0", "b0")).alias("c_sum"))
    both = materialize(both)
    both = both.unionByName(both.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "c_sum"))
    other_sided = one_sided.select("lang", F.col("a").alias("b"), F.col("b0").alias("a0"), F.col("a_sum").alias("b_sum"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    valued = pairs.join(one_sided, ["lang", "a", "b0"], "left").join(other_sided, ["lang", "b", "a0"], "left").join(both, ["lang", "a", "b"], "left") \
        .select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.when(F.col("kept") > 0, F.col("kept") * _apart("a0", "b0")
                + F.coalesce("a_sum", zero) + F.coalesce("b_sum", zero) + F.coalesce("c_sum", zero)).otherwise(zero).alias("value")) \
        .withColumn("rank", F.row_number().over(order))
    return valued.unionByName(terms)


#: The same rows in SQL, with every term against every pair of sources.
ORACLE_SQL = """
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
              from documents),
kept as (select lang, term from (select lang, unnest(list_distinct(terms)) as term from docs) group by lang, term having count(*) >= 10),
words as (select lang, source, unnest(terms) as term from docs),
counts as (select w.lang, w.source, w.term, count(*)::hugeint as n from words w join kept k on k.lang = w.lang and k.term = w.term group by w.lang, w.source, w.term),
v as (select lang, count(*)::hugeint as v from kept group by lang),
groups as (select distinct lang, source from docs),
totals as (select g.lang, g.source, coalesce(v.v, 0) as v, (select coalesce(sum(n), 0) from counts c where c.lang = g.lang and c.source = g.source)::hugeint as total
           from groups g left join v on v.lang = g.lang),
shares as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.total + 2 * t.v) as p
           from totals t join kept k on k.lang = t.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
whole as (select s.lang, s.term, 1 + (1000000000 * (sum(s.n)::hugeint + 2)) // (any_value(x.total) + 2 * any_value(x.v)) as q
          from shares s join (select lang, sum(total)::hugeint as total, any_value(v) as v from totals group by lang) x on x.lang = s.lang group by s.lang, s.term),
pairs as (select a.lang, a.source, b.source as item from groups a join groups b on a.lang = b.lang and a.source <> b.source),
pair_values as (select p.lang, p.source, p.item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) as value
                from pairs p left join shares x on x.lang = p.lang and x.source = p.source left join shares y on y.lang = p.lang and y.source = p.item and y.term = x.term
                group by p.lang, p.source, p.item),
term_values as (select s.lang, s.source, s.term as item, ((s.p - w.q) * (s.p - w.q)) // (s.p + w.q) as value
                from shares s join whole w on w.lang = s.lang and w.term = s.term where s.n > 0 and s.p > w.q),
ranked as (select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair_values
           union all
           select lang, source, 'term', item, value::bigint, row_number() over (partition by lang, source order by value desc, item)::int from term_values)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
