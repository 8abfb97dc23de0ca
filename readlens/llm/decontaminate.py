"""Benchmark decontamination by a broadcast hash set of test n-grams.

Every run of 10 words of a test item is a window (an item of fewer words is one window as a whole).
Each task rolls over the words of its training texts, looks the 64-bit window hashes up in the
broadcast set, compares the words themselves for every match, and marks the words inside.  Nothing
is shuffled.  The set is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows: a larger test
collection is scanned block after block, the marks so far being kept with the documents.

Words: ASCII lower-cased runs of letters, digits and non-ASCII characters.

Cases: null and empty texts have no words and are clean; a null test text or one without words has no
window; a null item_id's windows still hit, but the item can't be named; repeated rows are reported
row by row; texts of any length are scanned whole, about a megabyte of texts at a time; an empty benchmark leaves all documents clean; further columns are kept as they are."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlens.llm.common import ALNUM_WORDS, Words, broadcast_value, frees, fresh, materialize, only, row_slices, string_batch

WINDOW_WORDS = 10
#: Windows in one broadcast block (hash, words and item: about 150 bytes each).
BLOCK_WINDOWS = 400_000
_FILTER_BITS = 22

MARKS = "struct<n_words: long, runs: array<long>, spans: array<struct<start: long, stop: long>>, items: array<string>>"


def benchmark_windows(benchmark: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (h, n, words, item_id) of all test items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            data, offsets = string_batch(batch.column(1))
            w = Words(data, offsets, ALNUM_WORDS)
            rows = []
            for i, item in enumerate(items):
                a, b = int(w.first[i]), int(w.first[i + 1])
                n = min(words, b - a)
                for at in range(a, b - n + 1) if n else ():
                    rows.append((int(w.sequence(at, at + n).astype(np.int64)), n, w.text(at, at + n), item))
            h, n, text, item = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "n": pa.array(n, pa.int32()),
                                              "words": pa.array(text, pa.binary()), "item_id": pa.array(item, pa.string())})

    picked = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text")
    return picked.mapInArrow(cut, "h long, n int, words binary, item_id string").distinct()


def _blocks(windows: DataFrame, limit: int) -> Iterator[dict]:
    """The windows in driver-sized blocks, split by hash: {n: (hashes, filter)}, {hash: [(words, items)]}."""
    windows = materialize(windows)
    total = windows.count()
    parts = max(1, -(-total // max(1, limit // 2)))
    for part in range(parts):
        mine = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == part)
        by_hash: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        lengths: dict[int, set[int]] = defaultdict(set)
        for r in mine.toLocalIterator():
            key = int(np.int64(r["h"]).astype(np.uint64))
            by_hash[key][bytes(r["words"])].add(r["item_id"])
            lengths[r["n"]].add(key)
        tables = {}
        for n, keys in sorted(lengths.items()):
            hashes = np.array(sorted(keys), dtype=np.uint64)
            maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
            maybe[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            tables[n] = (hashes, maybe)
        yield {"tables": tables, "words": {k: [(t, sorted(x for x in s if x is not None)) for t, s in v.items()]
                                           for k, v in by_hash.items()}}


def _scan(block, old_runs: list, old_items: list, texts: pa.Array) -> pa.StructArray:
    """The marks of a batch of texts, joined with those of earlier blocks."""
    data, offsets = string_batch(texts)
    n_words, runs, spans, items = [], [], [], []
    for i, j in row_slices(offsets):
        lo = offsets[i]
        w = Words(data[lo: offsets[j]], offsets[i: j + 1] - lo, ALNUM_WORDS)
        hit: dict[int, list[tuple[int, int]]] = defaultdict(list)
        named: dict[int, set] = defaultdict(set)
        for n, (hashes, maybe) in block["tables"].items():
            g = w.grams(n)
            at = np.flatnonzero(maybe[g >> np.uint64(64 - _FILTER_BITS)])
            if not len(at):
                continue
            found = np.searchsorted(hashes, g[at])
            at = at[hashes[np.minimum(found, len(hashes) - 1)] == g[at]]
            doc = np.searchsorted(w.first, at, side="right") - 1
            inside = at + n <= w.first[doc + 1]
            for a, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                text = w.text(a, a + n)
                for words, owners in block["words"][int(g[a])]:
                    if words == text:
                        hit[d].append((a, a + n))
                        named[d].update(owners)
        for k in range(j - i):
            first = int(w.first[k])
            n_words.append(int(w.first[k + 1]) - first)
            before = [(first + a, first + b) for a, b in zip(*[iter(old_runs[i + k] or [])] * 2, strict=True)]
            merged: list[list[int]] = []
            for a, b in sorted(before + hit.get(k, [])):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            runs.append([x - first for m in merged for x in m])
            items.append(sorted({*(old_items[i + k] or []), *named.get(k, ())}))
            spans.append([])
            if merged:
                begin, raw = int(w.starts[merged[0][0]]), offsets[i + k] - lo
                points = np.cumsum((w.data[raw: int(w.ends[merged[-1][1] - 1])] & 0xC0) != 0x80)
                spans[-1] = [{"start": int(points[w.starts[a] - raw]) - 1, "stop": int(points[w.ends[b - 1] - 1 - raw])}
                             for a, b in merged]
                assert begin >= raw
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
         pa.array(items, pa.list_(pa.string()))], names=["n_words", "runs", "spans", "items"])


def mark_benchmark_words(docs: DataFrame, benchmark: DataFrame, column: str = "hits", words: int = WINDOW_WORDS,
                         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` (a ``text`` column and any others) with a struct column of marks: n_words; runs, the hit words
    as flat [first, after-last) word positions; spans, the same as code point ranges; items, the item_ids
    with occurring windows in string order."""
    spark = docs.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.withColumn(column, F.lit(None).cast(MARKS))
    later = False
    for block in _blocks(benchmark_windows(benchmark, words), block_windows):
        shared = broadcast_value(spark, block)

        @frees
        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(column)
                old = batch.column(at)
                marks = _scan(shared.value, old.field("runs").to_pylist(), old.field("items").to_pylist(),
                              batch.column(batch.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], marks], names=batch.schema.names)

        if later:
            marked = materialize(marked)  # one block's set at a time in memory
        marked = marked.mapInArrow(scan, f"{schema}, `{column}` {MARKS}")
        later = True
    return marked


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", words: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without benchmark text, same columns.  ``document`` drops every document with a hit word;
    ``span`` cuts the hit spans out of the text (and corrects ``n_chars`` where there is one)."""
    column = fresh(docs, "hits")
    marked = mark_benchmark_words(docs, benchmark, column, words)
    if mode == "document":
        return marked.where(F.size(f"{column}.runs") == 0).drop(column)
    if mode != "span":
        raise ValueError(f"unknown mode {mode!r}")
    # what is kept: from each span's stop to the next one's start, in code points
    spans = F.col(f"{column}.spans")
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))), spans)
    kept = F.transform(edges, lambda x, i: F.substring(
        F.col("text"), (x["stop"] + 1).cast("int"),
        (F.coalesce(F.get(spans, i)["start"], F.char_length("text").cast("long")) - x["stop"]).cast("int")))
    text = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = mark_benchmark_words(only(docs, "doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits.runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                        lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    return m.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
                    F.size("hits.items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w"
#: ``report`` in DuckDB SQL: every window of each document joined with the items' windows.
ORACLE_SQL = f"""
with items as (select item_id, {_WORDS} from benchmark),
windows as (select distinct item_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < {WINDOW_WORDS} then [array_to_string(w, ' ')]
                   else list_transform(generate_series(1, len(w) - {WINDOW_WORDS - 1}), lambda i: array_to_string(w[i:i + {WINDOW_WORDS - 1}], ' ')) end) as words from items),
sizes as (select distinct len(string_split(words, ' ')) as n from windows),
docs as (select row_number() over () as r, doc_id, {_WORDS} from documents),
places as (select r, n, unnest(generate_series(1, len(w) - n + 1)) as pos from docs, sizes where len(w) >= n),
found as (select p.r, p.pos, p.n, x.item_id from places p join docs d on d.r = p.r join windows x on x.words = array_to_string(d.w[p.pos:p.pos + p.n - 1], ' ')),
hits as (select r, count(distinct pos + k) as n_hit from (select r, pos, unnest(generate_series(0, n - 1)) as k from found) group by r),
named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found where item_id is not null group by r)
select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items, sha256(coalesce(i.ids, '')) as items_sha256,
       coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hits h on h.r = d.r left join named i on i.r = d.r"""
