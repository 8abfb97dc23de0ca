"""Exact Jaccard join on 5-word shingles: regions around pivots, joined recursively.

Jaccard distance is a metric, but a sparse one: unrelated texts are at distance exactly 1 from each other, so
pivots drawn from the whole corpus would leave every text in every boundary window.  Regions are therefore laid
out where distances are below 1.  The cell of a shingle holds the texts that have it among their rarest
``n - ceil(0.8 n) + 1`` shingles; a text lies in several cells, and two texts with similarity of 0.8 or more
always share one (they lack at most a fifth of each other's shingles).  Where a member's shingle of the cell stands in its own order
bounds what it can share from there on, and so the sizes of possible partners.  Rarity only orders the shingles; it is
read from a table of fixed size that all texts are counted into, and any order gives the exact result.

A cell is then joined around pivots:

1. The member that occurs in most cells becomes the cell's pivot; distances of all members to it are exact.
   Everything within 0.2 of the pivot is one ball, already connected.
2. Members outside the ball are joined with each other and, through the triangle inequality, with the ball:
   a pair is only looked at if its two distances to the common pivot differ by at most 0.2 and its sizes allow
   0.8, and never if both are connected already.  The rest recurses around the next pivots, and what is still
   unconnected after ``PIVOT_ROUNDS`` rounds is compared within those windows: pair by pair in small cells, block
   by block in large ones, where a pair never becomes a row.

Those links connect all that any links connect.  Every link lies within a component, so a second pass finds all of
them: members of a component are dealt to blocks by set size, and blocks whose sizes allow 0.8 are compared with each
other, members by members, in one task each; only links leave it (``linked_pairs``), or only how many each member
has (``components``).

Equal shingle sets are one class from the start, known by a 64-bit hash of the set (among N different sets
about N**2 / 2**65 pairs share one by chance), and never meet as pairs.  Classes, cells, pairs, links and
components stay distributed; the driver sees scalars and two arrays of fixed size.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

Cases: null, empty and blank texts have no shingles and link with nothing; texts under five words are one
shingle; texts of any length are read whole; repeated rows are reported row by row; rows that share a doc_id are linked
by their texts only; a null doc_id gets a null component_id unless a linked row has one; further columns are ignored;
an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlens.llm.common import (SPACE_SEPARATED, Words, broadcast_value, fixed_size_sum, frees, fresh, materialize, maybe_in, membership, mix,
                                  only, packed_slices, row_slices, stored, string_batch, within)

SHINGLE_WORDS, PERCENT = 5, 80
#: Counters of the rarity table, in this many slices.
RARITY_CELLS, SLICES = 1 << 22, 64
#: Cells of at most this many members are known by their members, so that equal cells are joined once.
SMALL_CELL = 64
PIVOT_ROUNDS = 1
#: Rows of cells, links and labels in one partition; their tables are far smaller than the texts.
PART_ROWS = 200_000
#: Partners compared with a text in one group.
PARTNERS = 1000
#: Members of a component in one block.
BLOCK = 256
#: Sizes of linked sets differ by a factor of 1.25 at most: the same or the next step of this one.
SIZE_STEP = 1.26


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = string_batch(texts)
    for i, j in row_slices(offsets):
        lo = offsets[i]
        w = Words(data[lo: offsets[j]], offsets[i: j + 1] - lo, SPACE_SEPARATED)
        grams = w.grams(k)
        for r in range(j - i):
            yield w.shingle_set(r, k, grams)


def class_of(s: np.ndarray) -> int:
    """64-bit hash of a set."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 & (2**64 - 1))]))[0].astype(np.int64))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, node): hash of the text, set size and class of every document; node is null for empty sets."""

    @frees
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), class_of(s) if len(s) else None) for s in shingle_sets(batch.column(2))]
            n, node = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "h": batch.column(1), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64())})

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(sets, "doc_id long, h long, n long, node long")


def rarity(docs: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each hash class (``RARITY_CELLS`` saturating counters)."""

    @frees
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_CELLS, dtype=np.uint32)
        for batch in batches:
            for s in shingle_sets(batch.column(1)):
                np.add.at(total, (s & np.uint64(RARITY_CELLS - 1)).astype(np.int64), 1)
        yield packed_slices(total, SLICES)

    return fixed_size_sum(docs.mapInArrow(count, "slice int, packed binary"), np.uint32, SLICES)


def cells(docs: DataFrame) -> DataFrame:
    """(cell, node, n): the members of every cell of two or more classes; equal small cells appear once."""
    counts = broadcast_value(docs.sparkSession, rarity(docs))

    @frees
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, nodes, sizes, caps, seen = [], [], [], [], set()
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                node = class_of(s) if n else None
                if not n or node in seen:
                    continue
                seen.add(node)
                often = counts.value[(s & np.uint64(RARITY_CELLS - 1)).astype(np.int64)]
                size = n - (-(-PERCENT * n // 100)) + 1
                order = np.lexsort((s, often))[:size]
                cap = (((100 + PERCENT) * (n - np.arange(size)) - PERCENT * n) // PERCENT).astype(np.int32)
                shingles.append(s[order])
                nodes.append(np.full(len(order), node, dtype=np.int64))
                sizes.append(np.full(len(order), n, dtype=np.int32))
                caps.append(cap)
            if shingles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).astype(np.int64)), *(
                    pa.array(np.concatenate(x)) for x in (nodes, sizes, caps))], names=["cell", "node", "n", "cap"])

    @frees
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (cell, node).  Holds back the last, perhaps unfinished cell while it is small;
        a larger one passes through under its shingle."""
        rest = None
        streaming = None  # the shingle of a cell that passes through
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            cell, node = rows[:2]
            new = np.ones(len(cell), dtype=bool)
            new[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
            rows = [x[new] for x in rows]
            cell = rows[0]
            keep = len(cell) - int(np.searchsorted(cell, cell[-1], side="left"))
            last_large = keep > SMALL_CELL or streaming == cell[-1]
            stop = len(cell) if last_large else len(cell) - keep
            out = _cells_of([x[:stop] for x in rows], streaming)
            if out is not None:
                yield out
            streaming = int(cell[-1]) if last_large else None
            rest = [x[-1:] if last_large else x[stop:] for x in rows]
        if rest is not None and streaming is None:
            out = _cells_of(rest, None)
            if out is not None:
                yield out

    schema = "cell long, node long, n int, cap int"
    entries = docs.mapInArrow(prefixes, schema)
    met = entries.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(meet, schema)
    return met.groupBy("cell", "node").agg(F.first("n").alias("n"), F.max("cap").alias("cap"))


def _cells_of(rows: list[np.ndarray], streaming: int | None) -> pa.RecordBatch | None:
    """The members of whole cells that have a possible partner in them; all members of cells that pass through."""
    cell, node, n, cap = rows
    if not len(cell):
        return None
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(first, len(cell)))
    passing = size > SMALL_CELL
    passing[0] |= streaming is not None and cell[0] == streaming
    keep = np.repeat(passing, size)
    two = first[(size == 2) & ~passing]
    fits = (n[two] <= cap[two + 1]) & (n[two + 1] <= cap[two])
    keep[two[fits]] = keep[two[fits] + 1] = True
    for a, k in zip(first[(size > 2) & ~passing].tolist(), size[(size > 2) & ~passing].tolist(), strict=True):
        fit = n[a: a + k, None] <= cap[None, a: a + k]
        fit &= fit.T
        np.fill_diagonal(fit, False)
        keep[a: a + k] = fit.any(axis=1)
    if not keep.any():
        return None
    sums = np.add.reduceat(np.where(keep, mix(node.astype(np.uint64)), np.uint64(0)), first)
    name = np.repeat(np.where(passing, cell[first], mix(sums).astype(np.int64)), size)
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (name, node, n, cap)], names=["cell", "node", "n", "cap"])


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text of every class in ``nodes``."""

    wanted = broadcast_value(docs.sparkSession, membership(nodes, "node"))

    @frees
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = {class_of(s): r for r, s in reversed(list(enumerate(shingle_sets(batch.column(1))))) if len(s)}
            found = np.array(list(first), dtype=np.int64)
            found = found[maybe_in(wanted.value, found)]
            rows = pa.array([first[int(x)] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(1).take(rows)], names=["node", "text"])

    found = docs.mapInArrow(pick, "node long, text string")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total): exact intersection and union sizes of the pairs' sets.

    A task holds the set of one b and reads its partners past it; a b with many partners is dealt, with its text,
    over several groups."""
    pairs = materialize(pairs)
    pairs = pairs.coalesce(_parts(pairs.count()))
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("long").alias("groups"))
    partners = pairs.join(groups, "b").select("b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("part"), F.col("a").alias("node"))
    own = groups.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.col("b").alias("node"))
    rows = partners.withColumn("partner", F.lit(True)).unionByName(own.withColumn("partner", F.lit(False)))
    few = within(texts, "node", membership(rows, "node"))
    placed = rows.join(few, "node").repartition("b", "part").sortWithinPartitions("b", "part", "partner")

    @frees
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out = []
            for b, node, partner, s in zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(batch.column(3)), strict=True):
                if not partner:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                out.append((node, b, both, len(own) + len(s) - both))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "shared", "total"])

    return placed.select("b", "node", "partner", "text").mapInArrow(compare, "a long, b long, shared long, total long")


def _parts(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b) but the roots, the least of each component: large-star and
    small-star steps until nothing changes."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
        """Each node's neighbours (large: those above it; small: those below and itself) move to its least neighbour.
        ``few``: rows in one partition, which stay there; the driver keeps a thread for each shuffle of the last minute."""
        other = F.struct(F.col("b" if large else "a").alias("a"), F.col("a").alias("b"))
        around = pairs.select(F.inline(F.array(F.struct("a", "b"), other)))
        if few:
            moved = around.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
        else:
            moved = around.join(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
        return moved.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    mark = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if now == mark or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, parts = now, _parts(now[0])
        e = materialize(star(star(e.coalesce(parts), True, parts == 1).coalesce(parts), False, parts == 1).coalesce(parts))


def _labelled(region: DataFrame, roots: DataFrame) -> DataFrame:
    """Regions with each member's component so far, without the regions that are connected throughout."""
    out = region.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = out.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cell")
    return out.join(mixed, "cell", "left_semi")


def _may_link(n: str, cap: str, other_n: str, other_cap: str) -> Column:
    """Whether two members of a cell can share enough: ``cap`` is the largest partner that a member with its shingle
    of this cell as the first common one can have."""
    return (F.col(other_n) <= F.col(cap)) & (F.col(n) <= F.col(other_cap))


def _with_partners(region: DataFrame) -> DataFrame:
    """The members that some size in their cell suits."""
    fit = region.groupBy("cell").agg(F.min("n").alias("least"), F.max("cap").alias("most"), F.count(F.lit(1)).alias("members"))
    return region.join(fit, "cell").where("members > 1 and cap >= least and n <= most").select("cell", "node", "n", "cap")


def _connecting(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, root) of the classes that links connect with a lesser one, as ``connected_components`` gives them; (node, n)
    and (node, text) of all classes that may have links."""
    region = materialize(_with_partners(_with_partners(cells(docs))))
    region = region.coalesce(parts := _parts(region.count()))
    degree = region.groupBy("node").agg(F.count(F.lit(1)).alias("cells"))
    region = materialize(region.join(degree, "node").coalesce(parts))
    sizes = region.groupBy("node").agg(F.first("n").alias("n"))
    texts = stored(texts_of(docs, degree.select("node")), "jaccard-texts")
    roots, measured, todo = None, None, region.withColumn("root", F.col("node"))
    for turn in range(PIVOT_ROUNDS):
        rank = F.struct("cells", "node", "n", "cap", "root")
        # the next pivot: a member that hasn't been one
        free = todo.join(measured.select(F.col("b").alias("node")).distinct(), "node", "left_anti") if turn else todo
        pivots = free.groupBy("cell").agg(F.max(rank).alias("p")).select("cell", F.col("p.node").alias("b"), F.col("p.n").alias("nb"),
                                                                         F.col("p.cap").alias("cap_b"), F.col("p.root").alias("pivot_root"))
        pairs = todo.join(pivots, "cell").where((F.col("root") != F.col("pivot_root")) & _may_link("n", "cap", "nb", "cap_b")) \
            .select(F.col("node").alias("a"), "b").distinct()
        if turn:
            pairs = _unmeasured(pairs, measured)
        found = materialize(linked(pairs, texts)).coalesce(parts)
        measured = measured.unionByName(found) if turn else found
        roots = _joined(roots, found.where(F.col("shared") * 100 >= F.col("total") * PERCENT).select("a", "b"))
        todo = materialize(_labelled(region, roots)).coalesce(parts)
        if todo.isEmpty():
            return roots, sizes, texts
    return _joined(roots, materialize(_rest(todo, measured, texts)).coalesce(parts)), sizes, texts


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of what ``roots`` (node, root) connects already and further links (a, b)."""
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return connected_components(links)


def _blocks(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The members (node, n) of each ``root`` with their texts, block beside block where sizes allow a link."""
    nodes = nodes.withColumn("step", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))))
    parts = nodes.groupBy("root", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    placed = nodes.join(parts, ["root", "step"]).select("root", "node", F.struct("step", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).alias("own"))
    near = parts.select("root", F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))).alias("beside"), F.col("step").alias("other_step"), "parts")
    met = placed.withColumn("beside", F.col("own.step")).join(near, ["root", "beside"]) \
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    other = F.struct(F.col("other_step").alias("step"), F.col("part"))
    rows = met.select("root", F.least("own", other).alias("lo"), F.greatest("own", other).alias("hi"), "node", "own") \
        .select("root", "lo", "hi", (F.col("own") == F.col("lo")).alias("first"), "node", (F.col("lo") == F.col("hi")).alias("within"))
    return _side_by_side(rows, texts)


def _side_by_side(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of each block (root, lo, hi) one after the other, with their texts, as ``_compared`` reads them."""
    rows = rows.withColumn("block", F.xxhash64("root", "lo", "hi")).join(texts, "node") \
        .repartition("block").sortWithinPartitions("block", "root", "lo", "hi", "first", "node")
    keys = [F.col("root"), *(F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in ("lo", "hi") for y in ("step", "part"))]
    return rows.select(*keys, "first", "node", "within", "text")


def _component_blocks(roots: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    return _blocks(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(sizes, "node"), texts)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The links of each block: its rows come one after the other, and its sets are held until it ends."""
    key, held = None, []
    for batch in batches:
        firsts, nodes, withins = (batch.column(i).to_pylist() for i in (5, 6, 7))
        for *now, first, node, within, s in zip(*(batch.column(i).to_pylist() for i in range(5)), firsts, nodes, withins, shingle_sets(batch.column(8)), strict=True):
            if now != key:
                yield _links_of(held)
                key, held = now, []
            held.append((first, node, within, s))
    yield _links_of(held)


@frees
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _compared(batches):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "shared", "total"])


LINKS = "a long, b long, shared long, total long"


def _all_links(roots: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total): every link once, a < b."""
    return _component_blocks(roots, sizes, texts).mapInArrow(_links, LINKS)


def _link_counts(roots: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n_links): how many links each class has, added up where they are found: no link leaves a task."""

    @frees
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _compared(batches):
            if found:
                node, k = np.unique(np.concatenate([x for a, b, *_ in found for x in (a, b)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(k, pa.int64())], names=["node", "n_links"])

    return _component_blocks(roots, sizes, texts).mapInArrow(counts, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _links_of(rows: list[tuple[bool, int, bool, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """Links within a block, or between the rows of one and of another."""
    within = bool(rows) and rows[0][2]
    one = rows if within else [r for r in rows if r[0]]
    two = rows if within else [r for r in rows if not r[0]]
    if len(one) < 1 + within or not two:
        return []
    _, ids = np.unique(np.concatenate([r[3] for r in (one if within else one + two)]), return_inverse=True)
    size = np.array([len(r[3]) for r in two])
    nodes = np.array([r[1] for r in two], dtype=np.int64)
    ends = np.cumsum([len(r[3]) for r in one])
    partners = ids if within else ids[ends[-1]:]
    start = np.cumsum(size) - size
    mark, out = np.zeros(ids.max() + 1, dtype=bool), []
    for i, (_, node, _, s) in enumerate(one):
        skip = i + 1 if within else 0
        if skip == len(two):
            break
        mine = ids[ends[i] - len(s): ends[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[partners[start[skip]:]], start[skip:] - start[skip], dtype=np.int64)
        mark[mine] = False
        total = len(s) + size[skip:] - both
        found = np.flatnonzero(both * 100 >= total * PERCENT)
        if len(found):
            to = nodes[skip:][found]
            out.append((np.minimum(to, node), np.maximum(to, node), both[found], total[found]))
    return out


def links_between(docs: DataFrame) -> DataFrame:
    """(a, b, shared, total): all links between classes, a < b, with the sizes of intersection and union."""
    return _all_links(*_connecting(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")))


def linked_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, similarity): all links between different texts; each text stands under its smallest doc_id."""
    rows = members(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    first = materialize(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    return links_between(docs).join(first.select(F.col("node").alias("a"), F.col("doc_id").alias("of_a")), "a") \
        .join(first.select(F.col("node").alias("b"), F.col("doc_id").alias("of_b")), "b") \
        .select(F.least("of_a", "of_b").alias("doc_a"), F.greatest("of_a", "of_b").alias("doc_b"), (F.col("shared") / F.col("total")).alias("similarity"))


def _unmeasured(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    done = measured.select("a", "b").unionByName(measured.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(done, ["a", "b"], "left_anti")


def _rest(todo: DataFrame, measured: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of a region in different components.  A pair of members is a row in small regions only.  The
    members of a component that has many in a region are dealt to blocks, once for all regions, and those that may
    link with one of them go to these blocks; the other members of large regions are compared block by block."""
    groups = todo.groupBy("cell", "root").agg(F.min("n").alias("least"), F.max("cap").alias("most"), F.count(F.lit(1)).alias("k"))
    groups = materialize(groups.withColumn("large", F.col("k") > BLOCK))
    large, small = groups.where("large"), groups.where("not large")
    crowded = small.groupBy("cell").agg(F.sum("k").alias("members")).select("cell", (F.col("members") > SMALL_CELL).alias("crowded"))
    others = todo.join(small.select("cell", "root"), ["cell", "root"], "left_semi").join(crowded, "cell")
    few, many = others.where("not crowded"), others.where("crowded")
    blocks = _blocks(many.select(F.col("cell").alias("root"), "node", "n"), texts).unionByName(_visits(todo, groups, texts)).mapInArrow(_links, LINKS)
    return _few_links(few, measured, texts).unionByName(blocks.select("a", "b"))


def _visits(todo: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The members of large components, in blocks, beside blocks of the others that share a region with them and whose
    size suits; of two large components, the members of the lesser go to the other."""
    large = groups.where("large")
    own = todo.join(large.select("cell", "root"), ["cell", "root"], "left_semi").select("root", "node").distinct()
    spans = large.select("cell", F.col("root").alias("to"), "least", "most")
    apart = (F.col("root") < F.col("to")) | (~F.col("large") & (F.col("root") != F.col("to")))
    meet = todo.join(groups.select("cell", "root", "large"), ["cell", "root"]).join(spans, "cell").where(apart & _may_link("n", "cap", "least", "most")) \
        .select(F.col("to").alias("root"), "node").distinct()

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias(name))

    both = parts(own, "lo").join(parts(meet, "hi"), "root")
    step = F.lit(0).cast("long")

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in one block of its side, before all blocks of the other."""
        return rows.join(both, "root").select("root", "node", F.pmod(F.xxhash64("node"), F.col(mine)).alias(f"{mine}_part"),
                                              F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"{other}_part"))

    rows = [dealt(own, "lo", "hi").withColumn("first", F.lit(True)), dealt(meet, "hi", "lo").withColumn("first", F.lit(False))]
    return _side_by_side(rows[0].unionByName(rows[1]).select(
        "root", F.struct(step.alias("step"), F.col("lo_part").alias("part")).alias("lo"), F.struct((step + 1).alias("step"), F.col("hi_part").alias("part")).alias("hi"),
        "first", "node", F.lit(False).alias("within")), texts)


def _few_links(todo: DataFrame, measured: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of small regions in different components, pair by pair within the windows."""
    one = todo.select("cell", F.col("node").alias("a"), F.col("n").alias("na"), F.col("cap").alias("cap_a"), F.col("root").alias("ra"))
    other = todo.select("cell", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cap").alias("cap_b"), "root")
    pairs = one.join(other, "cell").where((F.col("root") > F.col("ra")) & _may_link("na", "cap_a", "nb", "cap_b")).select("a", "b").distinct()
    pairs = _unmeasured(pairs, measured)
    # triangle inequality: distances to a common pivot may differ by at most 0.2
    far = (F.lit(1.0) - F.col("shared") / F.col("total"))
    to_pivot = measured.select(F.col("a").alias("x"), F.col("b").alias("pivot"), far.alias("d"))
    window = pairs.join(to_pivot.select(F.col("x").alias("a"), "pivot", F.col("d").alias("da")), "a") \
        .join(to_pivot.select(F.col("x").alias("b"), "pivot", F.col("d").alias("db")), ["b", "pivot"]) \
        .where(F.abs(F.col("da") - F.col("db")) > (100 - PERCENT) / 100 + 1e-9).select("a", "b").distinct()
    left = pairs.join(window, ["a", "b"], "left_anti")
    return linked(left, texts).where(F.col("shared") * 100 >= F.col("total") * PERCENT).select("a", "b")


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of every class, the classes without links included."""
    classes = rows.where("node is not null").select("node").distinct()
    return classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links (different texts
    that its text is linked with)."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(members(docs))
    roots, sizes, texts = _connecting(docs)
    first = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(_named(rows, roots), "node")
    per_root = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(per_root, "root").select("node", "component_id").join(_link_counts(roots, sizes, texts), "node", "left")
    with_set = rows.where("node is not null").join(named, "node").select("doc_id", "n", "component_id", "n_links")
    empty = rows.where("node is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("n_links"))
    return with_set.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each group of linked or equal texts: the one with the smallest doc_id, null
    ids last; of several rows with this id the one with the smallest hash of its text, then the smallest other
    columns.  Rows without words are linked with nothing and all stay."""
    id_, null_, hash_ = (fresh(docs, n) for n in ("first_id", "first_null", "first_hash"))
    plain = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(members(plain))
    roots, _, _ = _connecting(plain)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h"))
    named = rows.where("node is not null").groupBy("node").agg(one.alias("one")).join(_named(rows, roots), "node")
    kept = named.groupBy("root").agg(F.min("one").alias("one")).select(
        F.coalesce("one.doc_id", F.lit(0).cast("long")).alias(id_), F.col("one.null_id").alias(null_), F.col("one.h").alias(hash_))
    wordless = docs["text"].isNull() | ~docs["text"].rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(~wordless).withColumns({id_: F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), null_: docs["doc_id"].isNull(), hash_: F.xxhash64(docs["text"])})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows_kept = keyed.join(kept, [id_, null_, hash_], "left_semi").groupBy(id_, null_, hash_).agg(F.min(F.struct(*columns)).alias(id_ + "_row")) \
        .select(*[F.col(f"`{id_}_row`.`{c}`").alias(c) for c in docs.columns])
    return rows_kept.unionByName(docs.where(wordless))


def components_sql(k: int, percent: int, result: str) -> str:
    """Shingle sets, links and components in DuckDB SQL, by joining all shingles; ``result`` selects from named (doc_id, n,
    node), component (node, component_id) and links (a, b).  For small tables: a component is closed pair by pair."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive words as (select row_number() over () as r, doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select r, doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')]
                else list_distinct(list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) end as s from words),
named as (select r, doc_id, len(s) as n, case when len(s) > 0 then sha256(array_to_string(list_sort(s), chr(10))) end as node, s from sets),
classes as (select node, any_value(n) as n, any_value(s) as s from named where node is not null group by node),
shingles as (select node, n, unnest(s) as shingle from classes),
links as (select a.node as a, b.node as b from shingles a join shingles b
            on a.shingle = b.shingle and a.node <> b.node and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
          group by a.node, b.node, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach as (select node as a, node as b from classes union select r.a, l.b from reach r join links l on l.a = r.b),
component as (select r.a as node, min(d.doc_id) as component_id from reach r join named d on d.node = r.b group by r.a)
{result}"""


ORACLE_SQL = components_sql(SHINGLE_WORDS, PERCENT, """
select d.doc_id, d.n as n_shingles, case when d.node is null then d.doc_id else c.component_id end as component_id, coalesce(l.n_links, 0) as n_links
from named d left join component c on c.node = d.node left join (select a, count(*) as n_links from links group by a) l on l.a = d.node""")
