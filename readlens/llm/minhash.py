"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature: a text's 3-word shingles are hashed into a universe of 2**22 places.  One permutation (sigma) breaks up the
hashes' structure, the other (pi) orders the places; the k-th coordinate of the signature is the least value of pi,
circularly shifted by k, over the text's places.  Shifting by k reads k places further, so all 160 coordinates of a
shingle are one contiguous slice of one table.

Banding: 32 bands of 5 coordinates.  Texts at similarity s share a band with probability 1 - (1 - s**5)**32; a link of
exactly 0.85 is missed with a chance of 7e-9, a closer one with less.  Shingles that meet in one place make
signatures more alike, never less, and what has met is verified.

Verification: equal shingle sets are one class from the start.  In a bucket of classes all are compared with one
pivot; members that are linked with it are one component, so a group of N near copies costs N comparisons, not N**2.
Where a bucket still holds several components, further pivots follow, and what ``PIVOT_ROUNDS`` of them leave is
compared in blocks: the members outside the component of the last pivot with all others, a bounded block of sets
at a time, and only links that join two components of the block leave the task.  No pair of texts that share a bucket
stays undecided unless they are connected already, so components are those of all links between texts that share one.  Comparisons use the full
shingle sets of the whole texts (64-bit hashes; N different shingles share one with a chance of N**2 / 2**65).

Buckets are counted before they are shuffled and joined with ordinary joins, which Spark splits where a bucket or a
class is large; nothing but scalars and one bit table of fixed size reaches the driver.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

Cases: null, empty and blank texts have no shingles and link with nothing; texts under three words are one shingle;
texts of any length are read whole, their shingles a few thousand at a time; repeated rows are reported row by row;
rows that share a doc_id are linked by their texts only; a null doc_id takes the component_id of its linked rows, or
null where none has an id, and is kept then; further columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlens.llm.common import U, broadcast_value, frees, materialize, maybe_in, membership, mix, only, stored
from readlens.llm.jaccard_join import class_of, components_sql, connected_components, shingle_sets

SHINGLE_WORDS, PERCENT = 3, 85
BANDS, ROWS = 32, 5
UNIVERSE_BITS = 22
#: Shingles whose coordinates are looked up at once.
STEP = 4096
PIVOT_ROUNDS = 3
#: Partners of a pivot in one group; members and shingles in one side of a block.
PARTNERS, BLOCK, BLOCK_SHINGLES = 1000, 256, 1 << 21

_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and all circular shifts of pi as a view: row p holds pi[p], pi[p + 1], ... for BANDS * ROWS shifts."""
    if not _TABLES:
        rng = np.random.Generator(np.random.PCG64(1))
        sigma, pi = (rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32) for _ in range(2))
        shifts = BANDS * ROWS
        _TABLES.extend((sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: shifts - 1]]), shifts)))
    return _TABLES[0], _TABLES[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS coordinates of a set of 64-bit shingle hashes (not empty)."""
    sigma, shifted = tables()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(shingles), STEP):
        places = sigma[(shingles[i: i + STEP] >> U(64 - UNIVERSE_BITS)).astype(np.int64)]
        np.minimum(least, shifted[places].min(axis=0), out=least)
    return least


def band_names(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name for each band."""
    parts = mix(least.reshape(BANDS, ROWS).astype(U) + (np.arange(BANDS * ROWS, dtype=U) << U(32)).reshape(BANDS, ROWS))
    return mix(parts.sum(axis=1, dtype=U)).astype(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, node, bands): hash of the text, size and class of its set, and its buckets, which only the first
    of the rows of a class in an Arrow batch carries."""

    @frees
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            sizes, nodes, bands = [], [], []
            for s in shingle_sets(batch.column(2), SHINGLE_WORDS):
                node = class_of(s) if len(s) else None
                sizes.append(len(s))
                nodes.append(node)
                new = node is not None and node not in seen
                bands.append(band_names(signature(s)) if new else None)
                seen.add(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                                              pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "node", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return stored(rows.mapInArrow(sign, "doc_id long, h long, n long, node long, bands array<long>"), "minhash-rows")


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, node, n): the members of all buckets of two or more classes; buckets with the same members appear once."""
    entries = rows.where("bands is not null").select(F.explode("bands").alias("bucket"), "node", "n")
    shared = entries.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = materialize(entries.join(shared, "bucket", "left_semi").groupBy("bucket", "node").agg(F.min("n").alias("n")))
    made_of = members.groupBy("bucket").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.count(F.lit(1)).alias("k"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    once = made_of.groupBy("x", "k", "lo", "hi").agg(F.min("bucket").alias("bucket")).select("bucket")
    return materialize(members.join(once, "bucket", "left_semi"))


def texts_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text of every class in ``nodes``."""
    holders = materialize(rows.where("node is not null").groupBy("node").agg(F.min("h").alias("h")).join(nodes, "node", "left_semi"))
    wanted = broadcast_value(docs.sparkSession, membership(holders, "h"))

    @frees
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each text in a batch that may be wanted."""
        for batch in batches:
            h = batch.column(0).to_numpy()
            _, first = np.unique(h, return_index=True)
            yield batch.take(pa.array(first[maybe_in(wanted.value, h[first])], pa.int64()))

    found = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text").mapInArrow(pick, "h long, text string")
    return stored(found.join(holders, "h").select("node", "text").dropDuplicates(["node"]), "minhash-texts")


def links_in(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between the two sides of the cells (cell, side, node), as many as connect what they connect.
    A task holds the sets of side 0 of one cell and reads side 1 past them."""
    placed = cells.join(texts, "node").select("cell", "side", "node", "text").repartition("cell").sortWithinPartitions("cell", "side", "node")

    @frees
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for cell, side, node, s in zip(*(batch.column(i).to_pylist() for i in range(3)), shingle_sets(batch.column(3), SHINGLE_WORDS), strict=True):
                if cell != now:
                    now, group = cell, _Side()
                if side == 0:
                    group.add(node, s)
                else:
                    found += group.links(node, s)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed.mapInArrow(compare, "a long, b long")


class _Side:
    """Some sets, kept as one sorted array of shingles with their owners, and what is connected so far."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.up: dict[int, int] = {}
        self.hashes = None

    def add(self, node: int, s: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(s)

    def _top(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def links(self, node: int, s: np.ndarray) -> list[tuple[int, int]]:
        if not self.nodes:
            return []
        if self.hashes is None:
            self.sizes = np.array([len(x) for x in self.sets])
            self.hashes = np.concatenate(self.sets)
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.owner = self.hashes[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            self.sets = []
        lo, hi = (np.searchsorted(self.hashes, s, side=side) for side in ("left", "right"))
        times = hi - lo
        at = np.repeat(hi - times.cumsum(), times) + np.arange(times.sum())
        both = np.bincount(self.owner[at], minlength=len(self.nodes))
        out = []
        for i in np.flatnonzero(both * 100 >= (self.sizes + len(s) - both) * PERCENT).tolist():
            x, y = self._top(self.nodes[i]), self._top(node)
            if x != y:
                self.up[x] = y
                out.append((self.nodes[i], node))
        return out


def _star_cells(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Cells of a pivot on side 0 and up to about PARTNERS members that may be linked with it on side 1."""
    fits = (F.col("n") * 100 >= F.col("pivot_n") * PERCENT) & (F.col("pivot_n") * 100 >= F.col("n") * PERCENT)
    pairs = materialize(members.join(pivots, "bucket").where((F.col("root") != F.col("pivot_root")) & fits).select("pivot", "node").distinct())
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    cell = F.xxhash64("pivot", "part").alias("cell")
    partners = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select(cell, F.lit(1).alias("side"), "node")
    own = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(cell, F.lit(0).alias("side"), F.col("pivot").alias("node"))
    return partners.unionByName(own)


def _block_cells(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Cells that bring each member outside the pivot's component (side 0) together with every other member (side 1)."""
    placed = members.join(pivots.select("bucket", "pivot_root"), "bucket").withColumn("minor", F.col("root") != F.col("pivot_root"))

    def parts(only_minor: bool) -> F.Column:
        rows = F.when(F.col("minor"), F.col("n")) if only_minor else F.col("n")
        return F.greatest(F.ceil(F.count(rows) / BLOCK), F.ceil(F.sum(rows) / BLOCK_SHINGLES))

    dealt = placed.groupBy("bucket").agg(parts(True).alias("minor_parts"), parts(False).alias("all_parts"))
    placed = placed.join(dealt, "bucket")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    cell = F.xxhash64("bucket", "i", "j").alias("cell")
    one = placed.where("minor").withColumn("i", own("minor_parts")).withColumn("j", to("all_parts")).select(cell, F.lit(0).alias("side"), "node")
    two = placed.withColumn("j", own("all_parts")).withColumn("i", to("minor_parts")).select(cell, F.lit(1).alias("side"), "node")
    return one.unionByName(two)


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): verified links that connect all classes that any links between members of a bucket connect."""
    members = buckets(rows)
    texts = texts_of(docs, rows, members.select("node").distinct())
    found, todo = None, members.withColumn("root", F.col("node"))
    for turn in range(PIVOT_ROUNDS):
        # another order of the members each time; the last pivots' components are what the blocks are laid out around
        rank = F.struct(F.xxhash64(F.lit(turn), "node").alias("order"), "node", "n", "root")
        pivots = todo.groupBy("bucket").agg(F.min(rank).alias("p")).select(
            "bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.root").alias("pivot_root"))
        fresh_links = materialize(links_in(_star_cells(todo, pivots), texts))
        found = fresh_links if found is None else found.unionByName(fresh_links)
        roots = connected_components(found)
        labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k")) \
            .where("lo <> hi and k > 2").select("bucket")  # two members have been compared
        todo = materialize(labelled.join(mixed, "bucket", "left_semi"))
        if todo.isEmpty():
            return found
    pivots = todo.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket") \
        .agg(F.max(F.struct("k", "root")).alias("p")).select("bucket", F.col("p.root").alias("pivot_root"))  # the largest component of each
    return found.unionByName(materialize(links_in(_block_cells(todo, pivots), texts)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (it is that one)."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = signed(docs)
    roots = connected_components(links(docs, rows))
    first = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")) \
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(per_root, "root").select("node", "component_id")
    with_set = rows.where("node is not null").join(named, "node").select("doc_id", "n", "component_id")
    empty = rows.where("node is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = components_sql(SHINGLE_WORDS, PERCENT, """
select d.doc_id, d.n as n_shingles, case when d.node is null then d.doc_id else c.component_id end as component_id,
       d.doc_id is not distinct from (case when d.node is null then d.doc_id else c.component_id end) as kept
from named d left join component c on c.node = d.node""")
