"""Prefix trie of conversations, built by the van Emde Boas recursion.

The sequences of turns are cut at half their depth, the prefixes before the cut are named, the trie above the cut and
the forests below it (one tree for each name) are built the same way at the same time, and the totals of the lower
trees are grafted upward.  All pieces of one depth of the recursion are one table, so a corpus whose longest
conversation has L turns takes about log2(L) steps each way, whatever the number of conversations:

1. ``_cuts``: pieces of 2**j turns, from the smallest up.  A piece knows the name of its upper half, by which it will
   be cut, and whether it has a lower half.
2. ``_trees``: from the whole sequences down, each piece is cut: its upper half stays in the tree of the piece, its
   lower half goes to the tree named after (tree, upper half).  Pieces of one turn are left, each with a name for the
   whole prefix before it; the node is named after (tree, turn).
3. Nodes are counted, and what a node adds to its ancestors stands once, in the row of its smallest member.
4. ``_grafted``: up the same cuts, the totals of a lower half are added to the upper half's rows, so that each row knows
   what lies below it on its own conversation; a node's subtree total is the sum over its members' rows.

Each table has one row for a piece of a conversation and is dealt by (conversation, piece), so neither a conversation
of very many turns nor a first turn that a third of all conversations share comes together in one task: nodes are
summed before they are shuffled.  Turn numbers come from a range partitioning with offsets, not from a window over a
whole conversation.  The ids for ``ends_sha256`` are joined to strings by ranges of 4,096 ids and read in their order;
memory is one such string.

Names are pairs of 64-bit hashes; N different prefixes share one with a chance of about N**2 / 2**129.

Cases: a null role or text is empty; a null turn comes first; rows with equal turns go by role and text, so repeated
rows are turns of their own and reruns agree; rows with a null conv_id belong to no conversation and are left out; a
text of any length is hashed whole, and only its hash goes on; a conversation without turns left belongs to the root
alone; further columns are ignored; an empty table has no nodes, not even a root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlens.llm.common import frees, materialize, only

#: Conversations c - c % GROUP .. c share a head; at most HEAD - 1 turns of it.
GROUP, HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: 2**CHUNK_BITS turns of a conversation have one key in the joins on conversations.
CHUNK_BITS = 12
#: Ranges of 2**ID_BITS ids are joined to one string.
ID_BITS = 12
ROOT = (0, 0)


def _name(*parts: str | Column) -> list[Column]:
    """The two hashes of a name."""
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, words): the turns in order, counted from 0, as names of (role, text) with the number of words."""
    turns = only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    # rows with equal beginnings of texts stay together, so the order below is that of whole texts
    dealt = turns.withColumn("begin", F.substring("text", 1, 32)).repartitionByRange("conv_id", "turn", "role", "begin") \
        .select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))
    t1, t2 = _name("role", "text")
    here = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    local = materialize(dealt.withColumn("k", F.row_number().over(here))
                        .select("conv_id", "part", "k", t1.alias("t1"), t2.alias("t2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows")) \
        .select("conv_id", "part", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("offset"))
    return local.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("offset") + F.col("k") - 1).alias("pos"), "t1", "t2", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, t1, t2, words), the turns after rebuilding, and (conv_id, turns), every conversation's length."""
    turns = materialize(numbered(conversations))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD)
    of_base = own.select(F.col("conv_id").alias("base"), F.least("own", F.lit(HEAD - 1)).alias("has"))
    convs = materialize(convs.join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
                        .select("conv_id", "base", "own", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")))
    heads = turns.where(F.col("pos") < HEAD - 1).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "head"), "base") \
        .where("pos < head").select("conv_id", "pos", "t1", "t2", "words")
    chunks = convs.select("conv_id", "h", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("own") - 1, CHUNK_BITS))).alias("chunk"))
    tails = turns.withColumn("chunk", F.shiftright("pos", CHUNK_BITS)).join(chunks, ["conv_id", "chunk"]).where("pos >= h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "t1", "t2", "words")
    return heads.unionByName(tails), convs.select("conv_id", "turns")


def _halves(column: str, alias: str, lower: bool) -> Column:
    return F.max(F.when(F.col("pos") % 2 == int(lower), F.col(column))).alias(alias)


def _cuts(turns: DataFrame, longest: int) -> list[DataFrame]:
    """(conv_id, pos, u1, u2, lower) for pieces of 2, 4, ... turns: the name of the upper half and whether there is a lower one."""
    out, pieces, size = [], turns.select("conv_id", "pos", F.col("t1").alias("n1"), F.col("t2").alias("n2")), 1
    while size < longest:
        halves = pieces.groupBy("conv_id", F.shiftright("pos", 1).alias("piece")) \
            .agg(*(_halves(n, f"{side}{k}", side == "l") for side in "ul" for k, n in ((1, "n1"), (2, "n2"))))
        n1, n2 = _name("u1", "u2", "l1", "l2")
        cut = materialize(halves.select("conv_id", F.col("piece").alias("pos"), "u1", "u2", F.col("l1").isNotNull().alias("lower"),
                                        n1.alias("n1"), n2.alias("n2")))
        out.append(cut.select("conv_id", "pos", "u1", "u2", "lower"))
        # a piece without a lower half is the last of its conversation: no later piece is cut by its name
        pieces, size = cut.select("conv_id", "pos", "n1", "n2"), size * 2
    return out


def _parted(pieces: DataFrame, upper: list[Column], lower: list[Column], names: list[str]) -> DataFrame:
    """Each piece's halves: (conv_id, pos, *names) with the given values for the upper and, if there is one, the lower half."""
    half = [F.struct((F.col("pos") * 2 + i).alias("pos"), *(c.alias(n) for c, n in zip(values, names, strict=True))) for i, values in enumerate((upper, lower))]
    return pieces.select("conv_id", F.explode(F.when(F.col("lower"), F.array(*half)).otherwise(F.array(half[0]))).alias("half")).select("conv_id", "half.*")


def _trees(turns: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    """(conv_id, pos, p1, p2): for each turn the name of the prefix before it, from the names of the cut prefixes."""
    if not cuts:
        return turns.select("conv_id", "pos", *(F.lit(x).cast("long").alias(n) for x, n in zip(ROOT, ("p1", "p2"), strict=True)))
    trees = None
    for cut in reversed(cuts):
        if trees is None:
            pieces = cut.select("*", *(F.lit(x).cast("long").alias(n) for x, n in zip(ROOT, ("p1", "p2"), strict=True)))
        else:
            pieces = trees.join(cut, ["conv_id", "pos"])
        trees = _parted(pieces, [F.col("p1"), F.col("p2")], _name("p1", "p2", "u1", "u2"), ["p1", "p2"])
    return trees


def _grafted(rows: DataFrame, cuts: int, values: list[str]) -> DataFrame:
    """``rows`` (conv_id, pos, *values, ...) with each value plus the values of all later turns of its conversation: the
    totals of lower halves are added to their upper halves, from the smallest pieces up, and handed down again."""
    totals, levels = rows.select("conv_id", "pos", *values), []
    for _ in range(cuts):
        both = totals.groupBy("conv_id", F.shiftright("pos", 1).alias("piece")).agg(
            *(F.sum(v).alias(v) for v in values), *(F.sum(F.when(F.col("pos") % 2 == 1, F.col(v))).alias(f"{v}_l") for v in values))
        both = materialize(both.withColumnRenamed("piece", "pos"))
        levels.append(both.select("conv_id", "pos", F.col(f"{values[0]}_l").isNotNull().alias("lower"), *(F.coalesce(f"{v}_l", F.lit(0).cast("long")).alias(f"{v}_l") for v in values)))
        totals = both.select("conv_id", "pos", *values)
    below = None
    for level in reversed(levels):
        pieces = level.select("*", *(F.lit(0).cast("long").alias(f"{v}_b") for v in values)) if below is None else below.join(level, ["conv_id", "pos"])
        below = _parted(pieces, [F.col(f"{v}_l") + F.col(f"{v}_b") for v in values], [F.col(f"{v}_b") for v in values], [f"{v}_b" for v in values])
    if below is None:
        return rows
    rest = [c for c in rows.columns if c not in ("conv_id", "pos", *values)]
    return rows.join(below, ["conv_id", "pos"]).select("conv_id", "pos", *((F.col(v) + F.col(f"{v}_b")).alias(v) for v in values), *rest)


def _hashed_ids(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): the hash of each node's ids in ascending order.  Ids of one range are joined in any task;
    the strings of a node then pass through one hash, one after the other."""
    joined = ends.groupBy("n1", "n2", F.shiftright("conv_id", ID_BITS).alias("range")) \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))  # 2**ID_BITS ids at most

    @frees
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["n1", "n2", "ends_sha256"])

        for batch in batches:
            done = []
            for n1, n2, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (n1, n2) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (n1, n2), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield batch_of(done)
        if now is not None:
            yield batch_of([(*now, state.hexdigest())])

    return joined.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "range").select("n1", "n2", "ids") \
        .mapInArrow(digest, "n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of any sequences: ``turns`` (conv_id, pos, t1, t2, words) with positions from 0 and names of
    turns, ``lengths`` (conv_id, turns) with a row for each sequence, the empty ones too.

    Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = materialize(turns), materialize(lengths)
    longest, least, convs = lengths.agg(F.max("turns"), F.min("conv_id"), F.count(F.lit(1))).first()
    longest = longest or 0
    cuts = _cuts(turns, longest)
    n1, n2 = _name("p1", "p2", "t1", "t2")
    paths = materialize(turns.join(_trees(turns, cuts), ["conv_id", "pos"])
                        .select("conv_id", "pos", "words", n1.alias("n1"), n2.alias("n2")))
    last = paths.join(lengths.select("conv_id", (F.col("turns") - 1).alias("pos")), ["conv_id", "pos"]).select("conv_id", "n1", "n2")
    ends = last.unionByName(lengths.where("turns = 0").select("conv_id", *(F.lit(x).cast("long").alias(n) for x, n in zip(ROOT, ("n1", "n2"), strict=True))))
    nodes = paths.groupBy("n1", "n2").agg(
        F.min("conv_id").alias("conv_id"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    # the parent: the node of the turn before, in the smallest member's row
    above = paths.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("n1").alias("p1"), F.col("n2").alias("p2"))
    nodes = materialize(nodes.join(above, ["conv_id", "pos"], "left"))
    children = nodes.where("pos > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # what a node itself adds to the totals stands in the row of its smallest member
    own = nodes.select("conv_id", "pos", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    rows = paths.select("conv_id", "pos", "n1", "n2").join(own, ["conv_id", "pos"], "left") \
        .select("conv_id", "pos", *(F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in ("n_leaves", "saved_tokens")), "n1", "n2")
    totals = _grafted(rows, len(cuts), ["n_leaves", "saved_tokens"]).groupBy("n1", "n2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # the root has no row among the nodes; its children find their parent's smallest member, that of all, here
    named = nodes.join(totals, ["n1", "n2"]).join(parents, ["p1", "p2"], "left") \
        .select("n1", "n2", "conv_id", (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == 0, F.lit(least)).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
                "n_convs", "n_children", "n_leaves", "saved_tokens")
    zero = F.lit(0).cast("long")
    root = nodes.agg(F.coalesce(F.sum((F.col("pos") == 0).cast("long")), zero).alias("n_children"),
                     F.greatest(F.coalesce(F.sum((F.col("n_children") == 0).cast("long")), zero), zero + 1).alias("n_leaves"),
                     F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), zero).alias("saved_tokens")).where(F.lit(convs > 0)) \
        .select(*(F.lit(x).cast("long").alias(n) for x, n in zip(ROOT, ("n1", "n2"), strict=True)), F.lit(least).cast("long").alias("conv_id"), zero.alias("depth"),
                F.lit(None).cast("long").alias("parent_conv_id"), F.lit(convs).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    return named.unionByName(root).join(_hashed_ids(ends), ["n1", "n2"], "left") \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row for each distinct prefix (module docstring)."""
    return trie(*rebuilt(conversations))


#: The same rows in SQL.  A prefix is the list of its turns' hashes; crc32 is folded bit by bit over the digits of an id.
ORACLE_SQL = """
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
         md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as turn_name,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words
  from conversations where conv_id is not null),
convs as (
  select conv_id, count(*) as own, conv_id - conv_id % 20 as base,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
                 lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 4 as h
  from turns group by conv_id),
lens as (select c.*, least(c.h, coalesce(b.own, 0)) as head from convs c left join convs b on b.conv_id = c.base),
rebuilt as (
  select c.conv_id, t.pos, t.turn_name, t.words from lens c join turns t on t.conv_id = c.base and t.pos < c.head
  union all
  select c.conv_id, t.pos - c.h + c.head, t.turn_name, t.words from lens c join turns t on t.conv_id = c.conv_id and t.pos >= c.h),
lengths as (select conv_id, head + greatest(own - h, 0) as n from lens),
paths as (
  select conv_id, pos + 1 as depth, words,
         md5(string_agg(turn_name, ',') over (partition by conv_id order by pos)) as node,
         md5(coalesce(string_agg(turn_name, ',') over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), '')) as parent
  from rebuilt
  union all select conv_id, 0, 0, md5(''), null from lengths),
nodes as (select node, min(conv_id) as conv_id, min(depth) as depth, any_value(parent) as parent, count(*) as n_convs, min(words) as words from paths group by node),
children as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
own as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c using (node)),
below as (
  select p.node, sum(coalesce((o.n_children = 0)::int, 0)) over later as n_leaves, sum(coalesce((o.n_convs - 1) * o.words, 0)) over later as saved_tokens
  from paths p left join own o on o.node = p.node and o.conv_id = p.conv_id
  window later as (partition by p.conv_id order by p.depth desc)),
totals as (select node, sum(n_leaves) as n_leaves, sum(saved_tokens) as saved_tokens from below group by node),
ends as (select p.node, sha256(string_agg(p.conv_id::varchar, ',' order by p.conv_id)) as ends_sha256 from paths p join lengths l on l.conv_id = p.conv_id and l.n = p.depth group by p.node)
select o.conv_id, o.depth::bigint as depth, u.conv_id as parent_conv_id, o.n_convs, o.n_children::bigint as n_children, t.n_leaves::bigint as n_leaves,
       t.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from own o left join own u on u.node = o.parent join totals t on t.node = o.node left join ends e on e.node = o.node
"""
