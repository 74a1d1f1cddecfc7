"""The trie of conversation prefixes: every distinct sequence of first turns, what it holds and what sharing it would save.

1. Turns become digests. A pass over each conversation's turns in order chains them, so that each prefix has a node id, and
   equal conversations become one with a count.
2. Prefixes are dealt by their first turn. A subtree of at most ``SUBTREE_ROWS`` turns belongs to one task; a larger one is
   dealt again by its next turn, and so on down. Counting each prefix's turns tells for all at once how far down that is.
3. Tasks build dictionaries of pointers (parent, turn) -> node, and walk them in postorder without recursion.
4. Prefixes that were dealt again, the *stems*, sum what lies below: each subtree stands for one conversation, whose
   prefixes are the stems over it. No subtree, stem or list of members is gathered in one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Turns of distinct conversations below a prefix that one task takes.
SUBTREE_ROWS = 20_000
#: Conversations borrow first turns from the first of each so many identifiers; at most so many turns.
FAMILY, BORROWED = 100, 6
#: Identifiers of one range that are joined to one string.
RANGE = 1 << 16
SALTS = 32
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, node binary, parent binary, chars long, last boolean"
_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, turn_digest, chars) of each turn, ``i`` from 1 in order of turn (nulls first; equal ones by role and
    text). Null role and text are empty; rows without conv_id belong to no conversation."""
    own = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    short = own.select("conv_id", F.unhex(F.substring(digest, 1, 32)).alias("turn_digest"), F.length("text").cast("long").alias("chars"), F.row_number().over(order).alias("i"))
    return short.select("conv_id", "i", "turn_digest", "chars")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """(conv_id, i, turn_digest, chars): each conversation with its family's first turns in place of its own first ones, as
    many as a hash of its identifier says; and a row 0 for each, so that those without turns stay."""
    known = numbered.filter("i = 1").select("conv_id", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(BORROWED)).alias("h"))
    heads = numbered.filter(f"i < {BORROWED} and conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("family"), "i", "turn_digest", "chars")
    borrowed = known.withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}")).join(heads, "family").filter("i <= h").select("conv_id", "i", "turn_digest", "chars")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(BORROWED))
    start = known.select("conv_id", F.lit(0).alias("i"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("chars"))
    return borrowed.unionByName(numbered.filter(F.col("i") > h)).unionByName(start)


def chained(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, last): the prefixes of each conversation from its rows (conv_id, i,
    turn_digest, chars), each node a hash of its parent and its turn. A task holds one turn at a time."""

    def chain(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def emit(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "depth", "node", "parent", "chars", "last"])

        for b in common.batches(stream):
            out = []
            for conv, digest, chars in zip(b["conv_id"], b["turn_digest"], b["chars"]):
                if held is not None:
                    out.append((*held, held[0] != conv))
                if held is None or held[0] != conv:
                    held = (conv, 0, ROOT, None, 0)
                else:
                    held = (conv, held[1] + 1, hashlib.blake2b(held[2] + digest, digest_size=16).digest(), held[2], chars)
            if out:
                yield emit(out)
        if held is not None:
            yield emit([(*held, True)])

    dealt = rows.repartition(common.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "i")
    return dealt.select("conv_id", "turn_digest", "chars").mapInArrow(chain, _NODE)


def endings(ends: DataFrame) -> DataFrame:
    """(node, conv_id, n_convs, n_turns, ends_sha256) of each node at which conversations (node, conv_id, n_turns) end: the
    smallest, their number, and the hash of their identifiers in ascending order. Ranges of identifiers are joined first;
    a node's ranges then run through one hash, in order."""
    ranges = ends.groupBy("node", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("n_turns").alias("n_turns")
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, first, n, turns_ = None, None, 0, 0, 0
        names = ["node", "conv_id", "n_convs", "n_turns", "ends_sha256"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in common.batches(stream):
            out = []
            for node, ids, conv, own, long in zip(b["node"], b["ids"], b["conv_id"], b["n"], b["n_turns"]):
                if node != at:
                    if at is not None:
                        out.append((at, first, n, turns_, digest.hexdigest()))
                    at, digest, first, n, turns_ = node, hashlib.sha256(ids.encode()), conv, own, long
                else:
                    digest.update(b"," + ids.encode())
                    n += own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((at, first, n, turns_, digest.hexdigest()), kinds)], names)

    dealt = ranges.repartition(common.partitions(ends.sparkSession), "node").sortWithinPartitions("node", "range")
    return dealt.select("node", "ids", "conv_id", "n", "n_turns").mapInArrow(run, "node binary, conv_id long, n_convs long, n_turns long, ends_sha256 string")


def forest(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of whole subtrees from their conversations' prefixes (conv_id, depth, node, parent, chars, n_convs,
    ends_sha256), in any order: ``_OUT`` and, of a subtree's top, ``stem``, the node above it.

    ``place`` has the pointers, from a node and the next turn to the next node; a node comes to know its parent when it is
    made. The walk takes tops first from a stack and nodes are summed in the reverse order, children before parents.
    """
    rows = rows.sort_values(["conv_id", "depth"], kind="stable")
    place: dict[tuple[int, bytes], int] = {}
    up, depth, chars, n, first, ends, stem, below = [], [], [], [], [], [], [], []
    conv, at = None, -1
    columns = (rows[c].tolist() for c in ("conv_id", "depth", "node", "parent", "chars", "n_convs", "ends_sha256"))
    for own, deep, node, parent, size, many, ends_ in zip(*columns):
        if own != conv:
            conv, at = own, -1
        spot = place.get((at, node))
        if spot is None:
            spot = place[at, node] = len(up)
            for column, value in zip((up, depth, chars, n, first, ends, stem, below), (at, deep, size, 0, own, NO_ENDS, parent if at < 0 else None, [])):
                column.append(value)
            if at >= 0:
                below[at].append(spot)
        n[spot] += many
        first[spot] = min(first[spot], own)
        if ends_ is not None:
            ends[spot] = ends_
        at = spot
    leaves, saved = [0] * len(up), [0] * len(up)
    order, stack = [], [i for i, a in enumerate(up) if a < 0]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += below[at]
    for at in reversed(order):
        leaves[at] = sum(leaves[i] for i in below[at]) or 1
        saved[at] = (n[at] - 1) * chars[at] + sum(saved[i] for i in below[at])
    parents = pd.array([first[a] if a >= 0 else None for a in up], "Int64")
    return pd.DataFrame({"conv_id": first, "depth": depth, "parent_conv_id": parents, "n_convs": n, "n_children": [len(b) for b in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "stem": stem})


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def nodes(rows: DataFrame, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """The nodes (``_OUT``) of the trie over conversations (conv_id, i, turn_digest, chars), whose rows 0 are their starts."""
    prefixes = common.stored(chained(rows), "prefixes")
    ends = common.stored(endings(prefixes.filter("last").select("node", "conv_id", F.col("depth").alias("n_turns"))), "ends")
    # from here on a conversation stands for all that equal it, its smallest
    one = ends.select("conv_id", "n_convs", "n_turns", "ends_sha256")
    path = prefixes.join(one, "conv_id").select("conv_id", "depth", "node", "parent", "chars", "n_convs", "n_turns", F.when(F.col("last"), F.col("ends_sha256")).alias("ends_sha256"))
    path = common.stored(path, "paths")
    # the prefixes that are dealt again: the root, and those with more turns than a task takes
    large = path.filter("depth > 0").groupBy("node").agg(F.sum(F.expr("n_turns - depth + 1")).alias("turns")).filter(F.col("turns") > subtree_rows).select("node", F.lit(True).alias("large"))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    marked = path.withColumn("salt", salt).join(_salted(large), ["node", "salt"], "left").withColumn("large", F.expr("depth = 0 or large is not null"))
    by_conv = Window.partitionBy("conv_id")
    cut = marked.withColumn("cut", F.max(F.expr("case when large then depth end")).over(by_conv)).withColumn("subtree", F.max(F.expr("case when depth = cut + 1 then node end")).over(by_conv))
    cut = common.stored(cut.drop("salt", "large"), "cut")
    # subtrees, several to a task
    low = cut.filter("depth > cut")
    tasks = max(common.partitions(rows.sparkSession), -(-low.count() // subtree_rows))
    built = low.withColumn("task", F.pmod(F.xxhash64("subtree"), F.lit(tasks))).select("task", "conv_id", "depth", "node", "parent", "chars", "n_convs", "ends_sha256")
    built = common.stored(built.groupBy("task").applyInPandas(lambda rows_: forest(rows_.drop(columns="task")), _OUT + ", stem binary"), "subtrees")
    # stems
    high = cut.filter("depth <= cut").select("conv_id", "depth", "node", "parent", "chars", "n_convs", "ends_sha256")
    stems = high.groupBy("node").agg(*[F.max(c).alias(c) for c in ("depth", "parent", "chars", "ends_sha256")], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    stems = common.checkpointed(stems.withColumn("own", F.expr("(n_convs - 1) * chars")))
    tops = built.filter("stem is not null")
    under = high.select("conv_id", "depth", "node").join(tops.select("conv_id", "n_leaves", "saved_tokens"), "conv_id", "left").join(stems.select("conv_id", "depth", "own"), ["conv_id", "depth"], "left")
    from_below = F.sum(F.coalesce("own", F.lit(0))).over(Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0))
    under = under.select("node", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0)) + from_below).alias("saved_tokens"))
    under = under.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = tops.select("stem").unionByName(stems.filter("parent is not null").select(F.col("parent").alias("stem"))).groupBy("stem").agg(F.count("*").alias("n_children"))
    above = stems.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = stems.join(under, "node").join(children.withColumnRenamed("stem", "node"), "node", "left").join(above, "parent", "left")
    whole = whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    hung = tops.drop("parent_conv_id").withColumn("salt", salt).join(_salted(above.withColumnRenamed("parent", "stem")), ["stem", "salt"]).select(whole.columns)
    return whole.unionByName(hung).unionByName(built.filter("stem is null").select(whole.columns))


def prefix_trie(conversations: DataFrame, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Null turns come first; null role and text are empty; turns that share a number, or wholly repeat, are turns of their
    own, in order of role and text. Rows without conv_id are left out. Long texts are digests after the first scan. An empty
    table: no rows, not even a root. Other columns are ignored, whatever their names. One conversation's turns are
    chained in order, so by one task, which holds one of them at a time.
    """
    return nodes(rebuilt(common.stored(turns(conversations), "turns")), subtree_rows)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: The same in SQL, for checks: every prefix as a text, every ancestor of every node. The checksum of an identifier is
#: taken bit by bit.
ORACLE_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
ids as (
  select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 6 as h
  from (select distinct conv_id from t)),
r as (
  select ids.conv_id, t.i, role, text from ids join t on t.conv_id = ids.conv_id - ids.conv_id % 100 and t.i <= h
  union all select t.conv_id, t.i, role, text from t join ids using (conv_id) where t.i > h),
steps as (
  select conv_id, row_number() over (partition by conv_id order by i) as depth, text,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '' order by i) over (partition by conv_id order by i) as path from r
  union all select conv_id, 0, '', '' from ids),
last as (select conv_id, max(depth) as last from steps group by conv_id),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(length(text)) as chars,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = last), '')) as ends_sha256
  from steps join last using (conv_id) group by path, depth),
up as (
  select n.path, n.depth, p.path as parent, p.conv_id as parent_conv_id from nodes n join steps s on s.conv_id = n.conv_id and s.depth = n.depth - 1
  join nodes p on p.path = s.path and p.depth = s.depth),
kids as (select parent as path, depth - 1 as depth, count(*) as n_children from up group by all),
sums as (
  select s.path, s.depth, sum((n.n_convs - 1) * n.chars) as saved_tokens, count(*) filter (where n_children is null) as n_leaves
  from nodes n left join kids using (path, depth) join steps s on s.conv_id = n.conv_id and s.depth <= n.depth group by s.path, s.depth)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from nodes left join up using (path, depth) left join kids using (path, depth) join sums using (path, depth)
"""
