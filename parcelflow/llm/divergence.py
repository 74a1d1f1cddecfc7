"""Source divergence audit: how far each source's words lie from its language and from the language's other sources.

Terms are counted where the texts lie, a row for each (lang, source, term) of a task. Every group gives each kept term a
smoothed share p in billionths, and the chi-square-like distance of p from q is ``(p - q)^2 div q``, in integers.

Pairs are sparse: two groups that both lack a term have the same distance there (the *baseline*), so that it is added for
all terms at once, and only what terms that occur add to it is summed: from counts of equal shares where one of both has
the term, and where both have it from blocks of terms by blocks of sources. Terms are ranked by radix selection:
histograms over 16 bits of the value at a time find each group's kth value, and ties go on by bytes of UTF-8, two at a time,
so that a group is never sorted or gathered beyond its first k.
"""

from __future__ import annotations

import itertools
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Terms that a task counts before it passes its counts on.
HELD_TERMS = 600_000
#: A group's rows are dealt to so many places where they meet the group's own row.
SALTS = 32
#: Terms that stand for none, for groups that may have no term.
MARKS = 997
_MARK = "term < 'A'"
#: Sources that a task holds against as many others.
SOURCES = 128
#: Terms that a task holds at a time, about.
SLOT_TERMS = 4096

#: What is no letter of ASCII and below 128 parts terms; A-Z are lowered.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in UTF-8: runs of ASCII letters and of what lies beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed in each task; and a row for each
    (lang, source) that occurs, with a number for a term (no term has digits), so that these rows are not all of one term."""
    common.small_batches(docs.sparkSession)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        marks = itertools.count(random.randrange(MARKS))

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in groups.items():
                keys = [str(next(marks) % MARKS).encode(), *n]
                for i in range(0, len(keys), 1 << 16):
                    part = keys[i : i + (1 << 16)]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array([k.decode() for k in part]), pa.array([n[k] for k in part], pa.int64()), pa.array([docs_[k] for k in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for b in common.batches(stream):
            for lang, source, text in zip(b["lang"], b["source"], b["text"]):
                found = terms(text)
                n, docs_ = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                docs_.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > HELD_TERMS:
                yield from emit()
        yield from emit()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str) -> Column:
    """The smoothed share of a count, in billionths; ``v`` is the number of kept terms. Exact at any count."""
    return F.expr(f"case when v > 0 then 1 + (cast({n} + 1 as decimal(20, 0)) * {SCALE}) div ({total} + v) end")


def _distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for each salt: the small side of a join on a group."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")


# ------------------------------------------------------------------ selection


def _step(alive: DataFrame, ascending: bool) -> DataFrame:
    """From rows (lang, source, need, head, digit), one for each candidate, those digits of each group at which its
    ``need``-th candidate stands: (.., head, digit, need: how many of them, n: of how many)."""
    histogram = alive.groupBy("lang", "source", "head", "need", "digit").agg(F.count("*").alias("n"))
    order = F.col("digit").asc() if ascending else F.col("digit").desc()
    upto = F.sum("n").over(Window.partitionBy("lang", "source").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    reached = histogram.withColumn("upto", upto).filter("upto >= need and upto - n < need")
    return reached.select("lang", "source", "head", "digit", F.expr("need - (upto - n)").alias("need"), "n")


def bounds(rows: DataFrame, k: int) -> DataFrame:
    """(lang, source, cut, head, seen) of the groups with more than ``k`` rows (term, value): a row is among the first k by
    value descending and term ascending if its value is above ``cut``, or is ``cut`` and its first ``seen`` bytes are
    ``head`` or below (null: all). Values are not negative. Each of the steps is a histogram of at most 65,536 rows a group.
    """
    keyed = rows.select("lang", "source", "term", "value", _salt())
    state = _salted(rows.groupBy("lang", "source").agg(F.count("*").alias("n")).filter(F.col("n") > k).select("lang", "source", F.lit(0).cast("long").alias("head"), F.lit(k).cast("long").alias("need")))
    for shift in (48, 32, 16, 0):
        above = F.shiftrightunsigned("value", shift + 16) if shift < 48 else F.lit(0).cast("long")
        alive = keyed.join(state, ["lang", "source", "salt"]).filter(above == F.col("head"))
        found = _step(alive.select("lang", "source", "head", "need", F.shiftrightunsigned("value", shift).bitwiseAND(F.lit(65535)).alias("digit")), False)
        found = common.checkpointed(found.select("lang", "source", F.expr("head * 65536 + digit").alias("head"), "need", "n"))
        state = _salted(found.select("lang", "source", "head", "need"))
    done = [found.filter("n = need").select("lang", "source", F.col("head").alias("cut"), F.lit(None).cast("binary").alias("head"), F.lit(0).alias("seen"))]
    open_ = found.filter("n > need").select("lang", "source", F.col("head").alias("cut"), "need")
    ties = keyed.join(_salted(open_), ["lang", "source", "salt"]).filter("value = cut").select("lang", "source", "salt", F.encode("term", "utf-8").alias("term"))
    ties, cuts, at = common.checkpointed(ties), open_.select("lang", "source", "cut"), 0
    state = open_.select("lang", "source", F.lit(b"").alias("head"), "need")
    while not state.isEmpty():
        alive = ties.join(_salted(state), ["lang", "source", "salt"]).filter(F.expr(f"substring(term, 1, {at})") == F.col("head"))
        found = _step(alive.select("lang", "source", "head", "need", F.expr(f"substring(term, {at + 1}, 2)").alias("digit")), True)
        found, at = common.checkpointed(found.select("lang", "source", F.concat("head", "digit").alias("head"), "need", "n")), at + 2
        done.append(cuts.join(found.filter("n = need").select("lang", "source", "head"), ["lang", "source"]).select("lang", "source", "cut", "head", F.lit(at).alias("seen")))
        state = found.filter("n > need").select("lang", "source", "head", "need")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return common.checkpointed(out)


def first_rows(rows: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank) of each group's first ``k`` rows by value descending, then term ascending (UTF-8)."""
    cut = _salted(bounds(rows, k))
    near = rows.select("lang", "source", "term", "value", _salt()).join(cut, ["lang", "source", "salt"], "left")
    first = near.filter("cut is null or value > cut or (value = cut and (head is null or substring(encode(term, 'utf-8'), 1, seen) <= head))")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term"))
    return first.select("lang", "source", "term", "value", rank.alias("rank"))


# ---------------------------------------------------------------------- pairs


def _common_terms(scored: DataFrame, wide: int) -> DataFrame:
    """(lang, a, b, value): what the terms that both sources have add to the sums of their own parts.

    Terms are dealt to slots of some ``SLOT_TERMS`` with all rows of each, and sources to blocks, two of which a task holds.
    Nothing but sums by pair leaves a task.
    """
    placed = scored.filter("spread > 1").select(
        "lang", F.expr(f"pmod(xxhash64(term), v div {SLOT_TERMS} + 1)").alias("slot"), "term", F.col("sid").cast("int").alias("sid"), "p", "p0",
        F.expr(f"sid div {wide}").cast("int").alias("own"), F.explode(F.expr(f"sequence(0, cast((sources - 1) div {wide} as int))")).alias("other"),
    )
    dealt = placed.select("lang", "slot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "term", "sid", "p", "p0")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(rows["low"].iat[0]), int(rows["high"].iat[0])
        term, sid = pd.factorize(rows["term"])[0], rows["sid"].to_numpy()
        tables, bases = [], []
        for side in (low, high):
            own = sid // wide == side
            table, base = np.zeros((term.max() + 1, wide), np.int64), np.ones(wide, np.int64)
            table[term[own], sid[own] % wide] = rows["p"].to_numpy()[own]
            base[sid[own] % wide] = rows["p0"].to_numpy()[own]
            tables.append(table)
            bases.append(base)
        sums = np.zeros((2, wide, wide), np.int64)
        far = lambda p, q: (p - q) ** 2 // q
        left, right = tables
        q0 = bases[1]
        for a in np.flatnonzero(left.any(axis=0)):
            at, p0 = np.flatnonzero(left[:, a]), bases[0][a]
            p, q = left[at, a][:, None], right[at]
            there = q > 0
            q = np.where(there, q, 1)
            sums[0, a] = ((far(p, q) - far(p, q0) - far(p0, q) + far(p0, q0)) * there).sum(axis=0)
            if low != high:
                sums[1, a] = ((far(q, p) - far(q, p0) - far(q0, p) + far(q0, p0)) * there).sum(axis=0)
        side, a, b = np.nonzero(sums)
        first, second = low * wide + a, high * wide + b
        return pd.DataFrame({"lang": rows["lang"].iat[0], "a": np.where(side == 0, first, second), "b": np.where(side == 0, second, first), "value": sums[side, a, b]})

    summed = dealt.groupBy("lang", "slot", "low", "high").applyInPandas(solve, "lang string, a int, b int, value long")
    return summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))


def pairs(groups: DataFrame, scored: DataFrame, sources_at_once: int = SOURCES) -> DataFrame:
    """(lang, source, item, value): the distance of each group from each other source of its language, over all kept terms.

    ``v`` terms at the baseline of two groups without any; what a group's own terms add, by the number of its terms of each
    share against the baselines of the others; and what common terms add to both.
    """
    one = groups.select("lang", "source", F.col("sid").alias("a"), F.col("p0").alias("a0"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("b"), F.col("p0").alias("b0"))
    shares = scored.groupBy("lang", F.col("sid").alias("a"), "p0", "p").agg(F.count("*").alias("n"))
    met = _salted(groups.select("lang", F.col("sid").alias("b"), F.col("p0").alias("b0")))
    met = shares.withColumn("salt", F.pmod(F.xxhash64("a", "p"), F.lit(SALTS)).cast("int")).join(met, ["lang", "salt"]).filter("a <> b")
    alone = met.groupBy("lang", "a", "b").agg(
        F.sum(F.expr(f"n * ({_distance('p', 'b0')} - {_distance('p0', 'b0')})")).alias("forth"), F.sum(F.expr(f"n * ({_distance('b0', 'p')} - {_distance('b0', 'p0')})")).alias("back")
    )
    back = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "back")
    every = one.join(two, "lang").filter("a <> b")
    summed = every.join(alone.drop("back"), ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(_common_terms(scored, sources_at_once), ["lang", "a", "b"], "left")
    value = f"case when v > 0 then v * ({_distance('a0', 'b0')}) + coalesce(forth, 0) + coalesce(back, 0) + coalesce(both, 0) else 0 end"
    return summed.select("lang", "source", "item", F.expr(value).cast("long").alias("value"))


# ---------------------------------------------------------------------- audit


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, sources_at_once: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's other sources by distance (``pair``, all of them) and its first
    ``top`` terms that it has more often than its language (``term``).

    Null text, lang and source are empty. Rows that repeat are documents of their own. A group without terms has distances
    from the others all the same; a language without kept terms has distances of 0. Ties go by the item's UTF-8 bytes.
    An empty table: no rows. Other columns are ignored, whatever their names.
    """
    # one shuffle by term serves the sums by source and the choice of terms
    counts = counted(docs).repartition(common.partitions(docs.sparkSession), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    chosen = counts.select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("docs"), F.count("*").over(by_term).alias("spread"))
    chosen = common.stored(chosen.filter(f"docs >= {min_docs} or {_MARK}").drop("docs"), "kept")
    kept = chosen.filter(f"not {_MARK}")
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own = chosen.filter(_MARK).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    own = own.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")])
    by_lang = Window.partitionBy("lang")
    groups = own.withColumns({"p0": _share("0", "total"), "sid": F.row_number().over(by_lang.orderBy("source")) - 1, "sources": F.count("*").over(by_lang)})
    groups = common.checkpointed(groups)
    scored = kept.withColumn("salt", _salt()).join(_salted(groups), ["lang", "source", "salt"])
    scored = scored.select("lang", "source", "sid", "sources", "spread", "term", "v", "p0", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    scored = common.stored(scored, "scored")
    above = scored.filter("p > q").select("lang", "source", "term", F.expr(_distance("p", "q")).alias("value"))
    ranked = first_rows(above, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    others = pairs(groups, scored, sources_at_once).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return others.unionByName(ranked)


#: The same in SQL, for checks: every share of every kept term written out.
ORACLE_SQL = f"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as found from documents),
t as (select row, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as lang_n from t group by lang, term having count(distinct row) >= {MIN_DOCS}),
counts as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
groups as (
  select lang, source, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total, coalesce(total, 0) as total from (select distinct lang, source from d)
  left join langs using (lang) left join (select lang, source, sum(n) as total from counts group by all) using (lang, source)),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + g.v) as p, 1 + ({SCALE}::hugeint * (k.lang_n + 1)) // (g.lang_total + g.v) as q
  from groups g join kept k using (lang) left join counts c using (lang, source, term)),
distances as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join distances x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {TOP}
"""
