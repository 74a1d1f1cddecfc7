"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ by at most three of 64 bits agree in one of their two halves but for one bit, or
wholly. Each distinct fingerprint is therefore indexed by the variants of its halves with one bit struck
out; an equality join on variants brings candidates together, and they are verified by their distance.
Only as many links as hold a bucket's parts together leave it, never all its pairs.

A bucket of more than ``BUCKET`` distinct fingerprints is dealt again by one-wildcard variants of the
other half's halves (16 bits each) and once more by those of the remaining 8-bit parts. What is then left
free is 8 bits and three struck bits: 2^11 distinct fingerprints at most, so that no bucket needs a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints that one task compares among themselves.
BUCKET = 2304


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text; zero where it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    own = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return own(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    hashes = np.array([own(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # a bounded number of bit rows at a time
        part = hashes[i : i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint (a signed 64-bit integer) of each whole text, where it lies."""
    common.small_batches(docs.sparkSession)

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            values = np.array([fingerprint(t, shingle, seed) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(one, "doc_id long, fp long")


def _variants(distinct: DataFrame) -> DataFrame:
    """(key, level, fp): both halves of each fingerprint with each of their bits struck out in turn. The key
    holds the struck bit's place (0 to 63) above the half's other 31 bits."""
    half = lambda w: F.expr(f"case when {w} < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end")
    keyed = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w"))
    struck = F.expr("shiftleft(1L, w % 32)")
    return keyed.select((F.col("w").cast("long") * F.lit(1 << 32) + half("w").bitwiseAND(F.expr("~(0L)").bitwiseXOR(struck))).alias("key"), F.lit(1).alias("level"), "fp")


def _spanning(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what lies within ``bits`` of one another among distinct values, as few as will do."""
    n = len(values)
    label, links = np.full(n, -1), []
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        front = [root]
        while front:
            at = front.pop()
            free = np.flatnonzero(label < 0)
            if not len(free):
                break
            near = free[np.bitwise_count(values[free] ^ values[at]) <= bits]
            label[near] = root
            links += [(int(values[at]), int(values[j])) for j in near]
            front += near.tolist()
    return links


def _bucket_links(indexed: DataFrame, bits: int) -> DataFrame:
    """(a, b, key, level, fp): links of each bucket, or, of one that is too large, its members to deal again."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_key, left_level, left = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in stream:
            if not batch.num_rows:
                continue
            key = np.concatenate([left_key, batch.column(0).to_numpy()])
            level = np.concatenate([left_level, batch.column(1).to_numpy()])
            fp = np.concatenate([left, batch.column(2).to_numpy()])
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            yield from resolve(key[:whole], level[:whole], fp[:whole])
            left_key, left_level, left = key[whole:], level[whole:], fp[whole:]
            if len(left) > 4 * BUCKET:  # surely too large: pass it on, but keep enough to know that it is
                yield big(left_key[BUCKET + 1 :], left_level[BUCKET + 1 :], left[BUCKET + 1 :])
                left_key, left_level, left = left_key[: BUCKET + 1], left_level[: BUCKET + 1], left[: BUCKET + 1]
        yield from resolve(left_key, left_level, left)

    def big(key: np.ndarray, level: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(key, pa.int64()), pa.array(level, pa.int32()), pa.array(fp, pa.int64())], ["a", "b", "key", "level", "fp"])

    def resolve(key: np.ndarray, level: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = ends - starts
        two = starts[size == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= bits
        a, b = [fp[two][near]], [fp[two + 1][near]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            own = np.unique(fp[s:e].view(np.uint64))
            if len(own) > BUCKET:
                yield big(key[s:e], level[s:e], fp[s:e])
            elif links := _spanning(own, bits):
                pairs = np.array(links, np.uint64).view(np.int64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        if len(pairs):
            none = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64())], ["a", "b", "key", "level", "fp"])

    dealt = indexed.repartition(common.partitions(indexed.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(scan, "a long, b long, key long, level int, fp long")


def _deal_again(members: DataFrame) -> DataFrame:
    """Members of buckets that are too large, by variants of a part that the bucket's key leaves free.

    Level 1 fixed a half (32 bits); level 2 fixes 16 bits of the other half; level 3 fixes 8 of its last 16.
    Which bits are free follows from the key's path, kept in ``key`` as a hash and in ``level`` as
    level + 8 * place, where place is the position of the free bits.
    """
    step = F.col("level") % 8
    place = F.when(step == 1, F.when(F.shiftrightunsigned("key", 32) < 32, F.lit(32)).otherwise(F.lit(0))).otherwise((F.col("level") / 8).cast("int"))
    width = F.when(step == 1, F.lit(16)).otherwise(F.lit(8))
    more = members.select("key", "fp", step.alias("step"), place.alias("place"), width.alias("width"))
    parts = more.select("*", F.explode(F.sequence(F.lit(0), 2 * F.col("width") - 1)).alias("w"))
    part_at = F.expr("place + case when w < width then 0 else width end")
    free_at = F.expr("place + case when w < width then width else 0 end")
    value = F.expr(f"shiftrightunsigned(fp, {'place + case when w < width then 0 else width end'}) & (shiftleft(1L, width) - 1) & ~shiftleft(1L, w % width)")
    return parts.select(F.xxhash64("key", part_at, "w", value).alias("key"), (F.col("step") + 1 + 8 * free_at).cast("int").alias("level"), "fp")


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp) that leave the same parts together as all pairs within
    ``bits`` (at most 3) would."""
    if not 0 <= bits <= 3:
        raise ValueError("two one-wildcard halves find at most three differing bits")
    found, indexed = [], _variants(distinct)
    for _ in range(3):
        out = common.checkpointed(_bucket_links(indexed, bits))
        found.append(out.filter("a is not null").select("a", "b"))
        large = out.filter("a is null").select("key", "level", "fp")
        if large.isEmpty():
            break
        indexed = _deal_again(large).distinct()
    all_links = found[0]
    for more in found[1:]:
        all_links = all_links.unionByName(more)
    return all_links.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of each vertex of ``edges`` (a, b): the smallest vertex that it can reach.

    Labels spread to neighbours and then jump to their own label's label; every round's table is
    checkpointed and lineage ends there. Nothing but a count reaches the driver.
    """
    both = common.checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = common.checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("root").alias("heard"))
        lower = labels.join(heard, "v").select("v", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = lower.select(F.col("v").alias("root"), F.col("root").alias("far"))
        step = common.checkpointed(lower.join(jump, "root").select("v", F.least("root", "far").alias("root"), "old"))
        settled = step.filter("root < old").isEmpty()
        labels = step.select("v", "root")
        if settled:
            return labels


def clusters(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every document.

    Null text: no words, so fingerprint zero. Repeated rows stay. A null doc_id stays null and never names a
    component unless nothing else is in it. An empty table: no rows. Other columns are ignored.
    """
    own = common.checkpointed(fingerprints(docs, shingle, seed))
    distinct = common.checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), bits))
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = common.checkpointed(named.join(least, "root").select("fp", "component_id"))
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# -------------------------------------------- near duplicates by similarity

SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: A text's keys, each of so many least hashes of its shingles: a pair of likeness s shares no key with probability
#: (1 - s^ROWS)^BANDS, 0.00003 at 0.8 and less above.
BANDS, ROWS = 20, 4
#: Texts of one key that one task compares among themselves; more are dealt to pairs of parts.
TEXTS = 2_000

_FACTORS = (np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """The 64-bit hashes of a text's distinct five-word shingles in ascending order (of all its words, if they are
    fewer). A text without words has one of its own, so that such texts are alike."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    known = common.memo("shingles", common.MEMO_WORDS)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    hashes = np.array([known[w] for w in words], np.uint64)
    k = min(SIMILAR_SHINGLE, len(words))
    shingles = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        shingles = _mixed(shingles + hashes[i : len(hashes) - k + 1 + i], i + 11)
    return np.unique(_mixed(shingles, 5))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of shingles, each a hash of ``ROWS`` least hashes of the set and of the key's number."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 12):  # a bounded table at a time
        np.minimum(least, (shingles[None, i : i + (1 << 12)] * _FACTORS[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys + rows[:, i], i + 23)
    return keys.view(np.int64)


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between sets whose likeness (common shingles by all of both) is ``similarity`` at least: as few as leave
    together what all such links would."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both / (sizes.sum() - both) >= similarity else []
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = lambda i: flat[ends[i] - sizes[i] : ends[i]]
    marked = np.zeros(int(flat.max()) + 1, bool)
    free, held, links = np.arange(n), flat, []  # texts without a group yet, and their shingles
    while len(free) > 1:
        front = [int(free[0])]
        held, free = held[sizes[free[0]] :], free[1:]
        while front and len(free):
            at = front.pop()
            marked[own(at)] = True
            size = sizes[free]
            both = np.add.reduceat(marked[held], np.cumsum(size) - size, dtype=np.int64)
            marked[own(at)] = False
            near = both / (size + sizes[at] - both) >= similarity
            if near.any():
                found = free[near].tolist()
                links += [(at, j) for j in found]
                front += found
                held, free = held[np.repeat(~near, size)], free[~near]
    return links


def _verified(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the links of each bucket (key, part) of texts (text_id, shingles)."""

    def solve(ids: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        return [(ids[i], ids[j]) for i, j in alike([np.frombuffer(s, "<u8") for s in sets], similarity)] if len(ids) > 1 else []

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        for b in common.batches(stream):
            out: list[tuple[int, int]] = []
            for key, part, text_id, shingles in zip(b["key"], b["part"], b["text_id"], b["shingles"]):
                if (key, part) != at:
                    out += solve(ids, sets)
                    at, ids, sets = (key, part), [], []
                ids.append(text_id)
                sets.append(shingles)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if out := solve(ids, sets):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    spread = dealt.repartition(common.partitions(dealt.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return spread.select("key", "part", "text_id", "shingles").mapInArrow(scan, "a long, b long")


def fingerprint_links(texts: DataFrame, bits: int) -> DataFrame:
    """(a, b): links among texts (text_id, fp) that leave together what all pairs of fingerprints within ``bits`` would. Texts
    of one fingerprint are linked to the least of them, and these as ``links`` links the fingerprints."""
    firsts = common.checkpointed(texts.groupBy("fp").agg(F.min("text_id").alias("first")))
    same = texts.join(firsts, "fp").filter("text_id <> first").select(F.col("first").alias("a"), F.col("text_id").alias("b"))
    named = lambda side: firsts.select(F.col("fp").alias(side), F.col("first").alias(f"text_{side}"))
    near = links(firsts.select("fp"), bits).join(named("a"), "a").join(named("b"), "b").select(F.col("text_a").alias("a"), F.col("text_b").alias("b"))
    return same.unionByName(near)


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, texts_at_once: int = TEXTS, bits: int | None = None) -> DataFrame:
    """(text_id, doc_id, keeper): each row's text, and the smallest doc_id of its near-duplicate group.

    With ``bits``, texts whose SimHash fingerprints differ by so many bits at most are linked, by ``links`` over their
    deletion variants. These links stand; those below join what fingerprints lose.

    Texts of which ``similarity`` of all five-word shingles are common are linked, and links make groups. Candidates are
    texts with a common key of ``band_keys``, which a linked pair lacks with the probability that ``BANDS`` states. All
    texts of a key are compared by their whole sets of shingles, and only what the comparison holds becomes a link; a key
    with more than ``texts_at_once`` texts is dealt to all pairs of its parts. Keys of the same texts are one. Equal texts
    are one vertex. Null and empty texts are equal, and like any text without words.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the keys are made for a similarity of {SIMILARITY} at least")
    common.small_batches(docs.sparkSession)

    def keys_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            keys = [band_keys(shingle_set(t)) for t in b["text"]]
            fps = np.array([0 if bits is None else fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b["text_id"], pa.int64()), pa.array(b["doc_id"], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["text_id", "doc_id", "keys", "fp"])

    def sets_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in common.batches(stream):
            ids, sets = [], []
            for text_id, text in zip(b["text_id"], b["text"]):
                if text_id != last:  # copies mostly come in a row
                    ids.append(text_id)
                    sets.append(shingle_set(text).astype("<u8").tobytes())
                last = text_id
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["text_id", "shingles"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("text_id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = common.stored(rows.mapInArrow(keys_of, "text_id long, doc_id long, keys array<long>, fp long"), "keys")
    texts = common.checkpointed(own.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    keyed = texts.select("text_id", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("text_id").alias("x"), F.bit_xor(F.xxhash64("text_id")).alias("y")).filter("n > 1")
    buckets = common.checkpointed(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / texts_at_once).cast("int").alias("parts")))
    members = common.checkpointed(keyed.join(buckets, "key"))
    sets = rows.select("text_id", "text").join(members.select("text_id").distinct(), "text_id").select("text_id", "text").mapInArrow(sets_of, "text_id long, shingles binary")
    sets = common.stored(sets.groupBy("text_id").agg(F.first("shingles").alias("shingles")), "sets")
    place = members.withColumn("i", F.expr("pmod(xxhash64(text_id, key), parts)")).withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = place.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "parts", "text_id")
    dealt = dealt.select("key", (F.col("low") * F.col("parts") + F.col("high")).alias("part"), "text_id").join(sets, "text_id")
    true_links = _verified(dealt, similarity)
    if bits is not None:
        true_links = true_links.unionByName(fingerprint_links(texts.select("text_id", "fp"), bits))
    roots = components(common.checkpointed(true_links.distinct()))
    named = texts.select("text_id", "first_id").join(roots.withColumnRenamed("v", "text_id"), "text_id", "left").select("text_id", "first_id", F.coalesce("root", "text_id").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("keeper"))
    keepers = common.checkpointed(named.join(least, "root").select("text_id", "keeper"))
    return own.select("text_id", "doc_id").join(keepers, "text_id").select("text_id", "doc_id", "keeper")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each near-duplicate group (``similar_groups``). Rows that share a doc_id and text are
    one; a group whose doc_ids are all null keeps one row. Columns stay as they are."""
    groups = similar_groups(docs, similarity, bits=bits)
    h, whole = common.spare(docs, "text_hash", "whole_id")
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))  # joins and duplicates go by the same two keys
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("keeper"))).select(F.col("text_id").alias(h), own_id.alias(whole)).distinct()
    keyed = docs.withColumns({h: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), whole: own_id})
    return keyed.join(kept, [h, whole], "left_semi").dropDuplicates([h, whole]).select(docs.columns)
