import random

import numpy as np
import xxhash

from parcelflow.llm import simhash


def by_hand(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_hand():
    for text in (None, "", " \t", "One", "Two Words", "a b c d e A B C", "Émile é É x", "nb sp next em", "x " * 500):
        assert simhash.fingerprint(text) == by_hand(text)


def components(prints: list[int], bits: int) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_components_against_all_pairs(spark, monkeypatch):
    draw = random.Random(4)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:20]:
        for _ in range(12):
            for _ in range(draw.randint(1, 4)):
                base ^= 1 << draw.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    want = components(prints, 3)
    for bucket in (simhash.BUCKET, 2):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
        got = {r.v: r.root for r in simhash.components(found).collect()}
        groups: dict = {}
        for p, w in zip(prints, want):
            groups.setdefault(w, set()).add(got.get(signed(p), signed(p)))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_nulls_copies_and_clashing_columns(spark):
    rows = [(3, None), (2, ""), (7, "a b c d"), (7, "a b c d"), (5, "A b c d"), (None, "zzz yy x"), (9, " \n")]
    got = simhash.clusters(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (2, 2), (3, 2), (5, 5), (7, 5), (7, 5), (9, 2)]
    assert simhash.clusters(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_by_similarity(spark):
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    near = words[:]
    near[50] = "changed"
    rows = [(4, " ".join(words)), (2, " ".join(near)), (8, " ".join(draw.sample(words, 300))), (6, None), (1, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keeper string")
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [1, 2, 8]
    assert simhash.keep_first(docs).columns == docs.columns


def test_a_lead_that_is_unlike_hides_no_pair(spark):
    draw = random.Random(6)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    swapped = words[:]
    swapped[40], swapped[41] = swapped[41], swapped[40]
    rows = [(0, " ".join(words)), (1, " ".join(swapped))] + [(i, " ".join(draw.sample(words, 300))) for i in range(2, 42)]  # the same words throughout
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(2, 42)]


def exact(a: str, b: str) -> float:
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_links_of_a_bucket_are_those_of_all_pairs():
    draw = random.Random(7)
    for _ in range(30):
        base = [draw.randrange(1 << 40) for _ in range(40)]
        sets = [np.unique(np.array([x if draw.random() < 0.93 else draw.randrange(1 << 40) for x in base], np.uint64)) for _ in range(15)]
        pairs = [(i, j) for i in range(15) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
        links = simhash.alike(sets, 0.8)
        assert {(max(p), min(p)) for p in links} <= set(pairs) and joined(15, links) == joined(15, pairs)


def joined(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))
    for a, b in pairs:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def test_a_large_bucket_is_dealt_whole(spark):
    draw = random.Random(8)
    words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(30):
        own = words[:]
        own[draw.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), texts_at_once=4)
    assert {r.keeper for r in groups.collect()} == {0}


def near_pairs(draw: random.Random) -> list[tuple[str, str, str]]:
    """Texts of distinct words and copies whose tail is replaced or longer, 0.80 to 0.90 alike."""
    out = []
    for kind, n, changed, more in (("short", 20, 1, 0), ("tail", 50, 4, 0), ("longer", 100, 0, 20), ("long", 300, 28, 0), ("twelve", 12, 0, 2)):
        for _ in range(60):
            words = [f"w{draw.randrange(10**9)}" for _ in range(n + changed + more)]
            out.append((kind, " ".join(words[:n]), " ".join(words[: n - changed] + words[n:])))
    return out


def test_tails_and_short_texts_at_the_threshold(spark):
    pairs = near_pairs(random.Random(9))
    assert all(0.8 <= exact(a, b) <= 0.9 for _, a, b in pairs)
    rows = [(2 * i + k, t) for i, (_, a, b) in enumerate(pairs) for k, t in enumerate((a, b))]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, len(rows), 2))


def test_decision_is_by_the_whole_sets(spark):
    draw = random.Random(10)
    texts, want = [], set()
    for i in range(80):  # some just above, some just below
        words = [f"w{draw.randrange(10**9)}" for _ in range(250)]
        changed = 21 + i % 5
        a, b = " ".join(words[:200]), " ".join(words[: 200 - changed] + words[200 : 200 + changed])
        assert abs(exact(a, b) - 0.8) < 0.03
        texts += [a, b]
        want |= {2 * i} if exact(a, b) >= 0.8 else {2 * i, 2 * i + 1}
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == want and len(texts) // 2 < len(want) < len(texts)


def test_a_text_of_many_shingles():
    draw = random.Random(21)
    text = " ".join(f"w{draw.randrange(5000)}" for _ in range(70_000))
    assert simhash.fingerprint(text) == by_hand(text)


def test_keep_first_leaves_the_columns_of_the_user(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z"), (2, "a b c", "x", "y", "z")], "doc_id long, text string, _text string, text_hash string, whole_id string")
    assert [tuple(r) for r in simhash.keep_first(docs).collect()] == [(1, "a b c", "x", "y", "z")]


def test_fingerprint_links_join_what_shingles_leave_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "alike", lambda sets, similarity: [])  # nothing is alike by shingles
    draw = random.Random(12)
    words = [f"w{draw.randrange(10**6)}" for _ in range(4000)]
    near = words[:]
    near[50] = "changed"
    a, b, c = " ".join(words), " ".join(near), " ".join(words).upper()
    assert 0 < (by_hand(a) ^ by_hand(b)).bit_count() <= 3 and by_hand(a) == by_hand(c)
    other = " ".join(draw.sample(words, 4000))
    texts = spark.createDataFrame([(i, simhash.fingerprint(t) - (1 << 64) * (simhash.fingerprint(t) >> 63)) for i, t in enumerate((a, b, c, other))], "text_id long, fp long")
    roots = {r.v: r.root for r in simhash.components(simhash.fingerprint_links(texts, 3)).collect()}
    assert roots == {0: 0, 1: 0, 2: 0}
