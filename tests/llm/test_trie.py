import hashlib
import random
import zlib

import pytest

from parcelflow.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, depth int"


def brute(rows):
    own: dict = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + x[h:])
    members: dict = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    below: dict = {}
    for path in members:
        for d in range(len(path) + 1):
            below.setdefault(path[:d], []).append(path)
    children = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in members}
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(path))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[path] if q)
        leaves = sum(not children[q] for q in below[path])
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **more):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = trie.prefix_trie(df, **more)
    assert sorted(out.columns) == sorted(names)
    return sorted((tuple(r[n] for n in names) for r in out.collect()), key=repr)


def conversations(seed=4):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(700), 150):
        for turn in range(draw.randrange(1, 8)):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["yes", "no", "", None, "ünï😀"]) if turn else "hello", "n", 9))
    rows += [(c, t, "user", "the same", "n", 9) for c in range(900, 960) for t in range(9)]  # copies
    rows += [(2000 + c, t, "user", f"long {t}", "n", 9) for c in (0, 1) for t in range(300)]  # one chain
    rows += [(3001, None, "b", "tie", "n", 9), (3001, None, "a", "tie", "n", 9), (3001, None, "a", "tie", "n", 9), (3001, 1, "a", "x" * 200_000, "n", 9), (None, 1, "user", "nobody", "n", 9)]
    rows += [(5007, 1, "user", "borrows from none", "n", 9)]  # no family and, where the hash says so, no turns
    return rows


@pytest.mark.parametrize("subtree_rows", [1, 7, 60, 20_000])
def test_against_brute_force(spark, subtree_rows):
    rows = conversations()
    assert found(spark.createDataFrame(rows, SCHEMA), subtree_rows=subtree_rows) == brute(rows)


def test_turnless_conversations_and_empty_table(spark):
    lone = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 > 0][:4]
    rows = [(c, 1, "user", "gone", "n", 9) for c in lone]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(min(lone), 0, None, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, lone)).encode()).hexdigest())]
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_many_members_of_one_end_run_through_one_hash(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE", 16)
    rows = [(c, t, "user", "same", "n", 9) for c in range(400) for t in range(7)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
