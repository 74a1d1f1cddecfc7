import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelflow.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, salt int"
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in _TERM.findall(text or "")]


def brute(rows, top):
    out, langs = [], {}
    for _, text, lang, source, *_ in rows:
        langs.setdefault(lang or "", []).append((source or "", plain(text)))
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    far = lambda p, q: (p - q) ** 2 // q
    for lang, docs in langs.items():
        seen, all_, groups = Counter(), Counter(), {}
        for source, own in docs:
            seen.update(set(own))
            all_.update(own)
            groups.setdefault(source, Counter()).update(own)
        kept = sorted(t for t, n in seen.items() if n >= 3)
        v, total = len(kept), sum(all_[t] for t in kept)
        p = {s: {t: share(c[t], sum(c[x] for x in kept), v) for t in kept} for s, c in groups.items()}
        for s in groups:
            pairs = sorted(((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            own = sorted((-far(p[s][t], q), t.encode()) for t in kept if groups[s][t] > 0 and p[s][t] > (q := share(all_[t], total, v)))[:top]
            for part, found in (("pair", pairs), ("term", own)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def found(spark, rows, **more):
    out = divergence.audit(spark.createDataFrame(rows, SCHEMA), **more)
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in out.collect())


def corpus(seed=2, n=120):
    draw = random.Random(seed)
    words = [a + b for a in ("the", "Über", "ab", "AB", "x", "été", "日本", "😀") for b in ("", "s", "ly", "lynxes", "lynxer", "é")]
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(words[draw.randrange(4) :: 3]) + draw.choice(["", ",", "7", "_"]) for _ in range(draw.randrange(40)))
        rows.append((i, text, draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "b", "b", "b", "c", "d", None, "é"]), "t", 1))
    rows += [(900, None, "en", "silent", "t", 1), (901, "", "only empty", "x", "t", 1), (902, "rare", "only empty", "y", "t", 1), (903, "the " * 50_000 + "w" * 100_000, "en", "long", "t", 1)]
    return rows + rows[:10]


def test_against_brute_force_with_ties(spark):
    rows = corpus()
    for top in (1, 3, 200):
        assert found(spark, rows, top=top) == brute(rows, top), top


def test_many_sources_are_dealt_to_blocks(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice("pqrstuv") * draw.randrange(1, 4) for _ in range(12)), "en", f"s{i % 11}", "t", 1) for i in range(66)]
    assert found(spark, rows, sources_at_once=3) == brute(rows, 200)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_selection_goes_by_bytes_where_values_tie(spark):
    words = ["a" * 9 + c for c in "zéxbac😀y日"] + ["a", "aa", "aaa", "b"]
    rows = [("en", "s", w, 7) for w in words] + [("en", "t", w, i) for i, w in enumerate(words)] + [("en", "u", w, (1 << 60) + i // 3) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, value long")
    for k in (1, 4, 5, 9, 12, 13, 20):
        want = sorted((g, w, i + 1) for g in "stu" for i, (_, w) in enumerate(sorted(((-v, w) for _, s, w, v in rows if s == g), key=lambda x: (x[0], x[1].encode()))[:k]))
        assert sorted((r.source, r.term, r.rank) for r in divergence.first_rows(df, k).collect()) == want, k


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_terms(text):
    assert [t.decode() for t in divergence.terms(text)] == plain(text)


@pytest.mark.parametrize("text", [None, "", "!!", "A-b_C9d", " x y"])
def test_terms_of_odd_texts(text):
    assert [t.decode() for t in divergence.terms(text)] == plain(text)
