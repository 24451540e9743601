"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from pinweave.llm import jaccard, registry, simhash


def gram_set(text, shingle):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + min(len(w), shingle)]) for i in range(max(len(w) - shingle + 1, 1))) if w else frozenset()


def brute(rows, shingle, percent):
    """{index: (n, component)} of (doc_id, text) rows; links between distinct sets through an index of grams."""
    sets, least = [gram_set(t, shingle) for _, t in rows], {}
    for (i, _), s in zip(rows, sets, strict=True):
        least[s] = min((x for x in (i, least.get(s)) if x is not None), default=None)
    distinct = [s for s in least if s]
    at = {}
    for k, s in enumerate(distinct):
        for g in s:
            at.setdefault(g, []).append(k)
    up = list(range(len(distinct)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(distinct):
        common = {}
        for g in s:
            for j in at[g]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(distinct[j]) - n):
                up[find(k)] = find(j)
    low = {}
    for k, s in enumerate(distinct):
        if least[s] is not None:
            low[find(k)] = min(least[s], low.get(find(k), least[s]))
    root = {s: low.get(find(k)) for k, s in enumerate(distinct)}
    return sorted(((i, len(s), root[s] if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def same(spark, rows, shingle, percent, partitions=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, shingle, percent).collect()), key=str)
    assert got == brute(rows, shingle, percent)
    return got


def edited(words, n, rng, vocabulary):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        move = rng.randrange(3)
        if move == 0:
            w[k] = rng.choice(vocabulary)
        elif move == 1:
            w.insert(k, rng.choice(vocabulary))
        elif len(w) > 1:
            del w[k]
    return w


def test_near_copies_of_all_sizes(spark):
    """Texts of 1 to 600 words, each with copies of 1 to n / 25 edits: pairs on both sides of the limit."""
    rng, rows = random.Random(3), []
    vocabulary = [f"v{k}" for k in range(3000)]
    for size in [*range(1, 40), 50, 70, 100, 130, 200, 300, 600]:
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(8):
            rows.append((len(rows), " ".join(edited(base, rng.randrange(0, 2 + size // 25), rng, vocabulary))))
    got = same(spark, rows, 3, 90)
    assert 100 < len({c for _, _, c in got}) < len(rows)
    same(spark, rows, 5, 80, 3)


def test_chains_and_members_that_a_hub_misses(spark):
    """Each text is linked with the next few only, and shares fragments with many more."""
    rng = random.Random(4)
    words = [f"c{k}" for k in range(400)]
    rows, w = [], words[:200]
    for k in range(60):
        rows.append((1000 - k, " ".join(w)))
        at = rng.randrange(200)
        w = [*w[:at], f"new{k}", *w[at + 1 :]]
    got = same(spark, rows, 3, 90)
    assert len({c for _, _, c in got}) == 1


def test_shared_passages_are_no_links(spark):
    """Two thirds of each text is one passage: groups of sets that share fragments and are not linked."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " more") for k in range(0, 300, 7)]
    got = same(spark, rows, 3, 90)
    assert len({c for _, _, c in got}) == 300


def grouped(df, proposals=None):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 5, 80, proposals=proposals).collect()), key=str)


def test_proposals_change_nothing(spark):
    """Right, wrong, missing and chained proposals; chains and groups that fingerprints tear apart or throw together."""
    rng, rows = random.Random(8), []
    vocabulary = [f"v{k}" for k in range(2000)]
    for size in (1, 4, 6, 12, 40, 90, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(12):
            rows.append((len(rows), " ".join(edited(base, rng.randrange(0, 2 + size // 30), rng, vocabulary))))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (None, rows[5][1]), (7, rows[30][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 5, 80)
    everything = spark.createDataFrame([(0, k) for k in range(1, 503)] + [(400, 401), (83, 2), (7, 31)], "a long, b long")
    assert grouped(df) == grouped(df, everything) == grouped(df, everything.where("false")) == want
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in simhash.similar(df).collect()), key=str)
    assert found == want
    by_bits = {r.doc_id: r.component_id for r in simhash.near_duplicates(df.where("doc_id < 84 and doc_id <> 7"), shingle=5).collect()}
    assert any(c < i and by_bits[i] == i for i, n, c in want if i is not None and i in by_bits)  # links that the bits do not tell
    kept = [r.doc_id for r in simhash.unlike(df).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({i for i, n, c in want if i is not None and i == c and n} | {500}) and kept.count(None) == 1


def test_unlike_on_odd_rows(spark):
    named = spark.createDataFrame([(4, "a b c", "k", "n", 3), (2, "A b  c", "k2", "n2", 4), (9, "", "", "", 0), (8, None, "", "", 0), (None, "a b c", "", "", 1)], "doc_id long, text string, key string, node string, n long")
    got = simhash.unlike(named)
    assert got.columns == named.columns and sorted((str(r.doc_id), r.node) for r in got.collect()) == [("2", "n2"), ("8", ""), ("None", "")]
    assert simhash.unlike(named.limit(0)).count() == 0


def test_long_sets_are_counted_in_fragments(spark):
    rng = random.Random(6)
    base = [f"l{rng.randrange(50_000)}" for _ in range(9000)]
    far = [*base[:7000], *(f"m{k}" for k in range(2000))]
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 100, rng, ["zz", "yy"]))), (3, " ".join(base[:8300])), (4, " ".join(far)), (5, " ".join(base[:4200])), (6, " ".join(base[:4050]))]
    got = same(spark, rows, 3, 90)
    assert [c for _, _, c in got] == [1, 1, 1, 4, 5, 5]


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "A b"), (3, "a B"), (9, "a"), (None, "x y z w"), (4, "x y z W"), (None, "only null"), (None, None), (1, "r s t u"), (1, "r s t u"), (2, "other words here"), (2, "quite another text of it")]
    got = same(spark, rows, 3, 90)
    assert len(got) == len(rows)
    named = spark.createDataFrame([(1, "a b c d", "k", "n", 3)], "doc_id long, text string, key string, node string, n long")
    assert jaccard.jaccard_components(named).collect()[0].asDict() == {"doc_id": 1, "n_shingles": 1, "component_id": 1}
    assert jaccard.jaccard_components(named.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_components(named, 3, 100)


def test_levels_hold_every_linked_pair():
    for percent in (50, 80, 90, 95):
        lo, differ = jaccard.levels(percent)
        assert (np.diff(lo) > 0).all()
        for b in range(1, 3000):
            for a in {b, max(1, b - 1), -(-b * percent // 100)}:
                if 100 * a < percent * b or a < lo[0]:
                    assert a == b or 100 * a < percent * b or (a + b) * (100 - percent) // (100 + percent) < b - a or a >= lo[0]
                    continue
                la, lb = (int(np.searchsorted(lo, x, side="right")) - 1 for x in (a, b))
                assert lb == la or lb == la + 1 and 100 * a >= percent * lo[lb]
                assert (a + b) * (100 - percent) // (100 + percent) <= differ[lb]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in registry.table(spark, sf_dir, "documents").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in registry.QUERIES["op13_jaccard"](spark, sf_dir).collect()), key=str)
    assert got == brute(rows, 3, 90)
    assert any(a != c for a, _, c in got)
