"""Periodic runs against brute force, and the planted query."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pinweave.llm import periods, registry
from pinweave.llm.suffixes import common_prefixes, suffix_array, tree


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=6, exponent=4):
    """Every period's maximal stretches; those that a smaller period has, too, are left out."""
    out, n = {}, len(w)
    for q in range(1, n // max(exponent, 1) + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and not any(q % p == 0 for p in out.get((i, j + q), ())):
                out.setdefault((i, j + q), []).append(q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), qs in out.items() for q in qs)


def found(texts, least=6, exponent=4):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    words, at, (start, length, period), collapsed = periods.measure(np.frombuffer(b"".join(data), np.uint8), offsets, least, exponent)
    rows = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    return words.tolist(), [rows[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], collapsed.to_pylist()


def brute_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40), min_size=1, max_size=4), st.integers(2, 4))
def test_runs_of_small_texts(texts, exponent):
    texts = [" ".join(t) for t in texts]
    words, runs, collapsed = found(texts, 2, exponent)
    for text, n, own, rest in zip(texts, words, runs, collapsed, strict=True):
        w = words_of(text)
        assert n == len(w) and own == brute_runs(w, 2, exponent) and rest == brute_collapsed(w, own)


def test_blocks_of_many_sizes():
    rng = np.random.default_rng(5)
    texts = []
    for k in range(60):
        w = [f"w{x}" for x in rng.integers(0, 30, 150)]
        for _ in range(4):
            p, at, n = int(rng.integers(1, 12)), int(rng.integers(0, 120)), int(rng.integers(4, 80))
            w[at:at] = [w[(at + i % p) % len(w)] for i in range(n)]
        texts.append("\t".join(w) + " " * (k % 3))
    words, runs, collapsed = found(texts)
    for text, own, rest in zip(texts, runs, collapsed, strict=True):
        assert own == brute_runs(words_of(text)) and rest == brute_collapsed(words_of(text), own)
    assert sum(map(len, runs)) > 100


def test_suffix_tree():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, 400)
    end = np.full(400, 400)
    order, rank = suffix_array(keys, end)
    plain = sorted(range(400), key=lambda i: keys[i:].tolist())
    assert order.tolist() == plain and (order[rank] == np.arange(400)).all()
    lcp = common_prefixes(keys, order)
    for k in range(1, 400):
        a, b = keys[order[k - 1] :], keys[order[k] :]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        assert lcp[k] == (differ[0] if len(differ) else n)
    nodes = tree(lcp)
    inner = {(lcp[k], max([j for j in range(k) if lcp[j] < lcp[k]]), min([j for j in range(k, 400) if lcp[j] < lcp[k]], default=400)) for k in range(1, 400) if lcp[k] > 0}
    assert {(nodes.depth[k], nodes.lo[k], nodes.hi[k]) for k in set(nodes.parent.tolist())} == inner


def test_one_word_over_and_over():
    """Two million equal words: one run, and time and memory that go with the words."""
    import resource
    import time

    n = 2_000_000
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    _, runs, collapsed = found(["a " * n])
    assert runs == [[(0, n, 1)]] and collapsed == ["a"]
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a " * 9, "x"), (3, "a b " * 4, "x"), (3, "a b " * 4, "x"), (4, " \t\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(map(str, periods.periodic_runs(docs).collect()))
    assert len(got) == 6 and sum("length=9" in g for g in got) == 1 and sum("period=2" in g for g in got) == 2
    out = {r.doc_id: r for r in periods.digest(periods.periodic_runs(docs)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[1].n_runs == 0 and out[1].start is None and out[1].runs_sha256 == empty == out[1].collapsed_sha256
    assert (out[3].n_runs, out[3].start, out[3].length, out[3].period, out[3].exponent_milli) == (1, 0, 8, 2, 4000)
    assert periods.digest(periods.periodic_runs(docs.limit(0))).count() == 0
    assert periods.planted(docs).count() == 6


def test_longest_by_exact_fractions(spark):
    df = spark.createDataFrame([(1, 9, [(0, 9, 2), (20, 13, 3), (40, 9, 2)], "")], "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    row = periods.digest(df).first()
    assert (row.start, row.length, row.period, row.exponent_milli) == (0, 9, 2, 4500)


@pytest.fixture(scope="module")
def query(spark, sf_dir):
    return registry.QUERIES["op11_runs"](spark, sf_dir).collect()


def test_query_against_brute_force(query, spark, sf_dir):
    docs = {r.doc_id: r.text for r in registry.table(spark, sf_dir, "documents").collect()}
    assert len(query) == len(docs)
    some = 0
    for r in query:
        w = words_of(docs[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        assert r.n_runs == len(runs)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
        if runs:
            from fractions import Fraction

            a, b, c = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (a, b, c, 1000 * b // c)
            some += 1
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert some
