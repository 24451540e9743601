"""The training-data operators against brute force, on small fixtures with the odd cases."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pinweave.llm import components, decontamination, passages, pieces, pii, registry, repetition, simhash, tools, toxicity, urls, wavelet, words

WORDS = "the of and to in é ß 漢字 data, model. train #1 x&y".split()
ODD = [None, "", " ", "\n\n", "one", "a b c d", "a b c d", "A B C D", "ﬁ\u00a0x\u2003y", "\x00 \x01\x1f z"]


def texts(seed=1, n=30):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) + rng.choice(["", "\n", "\n\nthe end.\nthe end.\n"]) for _ in range(n)]
    return [*ODD, *out, out[0], out[0], "long " * 3000, "x" * 5000, " ".join(f"w{i}" for i in range(400)) * 2]


def docs(spark, rows):
    """With columns whose names clash with those that operators make."""
    data = [(i, t, "en", i, i, "y") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, score string, fp long, start long, `n words` string").repartition(3)


def empty(spark):
    return docs(spark, ["x"]).where("false")


def no_id(spark, rows):
    return spark.createDataFrame([(None, t) for t in rows], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# words
@given(st.lists(st.text(alphabet=" \t\nabé漢.,'#12\x1f\xa0", max_size=30), max_size=6), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_spans_are_the_pattern_s_matches(rows, limit):
    found, all_hashes = [], {}
    for s in words.slices(pa.array(rows, pa.string()), limit):
        starts, ends = words.spans(s.buf, s.offsets, words.BLANK)
        first = words.per_document(starts, s.offsets)
        h = words.hashes(s.buf, starts, ends)
        for i in range(s.hi - s.lo):
            own = [bytes(s.buf[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
            found.append(own)
            for w, x in zip(own, h[first[i] : first[i + 1]]):
                assert all_hashes.setdefault(w, x) == x
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in rows]
    assert len(set(all_hashes.values())) == len(all_hashes)


def test_table_keeps_ids_while_it_grows():
    rng = np.random.default_rng(0)
    table, seen = words.Table(2), {}
    for _ in range(20):
        h = rng.integers(1, 500, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ids, _ = table.ids(h)
        for x, i in zip(h.tolist(), ids.tolist()):
            assert seen.setdefault(x, i) == i
    assert sorted(seen.values()) == list(range(len(seen)))


# 1
def repetition_of(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    longest = 0
    for n in range(1, len(w) + 1):
        if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) == len(w) - n + 1:
            break
        longest = n
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), longest


def test_repetition(spark):
    rows = texts()
    got = by_id(repetition.repetition(docs(spark, rows)))
    for i, t in enumerate(rows):
        r, e = got[i], repetition_of(t) if t is None or len(t) < 10000 else None
        if e:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) == e
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.longest_repeat <= repetition.MAX_LONGEST)
    assert repetition.repetition(empty(spark)).count() == 0
    assert repetition.repetition(no_id(spark, ["a", "a"])).count() == 2


def test_a_long_repeat_in_a_longer_text_is_rejected(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    filler = [" ".join(f"f{j}x{i}" for i in range(400)) for j in range(3)]
    r = by_id(repetition.repetition(docs(spark, [f"{filler[0]} {passage} {filler[1]} {passage} {filler[2]}", " ".join(filler)])))
    assert not r[0].base_failed and not r[0].kept and r[0].longest_repeat == 60
    assert r[1].kept


# 2
PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii_of(t):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) % 10 + int(c) // 5 for i, c in enumerate(d[::-1])) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


PERSONAL = [
    "a@b.com%c@d.org", "x a@b.com.c@d.org ", "a@b.c.", "1.2.3.4.5.6.7.8", "999.1.2.3 1..2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112", "+1 (743) 555-3824 +49 30 1234567890123456",
    "é😀 a@b.co é 10.0.0.1", "001.002.003.0004", "a" * 3000 + "@" + "b." * 3000 + "c", "1" * 5000, "1." * 3000, "+" * 2000 + "1", "😀" * 10 + "+123456789",
]


def test_pii(spark):
    rng = random.Random(4)
    rows = ODD + PERSONAL + ["".join(rng.choices("a1.2@+- 9()b", k=60)) for _ in range(300)]
    for i, r in by_id(pii.pii(docs(spark, rows))).items():
        e = pii_of(rows[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in e) for k, _ in PATTERNS], rows[i]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in e)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans.startswith(listed)
    assert pii.pii(empty(spark)).count() == 0


def test_checksums_and_context(spark):
    rows = ["GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "DE89370400440532013000", "my card 378282246310005", "number 378282246310005", None, "a@b.co and a@b.co 10.0.0.1"]
    got = by_id(pii.pii(docs(spark, rows)))
    assert [got[i].spans for i in range(5)] == ["iban:0:27", "", "iban:0:22", "short_card:8:23", ""]
    masked = by_id(pii.mask(docs(spark, rows)))
    assert masked[0].text == "<IBAN>" and masked[5].text is None and masked[6].text == "<EMAIL> and <EMAIL> <IP>"
    assert masked[6].score == "en"


def test_context_words_count_over_numbers_in_between(spark):
    rows = ["Amex card exp 12/27: 378282246310005", "card 12 34/56" + " " * 30 + "378282246310005", "😀 card 12/27: 378282246310005 and 12/27: 378282246310005"]
    frame = docs(spark, rows)
    got, masked = by_id(pii.pii(frame)), by_id(pii.mask(frame))
    assert [got[i].spans for i in range(3)] == ["short_card:21:36", "", "short_card:14:29,short_card:41:56"]
    assert masked[0].text == "Amex card exp 12/27: <SHORT_CARD>"


# 3
def test_toxicity_learns_and_does_not_look_at_held_out_rows(spark):
    rng = random.Random(2)
    rows, label = [], []
    for i in range(1500):
        bad = rng.random() < 0.3
        w = rng.choices([f"w{k}" for k in range(300)], k=40)
        if bad:
            w[rng.randrange(40)] = rng.choice(["awful", "nasty"])
        rows.append(" ".join(w))
        label.append(int(bad))
    rows += ODD
    labels = spark.createDataFrame([(i, 0, x) for i, x in enumerate(label)] + [(1, 1, label[1]), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows)
    weights = toxicity.train(frame, labels)
    got = by_id(toxicity.score(frame, weights))
    assert len(got) == len(rows)
    held = [i for i in range(1500) if crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values() if r.doc_id < 1500) == len(held)
    assert sum(got[i].predicted == label[i] for i in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1500].score == got[1501].score
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.train(frame, flipped) == weights
    kept = toxicity.reject(frame, weights)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert toxicity.train(empty(spark), labels)[0] == []
    assert {r.score for r in toxicity.score(frame, ([], [])).collect()} == {0.5}


# 4
def contamination_of(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        q = cut(t)
        n = min(window, len(q))
        for i in range(len(q) - n + 1 if q else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == q[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [10**6, 5])
def test_contamination(spark, block):
    rng = random.Random(7)
    pool = "q w e r t y é".split()
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 3, 9, 10, 12, 30])))) for i in range(12)] + [(12, None), (13, ""), (14, "..."), (15, "q W e"), (15, "q W e")]
    rows = ODD + [" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(40)] + ["pre " + items[k][1].upper().replace(" ", ", ") + " post" for k in range(12)] + ["q w e", "q w", "q w e", "w e q"]
    frame, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(frame, 64)
    from pyspark.sql import functions as F

    found = decontamination.phrases(index, bench, block_words=block)
    got = by_id(found.select("doc_id", "n_words", decontamination.covered_words("hits").alias("n_hit"), F.array_sort("items").alias("items")))
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        e = contamination_of(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, len(r["items"])) == e[:3], t
        assert hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == e[3]
    if block > 5:
        own = by_id(decontamination.contamination(frame, bench))
        assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contamination_of(rows[i], items) for i, r in own.items())
        clean = decontamination.clean(frame, bench)
        assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {i for i, r in own.items() if not r.contaminated}
        assert not by_id(decontamination.contamination(frame, bench.where("false")))[20].contaminated
        assert decontamination.contamination(empty(spark), bench).count() == 0


def test_proximity(spark):
    frame = docs(spark, ["zeta yes alpha b c beta d gamma", "alpha " + "b " * 50 + "beta gamma zeta", "nothing"])
    items = spark.createDataFrame([(7, "alpha beta gamma zeta")], "item_id long, text string")
    found = decontamination.near(decontamination.build_index(frame), items, terms=4, within=10).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, "7")}


# 5
def test_tool_calls(spark):
    calls = [(1, 5, "c", "f", '{"b":1,"a":"x"}', ["a", "b"]), (1, 1, "a", "f", '{"a":"x"}', []), (1, 2, "b", "f", '{"a":3}', ["a"]), (1, 7, "x", "g", "[1]", ["y"]), (1, 8, "y", "f", "bad", ["x"]), (1, 9, "z", "f", '{"a":"x"}', ["x"])]
    calls += [(2, 1, None, "f", '{"a":"q","z":null}', None), (2, 2, "d", "f", '{"a":"q","b":1.5}', ["nope"]), (2, 3, "d", "f", '{"a":"q"}', None), (None, 1, "e", "f", None, None)]
    results = [(1, 2, "a", "ra"), (1, 9, "a", "rb"), (2, 9, "d", "rd"), (3, 1, "q", "lost"), (1, 1, None, "n")]
    schemas = tools.schema_table(spark, (("f", "a", "string", True), ("f", "b", "number", False)))
    frame = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>")
    answers = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.turn): r for r in tools.link(frame, answers, schemas).collect()}
    assert len(got) == len(calls)
    assert {k: r.level for k, r in got.items()} == {(1, 1): 0, (1, 2): 1, (1, 5): 2, (1, 7): None, (1, 8): None, (1, 9): None, (2, 1): None, (2, 2): 0, (2, 3): 0, (None, 1): None}
    assert {k for k, r in got.items() if r.valid} == {(1, 1), (1, 5), (1, 9), (2, 2), (2, 3)}
    assert got[1, 5].json == '{"arguments":"{\\"a\\":\\"x\\",\\"b\\":1}","id":"c","level":2,"name":"f","result":null,"valid":true}'
    assert got[1, 1].n_results == 2 and '"result":"ra"' in got[1, 1].json
    assert tools.link(frame.where("false"), answers, schemas).count() == 0


def test_levels_of_long_chains_and_joints(spark):
    deep = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)]
    rng = random.Random(1)
    mixed = [(2, f"m{i}", [f"m{rng.randrange(i)}" for _ in range(rng.randint(0, 3))] if i else []) for i in range(60)]
    circle = [(3, "a", ["c"]), (3, "b", ["a"]), (3, "c", ["b"]), (3, "d", ["c"]), (3, "e", ["d", "f"]), (3, "f", [])]
    frame = spark.createDataFrame(deep + mixed + circle, "conv_id long, call_id string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in tools.levels(frame).collect()}
    expected = {}
    for c, x, needs in deep + mixed:
        expected[c, x] = max((expected[c, n] + 1 for n in needs), default=0)
    assert got == expected | {(3, "f"): 0}


# 6
def test_chain_is_optimal_on_small_inputs():
    rng = random.Random(9)
    for _ in range(200):
        n, k, gap = rng.randint(1, 8), 3, 0.1
        points = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(n)})
        x, y = [p[0] for p in points], [p[1] for p in points]
        found = passages.chain(x, y, k, gap)
        for first, last in found:
            assert first == last or x[first] < x[last] and y[first] < y[last]
        assert len({m for pair in found for m in pair}) <= len(points)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = [[rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, u in enumerate(a):
            for j, v in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
        assert passages.common(a, b) == t[-1][-1]


def test_passages(spark):
    rng = random.Random(6)
    fresh = iter(range(10**6))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    passage, other = unique(80), unique(60)
    fuzzy = [w if i % 17 else f"v{next(fresh)}" for i, w in enumerate(passage)]
    rows = [unique(30) + passage + unique(40), unique(5) + passage, fuzzy + unique(90), unique(200), unique(20) + other[:30] + unique(20), unique(20) + other[:30], other, other, unique(10) + passage + unique(10) + other]
    rows += [unique(rng.randint(1, 60)) for _ in range(20)]
    rows = [" ".join(r) for r in rows]
    frame = docs(spark, [*rows, *ODD])
    found = passages.repeated_passages(frame).collect()
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append((r.start, r.end))
    assert set(spans) == {0, 1, 2, 6, 7, 8}
    assert spans[0] == [(30, 110)] and spans[1] == [(5, 85)] and spans[6] == spans[7] == [(0, 60)]
    assert sorted(spans[8]) == [(10, 90), (100, 160)]
    (s,) = spans[2]
    assert s[0] <= 2 and abs(s[1] - 80) <= 2
    assert {r.class_id for r in found} == {0}
    assert passages.repeated_passages(empty(spark)).count() == 0
    assert passages.repeated_passages(no_id(spark, [rows[0], rows[0]])).count() == 0
    assert passages.repeated_passages(frame.where("doc_id = 0").unionByName(frame.where("doc_id = 0"))).count() == 0


def test_a_passage_whose_seeds_meet_different_documents(spark):
    """The first words' seeds pair with one document, the last words' with another; neither shows the whole."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    for trial in range(3):
        unique = lambda n: [f"q{rng.getrandbits(60)}" for _ in range(n)]
        rows = [passage[: 40 + trial] + unique(20), unique(30) + passage[-35:] + unique(9), unique(15) + passage + unique(25), unique(40) + passage + unique(5)]
        found = passages.repeated_passages(docs(spark, [" ".join(r) for r in rows]).repartition(4)).collect()
        assert {(r.doc_id, r.start, r.end) for r in found} == {(2, 15, 75), (3, 40, 100)}


def test_a_passage_that_many_share_gives_pairs_in_proportion(spark):
    passage = " ".join(f"s{i}" for i in range(70))
    rows = [f"{' '.join(f'x{d}y{i}' for i in range(20))} {passage}" for d in range(300)]
    found = passages.sketch(docs(spark, rows).select("doc_id", "text"), passages.Rule())
    seeds = found.where("hub is null").select("seed").distinct().count()
    assert passages.matches(found).count() <= 2 * 300 * seeds
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(300)) and {(r.start, r.end) for r in got} == {(20, 90)}


@pytest.mark.parametrize("partitions", [1, 5])
def test_equal_passages_are_found_whoever_else_has_parts(spark, partitions):
    """Each document's places in runs of 50 words that another document has, in one slice and in several."""
    rng = random.Random(21)
    unique = lambda n: [f"q{rng.getrandbits(60)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(60)]
    rows = [passage[:40] + unique(20), unique(30) + passage[-35:] + unique(9), unique(15) + passage + unique(25), unique(40) + passage + unique(5)]
    for t in range(40):
        long = [f"t{t}w{i}" for i in range(rng.randint(50, 90))]
        for _ in range(4):
            a = rng.randint(0, len(long) - 30)
            cut = long[a : a + rng.randint(30, 90)]
            rows.append(unique(rng.randint(0, 9)) + cut + unique(30) + (cut if rng.random() < 0.2 else []))
        rows += [unique(3) + long, long[:50] + unique(4)]
    runs = defaultdict(set)
    for d, r in enumerate(rows):
        for i in range(len(r) - 49):
            runs[tuple(r[i : i + 50])].add(d)
    expected = {(d, i + j) for d, r in enumerate(rows) for i in range(len(r) - 49) if len(runs[tuple(r[i : i + 50])]) > 1 for j in range(50)}
    frame = spark.createDataFrame([(d, " ".join(r)) for d, r in enumerate(rows)], "doc_id long, text string").coalesce(1)
    found = passages.repeated_passages(frame if partitions == 1 else frame.repartition(partitions)).collect()
    assert {(2, 15, 75), (3, 40, 100)} <= {(r.doc_id, r.start, r.end) for r in found}
    assert {(r.doc_id, i) for r in found for i in range(r.start, r.end)} == expected


def extended(a, b, penalty=1, drop=10):
    """What passages.extend gives, a row at a time."""
    n, m = len(a), len(b)
    i = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    best, taken, at, edits = float(i), (i, i), 0, 0
    front, ends = {0: i}, [i == n, i == m]
    while front:
        edits += 1
        after, top = {}, best
        for k in range(min(front) - 1, max(front) + 2):
            i = max(front.get(k, -2) + 1, front.get(k - 1, -2) + 1, front.get(k + 1, -1))
            j = i - k
            if i < 0 or j < 0:
                continue
            if i > n or j > m:
                i = min(n, m + k)
                j = i - k
                if i < 0 or j < 0 or i < front.get(k + 1, 0):
                    continue
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            ends = [ends[0] or i == n, ends[1] or j == m]
            score = (i + j) / 2 - (1 + penalty) * edits
            if score < best - drop or i == n and j == m and score <= best:
                continue
            after[k] = i
            if score > top:
                top, taken, at = score, (i, j), edits
        best, front = top, after
    return *taken, *ends, at


def sides(rows, step):
    size = np.array([len(r) for r in rows])
    start = np.cumsum(size) - size
    words = np.concatenate([np.array(r, np.int64) for r in rows] + [np.zeros(1, np.int64)])
    return passages.Side(words, start if step > 0 else start + size - 1, size, step)


def test_extension_crosses_gaps_and_clusters():
    a = list(range(60))
    tails = [(a[:10] + [-1] + a[10:], 61), (a[:10] + a[11:], 59), ([-1, -2, -3, -4] + a[4:], 60)]
    rows = [[*b, *range(-90, -50)] for b, _ in tails] + [[-1] * 60, []]
    u, v, *_ = passages.extend(sides([a] * 5, 1), sides(rows, 1))
    assert list(zip(u.tolist(), v.tolist(), strict=True)) == [(60, taken) for _, taken in tails] + [(0, 0), (0, 0)]


@pytest.mark.parametrize("step", [1, -1])
@pytest.mark.parametrize("rule", [(1, 10), (1, 4), (4, 40)])
def test_extension_of_many_rows_is_that_of_each(step, rule):
    rng = random.Random(41)
    left, right = [], []
    for _ in range(400):
        words = rng.choice([3, 6, 40, 1000])
        a = [rng.randrange(words) for _ in range(rng.randint(0, 90))]
        b = a[: rng.randint(0, len(a))] if rng.random() < 0.4 else list(a)
        for _ in range(rng.randint(0, 8)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = [rng.randrange(1000)] * rng.randint(0, 1)
        left.append(a)
        right.append(b)
    got = [np.asarray(c).astype(int).tolist() for c in passages.extend(sides(left, step), sides(right, step), *rule)]
    assert [tuple(r) for r in zip(*got, strict=True)] == [tuple(map(int, extended(a[::step], b[::step], *rule))) for a, b in zip(left, right, strict=True)]


def test_passages_with_one_common_run(spark):
    """An inserted word, replaced words next to the run, and a passage far longer than what is fetched at first."""
    rng = random.Random(31)
    unique = lambda n: [f"q{rng.getrandbits(60)}" for _ in range(n)]
    # Every sixth word replaced: no six words in a row are equal, except in the run.
    fuzzy = lambda p, a, z: [w if a <= i < z or i % 6 else unique(1)[0] for i, w in enumerate(p)]
    short, near, long = unique(61), unique(61), unique(601)
    inserted = fuzzy(short, 1, 19)
    inserted[28:28] = unique(1)
    cluster = near[:19] + unique(4) + fuzzy(near[23:], 0, 0)
    pairs = [(short, inserted), (near, cluster), (long, fuzzy(long, 290, 310))]
    rows = [" ".join(unique(100) + text + unique(100)) for pair in pairs for text in pair]
    found = {r.doc_id: (r.start, r.end) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    for i, pair in enumerate(pairs):
        for j in range(2):
            start, end = found[2 * i + j]
            assert abs(start - 100) <= 6 and abs(end - 100 - len(pair[j])) <= 6


# 7
@given(st.lists(st.integers(0, 40), max_size=600))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(values):
    m = wavelet.WaveletMatrix.build(np.array(values, np.uint16), 6)
    assert m.values().tolist() == values
    for i in range(0, len(values), 7):
        assert m.access(i) == values[i] and m.rank(values[i], i) == values[:i].count(values[i]) and m.select(values[i], values[:i].count(values[i])) == i
    for x in (0, 3, 40, 63, 64):
        assert m.occurrences(x) == [i for i, v in enumerate(values) if v == x]


BPE = ODD + [
    "a  b", "a   b", "a \n b", "a\n \nb", "a  \nb", "x\n\ny", "don't 'this we'll!", "'s's 's", "é.è,É! ×.÷", "<|endoftext|> x", "a\r\nb\t\tc", "1234,56.7 8", "漢字。かな", "½.x", "...!?  ...", " lead", "trail ", "😀😀 ok", "\u0085x \u2028y", "a\x1c b \x1fc", "it''s 'd'",
]


def test_chunked_encoding_is_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    path = registry.vocabulary("byte_bpe_50k.json")
    rng = random.Random(8)
    rows = texts() + BPE + ["".join(rng.choices(" \n\t'.,ab1é漢sdt!\xa0", k=30)) for _ in range(400)]
    got = by_id(wavelet.documents(wavelet.write_shards(docs(spark, rows), path, shard_tokens=500, partitions=4)))
    plain, start = Tokenizer.from_file(path), 0
    for i, t in enumerate(rows):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    shards = wavelet.write_shards(docs(spark, ["the the", "of the"]), path)
    token = plain.encode(" the").ids[0]
    assert sum(r.n for r in wavelet.count_token(shards, token).collect()) == 2
    assert wavelet.documents(wavelet.write_shards(empty(spark), path)).count() == 0


# 8
def test_urls(spark):
    def judged(url, rules):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    rules = (*urls.RULES, ("block", "example.org", "/es/deep/"), ("allow", "a.example.org", "/"), ("block", "net", ""), ("block", "net", ""))
    rng = random.Random(3)
    rows = [None, "", "nohost", "://", "http://ORG/", "http://x.org.", "http://org", "http://examples.org/es/", "a://b://org/", "http://net?x", "http://net#/", "http://com/de/\n/x"]
    rows += [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'a.', 'b.a.', '.'])}{rng.choice(['example.org', 'org', 'com', 'net', 'example.com'])}{rng.choice(['/es/', '/es/deep/x', '/en/12', '/fr/', '/de/', '/', '', '?q=/', '#/de/'])}" for _ in range(200)]
    rows += ["http://" + "a." * 3000 + "org/x", "http://com/fr/" + "y" * 10000]
    data = [(i, u, "v", "h") for i, u in enumerate(rows)] + [(0, None, "v", "h"), (None, "http://com/de/", "v", "h")]
    pages = spark.createDataFrame(data, "page_id long, url string, verdict string, host string")
    got = urls.judge(pages, urls.rule_table(spark, rules)).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged("http://com/de/" if r.page_id is None else rows[r.page_id], rules)
    assert {r.verdict for r in urls.judge(pages, urls.rule_table(spark).where("false")).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), urls.rule_table(spark)).count() == 0


# 9
def test_pieces_are_the_library_s(spark):
    from sentencepiece import SentencePieceProcessor

    path = registry.vocabulary("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    rows = texts() + BPE + ["a▁b", " ▁ ", "abc<s>def</s><0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "            int main() {\n        return 0;\n}"] + ["".join(rng.choices(" \nabé漢the", k=25)) for _ in range(300)]
    frame = docs(spark, rows)
    encoded = pieces.encode(frame, path, slice_bytes=2000)
    got = by_id(encoded)
    assert all(list(got[i].ids) == sp.encode(t or "") for i, t in enumerate(rows))
    back = by_id(pieces.decode(encoded, path))
    assert all(back[i].text == sp.decode(sp.encode(t or "")) for i, t in enumerate(rows))
    trip = by_id(pieces.round_trip(frame, path))
    for i, t in enumerate(rows):
        ids = sp.encode(t or "")
        assert (trip[i].n_tokens, trip[i].ids_crc32, trip[i].round_trip) == (len(ids), crc32(np.array(ids, "<u4").tobytes()), "▁" not in (t or ""))
    assert pieces.round_trip(empty(spark), path).count() == 0


# 10
def fingerprint_of(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=300)).split() for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.004 else f"z{rng.random()}" for w in base[i % 6]) for i in range(60)]
    rows = texts() + near
    got = by_id(simhash.near_duplicates(docs(spark, rows)))
    fp = [fingerprint_of(t) for t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 4 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert [(got[i].fingerprint, got[i].component_id) for i in range(len(rows))] == [(f"{fp[i]:016x}", root[i]) for i in range(len(rows))]
    kept = simhash.representatives(docs(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(root) and kept.columns == docs(spark, rows).columns
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(no_id(spark, ["a", "a"])).count() == 2


@pytest.mark.parametrize("parts", [2, 3])
def test_every_near_pair_meets_at_a_home(parts):
    rng = np.random.default_rng(parts)
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 5), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in x], np.uint64)
    y = x ^ flips
    home = simhash.homes(x, parts)
    met = np.zeros(len(x), bool)
    for k, i, anchor in simhash.copies(y, parts):
        met[i[anchor == home[k][i]]] = True
    assert met.all()


def test_links_of_a_hot_anchor_are_split_and_still_join(spark):
    rng = random.Random(0)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(800)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    frame = spark.createDataFrame(signed, "fp long")
    found = simhash.links(frame, 3, hot=50)
    assert found.count() < len(fps) ** 2 / 8
    roots = components.components(found)
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(fps)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


def test_results_that_no_call_takes(spark):
    """Orphans, null identifiers, repeated and late results; with the linked ones they are all results that came in."""
    from pinweave.llm import tools

    calls = spark.createDataFrame([(1, 1, "a", "respond", "{}", None), (1, 3, "b", "respond", "{}", ["a"]), (1, 5, "b", "respond", "{}", None), (2, 1, None, "respond", "{}", None), (None, 1, "a", "respond", "{}", None)], "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>")
    rows = [(1, 2, "a", "x"), (1, 2, "a", "x"), (1, 9, "a", "late"), (1, 2, "b", None), (1, 4, "b", "y"), (1, 4, "z", "none"), (2, 2, "a", "other"), (2, 2, None, "null"), (2, 2, None, "null"), (None, 2, "a", "no conversation")]
    results = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, call_id string, content string, n long")
    got = sorted((tuple(r) for r in tools.unmatched(calls, results).collect()), key=str)
    assert got == sorted([(1, 2, "a", "x", "repeated", 1), (1, 9, "a", "late", "repeated", 1), (1, 4, "b", "y", "repeated", 1), (1, 4, "z", "none", "no call", 1), (2, 2, "a", "other", "no call", 1), (2, 2, None, "null", "no call", 2), (None, 2, "a", "no conversation", "no call", 1)], key=str)
    taken = tools.linked(calls, results).where("n_results > 0").select("conv_id", "call_id").distinct().count()
    assert taken + sum(r[-1] for r in got) == len(rows)
    assert tools.unmatched(calls.limit(0), results.limit(0)).count() == 0
    assert sum(r.n for r in tools.unmatched(calls.limit(0), results).collect()) == len(rows)


def test_calls_are_never_broadcast(spark, sf_dir):
    from pinweave.llm import registry, tools

    calls, _ = tools.exchanges(registry.table(spark, sf_dir, "conversations"))
    plan = tools.validated(calls, tools.schema_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "BuildRight" in plan


@pytest.mark.parametrize("partitions", [1, 6])
def test_fuzzy_passages_are_found_whoever_else_has_their_seeds(spark, partitions):
    """Four smaller documents hold parts of 20 words; the passage has no run of 50 equal words, nor its seeds a common partner."""
    rng = random.Random(51)
    unique = lambda n: [f"q{rng.getrandbits(60)}" for _ in range(n)]
    passage = unique(80)
    fuzzy = [w if i % 20 != 19 else unique(1)[0] for i, w in enumerate(passage)]
    parts = [unique(9) + passage[a : a + 20] + unique(9) for a in range(0, 80, 20)]
    # Two documents of a class whose second passage is with neither's first partner.
    one, two = unique(60), unique(80)
    other = [w if i % 20 != 19 else unique(1)[0] for i, w in enumerate(two)]
    parts += [unique(9) + two[a : a + 20] + unique(9) for a in range(0, 80, 20)]
    rows = [*parts, unique(15) + passage + unique(25), unique(40) + fuzzy + unique(5), unique(3) + one + unique(30) + two, one + unique(40) + other + unique(9)]
    frame = docs(spark, [" ".join(r) for r in rows]).select("doc_id", "text").coalesce(1)
    found = passages.repeated_passages(frame if partitions == 1 else frame.repartition(partitions)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.n_links, r.class_id) for r in found) == [(8, 15, 94, 1, 8), (9, 40, 119, 1, 8), (10, 3, 63, 1, 10), (10, 93, 172, 1, 10), (11, 0, 60, 1, 10), (11, 100, 179, 1, 10)]


def test_what_is_around_a_seed_bounds_what_is_common():
    rng, rule, seen = random.Random(52), passages.Rule(), 0
    for n in range(300):
        seed = rng.randint(0, 44)
        a = [rng.randrange(40) for _ in range(50)]
        edits, b, at = set(rng.sample([i for i in range(50) if not seed <= i < seed + 6], 10)), [], 0
        for i, w in enumerate(a):
            at = len(b) if i == seed else at
            b += [w] if i not in edits else [[], [1000 + i]][rng.randrange(2)]
        assert passages.common(a, b) >= 40
        rows = [[rng.randrange(2000, 9000) for _ in range(70 * side)] + t + [rng.randrange(2000, 9000) for _ in range(n % 3 * 30)] for side, t in ((1, a), (0, b))]
        counts = np.array([len(r) for r in rows])
        near = passages.around(np.array(sum(rows, []), np.int16), np.cumsum(counts) - counts, counts, np.arange(2), np.array([70 + seed, at]), rule)
        assert passages.may_link(passages.bit_sets(near, rule), np.array([0]), np.array([1]), rule).all()
