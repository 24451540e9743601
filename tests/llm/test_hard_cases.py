"""Cases that strain the operators: words made to collide in weak hashes, very many matches, crowded anchors, hubs."""

import random
import re

import numpy as np
import pytest

from pinweave.llm import components, decontamination, pieces, pii, registry, repetition, simhash, wavelet, words
from tests.llm.test_operators import by_id, docs, fingerprint_of, pii_of, repetition_of, texts


def morse(n, letters="ab"):
    """Two words of n letters that no polynomial modulo a power of two tells apart, for n of 1,024 or more."""
    one = "".join(letters[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans(letters, letters[::-1]))


MORSE = [w for n in (1024, 2048, 4096) for w in morse(n)]


def test_words_of_one_size_have_their_own_hashes():
    rows = MORSE + ["a" * n for n in range(1, 300)] + ["a" * n + "b" for n in range(1, 300)]
    buf = np.frombuffer(" ".join(rows).encode(), np.uint8)
    starts, ends = words.spans(buf, np.array([0, len(buf)]), words.BLANK)
    assert len(set(words.hashes(buf, starts, ends).tolist())) == len(rows)
    assert words.same_bytes(buf, starts, buf, starts, ends - starts).all()
    assert not words.same_bytes(buf, starts[:-1], buf, starts[1:], np.minimum(ends - starts, 1024)[:-1])[:5:2].any()


def test_colliding_words_in_repetition(spark):
    rows = [f"{a}\n{b}\n" + " ".join(f"w{i}" for i in range(10)) for a, b in zip(MORSE[::2], MORSE[1::2])]
    rows += [" ".join(f"{a} x y z {b} x y z".split()) for a, b in zip(MORSE[::2], MORSE[1::2])]
    for i, r in by_id(repetition.repetition(docs(spark, rows))).items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) == repetition_of(rows[i])


def test_colliding_words_in_decontamination(spark):
    items = spark.createDataFrame([(0, MORSE[0]), (1, f"{MORSE[2]} b c")], "item_id long, text string")
    got = by_id(decontamination.contamination(docs(spark, [MORSE[0], MORSE[1], f"{MORSE[3]} b c", f"x {MORSE[2]} b c"]), items))
    assert [got[i].n_hit for i in range(4)] == [1, 0, 0, 3]


@pytest.mark.parametrize("weak", [False, True])
def test_colliding_chunks_are_encoded_as_the_libraries_do(spark, monkeypatch, weak):
    """Also with a hash that has but a few values, where nearly all that is looked up is another chunk's."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    import pyarrow as pa

    rows = [*MORSE, *(t or "" for t in texts(n=6)), *MORSE]
    if weak:
        for m in (wavelet, pieces):
            monkeypatch.setattr(m, "hashes", lambda buf, starts, ends: (words.hashes(buf, starts, ends) & np.uint64(7)) + np.uint64(1))
    plain, library = Tokenizer.from_file(registry.vocabulary("byte_bpe_50k.json")), SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model"))
    bpe, piece = wavelet.ByteBpe(registry.vocabulary("byte_bpe_50k.json")), pieces.Pieces(registry.vocabulary("piece_bpe_32k.model"))
    for encoder, own in ((bpe, lambda t: plain.encode(t, add_special_tokens=False).ids), (piece, library.encode)):
        for s in words.slices(pa.array(rows), 3000):
            ids, counts = encoder.encode(s)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own(t) for t in rows[s.lo : s.hi]]


def test_encoders_forget_beyond_their_limit():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = registry.vocabulary("byte_bpe_50k.json")
    plain, bpe = Tokenizer.from_file(path), wavelet.ByteBpe(path)
    bpe.known.limit = 200_000
    for k in range(30):
        t = " ".join(f"word{k}x{i}" for i in range(500))
        (s,) = words.slices(pa.array([t]))
        assert bpe.encode(s)[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    assert bpe.known.table.size < 3 * 500 + 200_000 // 16


def masked(t):
    """The text with each span of the base kinds replaced, a span that begins inside one before left out."""
    out, at = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in pii_of(t)):
        if start >= at:
            out += [t[at:start], f"<{kind.upper()}>"]
        at = max(at, stop)
    return "".join(out) + t[at:]


def test_texts_with_very_many_matches(spark):
    """More matches than a block of sums, and texts longer than a block of characters, against the plain rule."""
    rng = random.Random(3)
    some = ["a@b.co", "10.0.0.1", "999.1.1.1", "4111 1111 1111 1111", "+49 30 123456", "é😀", "word", "1234", "-", "a@b.co10.0.0.1"]
    rows = [" ".join(rng.choices(some, k=k)) for k in (3, 127, 128, 129, 600, 3000)] + ["x" * 1024 + " a@b.co", "y" * 1023 + " a@b.co " + "z" * 2048 + " +1 2345678", "a@b.co " * 20_000]
    frame = docs(spark, rows)
    got, hidden = by_id(pii.pii(frame)), by_id(pii.mask(frame))
    for i, t in enumerate(rows):
        e = pii_of(t)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[0] == k for x in e) for k in ("email", "ip", "card", "phone")]
        assert ",".join(x for x in got[i].spans.split(",") if x.split(":")[0] in ("email", "ip", "card", "phone")) == ",".join(f"{k}:{a}:{b}" for k, a, b in e)
        if not re.search("iban|short_card", got[i].spans):
            assert hidden[i].text == masked(t)


def test_context_words_reach_over_many_short_numbers(spark):
    rows = ["card " + "12 " * 11 + " 378282246310005", "card " + "12 " * 20 + " 378282246310005", "Amex:\n" + "1-2, " * 6 + "378282246310005"]
    got = by_id(pii.pii(docs(spark, rows)))
    for i, t in enumerate(rows):
        at = t.index("378282246310005")
        assert ("short_card" in got[i].spans) == bool(re.search("card|amex", t[max(0, at - 40) : at].lower()))


def brute_components(rows):
    fp = [fingerprint_of(t) for t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    return fp, root


def test_both_coverings_give_the_same_components(spark):
    rng = random.Random(15)
    base = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=200)).split() for _ in range(4)]
    rows = [" ".join(w if rng.random() > 0.006 else f"z{rng.random()}" for w in base[i % 4]) for i in range(40)] + ["", None, "a"]
    fp, root = brute_components(rows)
    for parts in (2, 3):
        got = by_id(simhash.near_duplicates(docs(spark, rows), parts=parts))
        assert [(got[i].fingerprint, got[i].component_id) for i in range(len(rows))] == [(f"{fp[i]:016x}", root[i]) for i in range(len(rows))]


def test_an_anchor_over_many_batches_and_splits(spark):
    """One crowd of fingerprints, so that an anchor's homes and copies come in many batches, and its grid has many cells."""
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(600)} | {rng.getrandbits(63) for _ in range(50)}
    expected = {x: x for x in fps}
    for _ in range(20):
        for x in fps:
            low = min(expected[y] for y in fps if (x ^ y).bit_count() <= 4)
            expected[x] = low
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, gathered, hot in ((100, 150, 10_000), (64, 64, 40)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = simhash.links(frame, 3, hot=hot, gathered=gathered)
            pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()]
            assert all((a ^ b).bit_count() <= 4 and a != b for a, b in pairs)
            root = {x: x for x in fps}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
            assert {x: find(x) for x in fps} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_components_with_hubs_and_odd_links(spark):
    rng = random.Random(4)
    edges = [(7, i) for i in range(100, 900)] + [(i, 5000) for i in range(300, 1400)] + [(2000 + rng.randrange(60), 2000 + rng.randrange(60)) for _ in range(40)] + [(3, 3), (None, 4), (7, 100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    frame = spark.createDataFrame(edges, "a long, b long")
    for hubs in (1000, 10):
        assert {r.node: r.root for r in components.components(frame, hubs=hubs).collect()} == {x: find(x) for x in root}
    assert components.components(frame.where("false")).count() == 0


def test_many_places_of_a_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (7, 3), (511, 9), (512, 9), (513, 40), (5000, 60)):
        values = rng.integers(0, top, n)
        built = wavelet.WaveletMatrix.build(values.astype(np.uint16), 6)
        m = wavelet.WaveletMatrix(n, built.planes, [r.astype(np.uint32) for r in built.ranks])
        assert m.access_all(np.arange(n)).tolist() == values.tolist()
        lo, hi = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        asked = rng.integers(0, 64, 50)
        assert m.count_all(asked, lo, hi).tolist() == [int((values[a:b] == v).sum()) for v, a, b in zip(asked, lo, hi)]
        assert m.select(int(values[-1]), m.rank(int(values[-1]), n) - 1) == n - 1


def test_first_ids_come_from_access_and_rank(spark):
    from tokenizers import Tokenizer

    path = registry.vocabulary("byte_bpe_50k.json")
    plain, rows = Tokenizer.from_file(path), texts(n=8)
    shards = wavelet.write_shards(docs(spark, rows), path, shard_tokens=300, partitions=3)
    for i, r in by_id(wavelet.documents(shards)).items():
        ids = [*plain.encode(rows[i] or "", add_special_tokens=False).ids, 2]
        assert (r.first_id, r.n_first) == (ids[0], ids.count(ids[0]))
    assert {r.n for r in wavelet.count_token(shards, 10**6).collect()} == {0} and sum(r.n for r in wavelet.count_token(shards, 2).collect()) == len(rows)


def cut(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("segment", [1, 200, 1 << 20])
def test_proximity_is_the_same_in_every_segment(spark, segment):
    """Each document by its own words, rarity counted over all of them, against the plain rule."""
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(40)]
    rows = [" ".join(rng.choices(pool, weights=[40 - i for i in range(40)], k=rng.randint(0, 120))) for _ in range(40)] + [None, "", "w39 w38 w37", "W39, w38! w37"]
    items = [(i, " ".join(rng.sample(pool, rng.randint(1, 8))) + " nowhere") for i in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (28, "w39 w38 w37 w36")]
    count = {}
    for t in rows:
        for w in cut(t):
            count[w] = count.get(w, 0) + 1
    expected = set()
    for item, t in items:
        terms = sorted((w for w in dict.fromkeys(cut(t)) if w in count), key=count.get)[:4]
        for d, text in enumerate(rows):
            w = cut(text)
            for p, x in enumerate(w):
                if terms and x == terms[0] and all(y in w[max(0, p - 6) : p + 7] for y in terms):
                    expected.add((d, str(item), p))
    index = decontamination.build_index(docs(spark, rows), segment)
    found = decontamination.near(index, spark.createDataFrame(items, "item_id long, text string"), within=6)
    assert {tuple(r) for r in found.collect()} == expected and expected
    assert decontamination.near(decontamination.build_index(docs(spark, ["x"]).where("false"), segment), spark.createDataFrame(items[:2], "item_id long, text string")).count() == 0


def test_weights_and_scores_recomputed_by_a_plain_loop(spark):
    """FTRL-proximal one coordinate at a time, in dictionaries, on features hashed one word at a time."""
    import math

    from pyspark.sql import functions as F

    from pinweave.llm import toxicity

    rng = random.Random(6)
    rows = [" ".join(rng.choices([f"w{k}" for k in range(30)] + ["Bad", "AWFUL"] * (i % 3 == 0), k=rng.randint(0, 25))) for i in range(120)] + [None, "", "bad bad bad"]
    label = {i: int("bad" in (t or "").lower() or "awful" in (t or "").lower()) for i, t in enumerate(rows)}
    p = toxicity.Ftrl(l1=0.5, epochs=2)
    frame, labels = docs(spark, rows), spark.createDataFrame([(i, x) for i, x in label.items()], "doc_id long, toxic int")
    bucket, values = toxicity.train(frame, labels, p=p)

    def hashed(w):
        b = np.frombuffer(w.encode(), np.uint8)
        return words.hashes(b, np.array([0]), np.array([len(b)]))

    def buckets(t):
        h = [hashed(w) for w in cut(t)]
        out = [words.mix(x) for x in h]
        for gap, odd in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
            out += [words.mix(x * np.uint64(odd) + (y >> np.uint64(1)) + np.uint64(gap)) for x, y in zip(h, h[gap:])]
        return {int(x[0]) >> (64 - toxicity.BUCKET_BITS) for x in out}

    bias = 1 << toxicity.BUCKET_BITS
    z, n = {}, {}

    def weight(i):
        a, l1 = z.get(i, 0.0), 0.0 if i == bias else p.l1
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    used = frame.where(~toxicity.held_out()).withColumn("h", F.xxhash64("doc_id", F.lit(p.batch_seed))).orderBy("h").select("doc_id").collect()
    seen = [(buckets(rows[r.doc_id]) | {bias}, label[r.doc_id]) for r in used]
    order = np.random.default_rng(p.batch_seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(seen)):
            at, y = seen[k]
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(map(weight, at)))))) - y
            g *= p.positive if y else 1.0
            for i, w in [(i, weight(i)) for i in at]:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / p.alpha * w
                n[i] = old + g * g
    expected = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(bucket, values)).keys() == expected.keys() and all(abs(expected[i] - w) < 1e-9 for i, w in zip(bucket, values))
    for r in toxicity.score(frame, (bucket, values)).collect():
        total = sum(expected.get(i, 0.0) for i in buckets(rows[r.doc_id])) + expected.get(bias, 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_passages_are_the_same_for_every_split(spark, sf_dir):
    from pinweave.llm import passages

    table = registry.table(spark, sf_dir, "documents")
    found = [sorted(map(tuple, passages.repeated_passages(table.repartition(n)).select("doc_id", "class_id", "n_links").distinct().collect())) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2] and found[0]


def test_pipeline_on_odd_rows(spark, sf_dir):
    """Null and repeated ids, null and empty texts, further columns of clashing names, and an empty table."""
    import corpus_pipeline
    from pinweave.llm.shared import stored

    some = [r.text for r in registry.table(spark, sf_dir, "documents").orderBy("doc_id").limit(12).collect()]
    ids = [*range(12), 3, 3, None, None, 20, 21, 22, None]
    rows = [*some, some[3], "other words of the same id", "no id", "no id", None, "", "write to me at a@b.co", None]
    data = [(i, t, "en", "s", 7, 1.5, "x", "y") for i, t in zip(ids, rows)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, `n words` string")
    for start in (frame, frame.where("false")):
        docs_ = start
        for name, stage in corpus_pipeline.STAGES:
            after = stored(stage(spark, docs_, sf_dir))
            if name != "sentencepiece":
                assert after.columns == start.columns
                assert set(after.where("doc_id is null").select("source").distinct().collect()) == set(docs_.where("doc_id is null").select("source").distinct().collect())
            assert after.count() <= docs_.count()
            docs_ = after
        assert (docs_.count() > 8) == (start is frame)


@pytest.mark.parametrize("partitions", [1, 4])
def test_shared_seeds_are_those_of_several_documents(spark, partitions):
    from pinweave.llm import passages

    rng = np.random.default_rng(partitions)
    line = [f"l{i}" for i in range(20)]
    texts = [[f"w{rng.integers(5000)}" for _ in range(30)] + line * int(rng.integers(0, 4)) + [f"v{i % 3}"] * 10 * (i % 2) for i in range(40)]
    texts.append(["own"] * 60)
    frame = docs(spark, [" ".join(t) for t in texts]).repartition(partitions)
    found = passages.sketch(frame.select("doc_id", "text"), passages.Rule()).cache()
    rows = found.where("seed is not null").select("seed", "doc", "pos").collect()
    owners: dict[int, set[int]] = {}
    for r in rows:
        owners.setdefault(r.seed, set()).add(r.doc)
    want = sorted({(r.doc, r.pos) for r in rows if len(owners[r.seed]) > 1})
    assert want and len(want) < len({(r.doc, r.pos) for r in rows})
    assert sorted((r.doc, p) for r in passages.shared(found).collect() for p in r["at"]) == want


def test_texts_that_repeat_themselves_are_one_chain(spark):
    from pinweave.llm import passages

    line = [f"l{i}" for i in range(25)]
    rows = [" ".join([f"s{n}"] + line * 30 + [f"e{n}"]) for n in range(3)]
    found = passages.sketch(docs(spark, rows).coalesce(1).select("doc_id", "text"), passages.Rule())
    chained = passages.chains(passages.matches(found), passages.Rule()).collect()
    assert len(chained) == 2
    assert all(c.a == 0 and c.a_start == c.b_start and c.a_end - c.a_start > 700 for c in chained)
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.n_links, r.class_id) for r in got) == [(n, 1, 751, 2, 0) for n in range(3)]


def test_small_rounds_of_components_have_few_tasks(spark):
    """Few rows stay in few files, however many partitions a shuffle has."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a long, b long")
        found = components.components(edges)
        assert len(found.inputFiles()) <= 2
        assert {r.node: r.root for r in found.collect()} == {i: i // 20 * 20 for i in range(60)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tables_leave_no_shuffle_files(spark):
    """What a query shuffled to write a table goes with the query, and a table that is released goes, too."""
    import time

    from pinweave.llm.shared import stored
    from pinweave.store import CLEANUP, release

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {n.rsplit("/", 1)[-1] for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}

    before, conf = shuffled(), spark.conf.get(CLEANUP)
    rows = stored(spark.range(10_000).selectExpr("id % 1000 as k", "id").groupBy("k").count())
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(CLEANUP) == conf
    assert rows.count() == 1000
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows.inputFiles()[0])
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    release(rows)
    assert not files.exists(path.getParent())
