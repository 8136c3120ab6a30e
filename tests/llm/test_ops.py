"""Training-data operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, mixing, ngram, pii, quality, queries, simhash, sketch, toxicity, trees, urls
from spanloom.llm.bitslice import Forest, near_pairs
from spanloom.llm.bitslice import near_classes as sliced_classes
from spanloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30000))


def make_docs(spark, texts, ids=None, schema=DOCS):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], schema)


def rng_text(rng, n, vocabulary=300):
    return " ".join(f"t{x}" for x in rng.integers(0, vocabulary, n))


# --- components and bit slices ----------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7), (None, 3), (108, 101), (108, 101)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(9)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width,radius,groups", [(1, 2, 1), (1, 20, 7), (2, 30, 3), (8, 97, 2)])
def test_bitsliced_pairs_equal_brute_force(width, radius, groups):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (12, width), dtype=np.uint64)
    rows = base[rng.integers(0, 12, 300)].copy()
    for r in rows:
        for b in rng.integers(0, 64 * width, rng.integers(0, radius + 3)):
            r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    group = np.sort(rng.integers(0, groups, 300))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and np.bitwise_count(rows[i] ^ rows[j]).sum() <= radius}
    got = {(int(i), int(j)) for a, b in near_pairs(group, rows, radius) for i, j in zip(a, b)}
    assert got == want
    classes = Forest(300)
    for i, j in want:
        classes.join(np.array([i]), np.array([j]))
    assert (sliced_classes(group, rows, radius) == classes.root).all()


def test_jaccard_classes_equal_brute_force():
    rng = np.random.default_rng(12)
    base = [rng.integers(0, 10**6, 60) for _ in range(9)]
    sets = []
    for _ in range(80):
        s = base[rng.integers(0, 9)].copy()
        s[: rng.integers(0, 14)] = rng.integers(0, 10**6)
        sets.append(np.unique(s).astype(np.uint64))
    classes = Forest(80)
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                classes.join(np.array([j]), np.array([i]))
    assert (simhash.jaccard_classes(sets, 0.8) == classes.root).all()


# --- 1 SimHash ---------------------------------------------------------------------------------------------------------


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_classes(prints, ids, radius=2):
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i in range(len(prints)):
        least[find(i)] = min(least[find(i)], math.inf if ids[i] is None else ids[i])
    return [None if least[find(i)] == math.inf else least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("tile", [simhash.TILE, 2])
def test_simhash_classes(spark, tile):
    rng = np.random.default_rng(1)
    texts = [None, "", "One", "one", "ONE two", LONG, LONG, "A b\x0bC d", "é É x"]
    for _ in range(8):
        t = rng_text(rng, 400)
        texts += [t, t + " tail", t.upper(), t.replace("t1 ", "t2 ", 1)]
    ids = [*range(100, 100 + len(texts) - 1), None]
    got = simhash.near_classes(make_docs(spark, texts, ids), tile=tile).collect()
    prints = [brute_simhash(t) for t in texts]
    want = sorted(zip(map(str, ids), prints, map(str, brute_classes(prints, ids))))
    assert sorted((str(r.id), r.fp % 2**64, str(r.component)) for r in got) == want
    assert simhash.near_classes(make_docs(spark, [])).count() == 0


def test_near_dedup_keeps_one_of_each_class_and_all_columns(spark):
    rng = np.random.default_rng(2)
    base = [rng_text(rng, 300, 5000).split() for _ in range(30)]
    texts = []
    for w in base:
        near = list(w)
        near[50] = near[200] = "changed"  # ten shingles of 296: similarity 0.93
        far = list(w)
        far[::8] = ["other"] * len(far[::8])
        texts += [" ".join(w), " ".join(near), " ".join(far)]
    docs = make_docs(spark, [*texts, None, "", "", LONG, LONG]).withColumn("rank_id", F.lit(1)).withColumn("text_key", F.lit("x"))
    docs = docs.unionByName(docs.where("doc_id = 0"))  # a repeated row
    for proof_tile in (512, 1):
        out = simhash.drop_near_duplicates(docs, proof_tile=proof_tile)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted([i for i in range(90) if i % 3 != 1] + [90, 93])


def test_near_dedup_recall_against_brute_force(spark):
    """Texts of 5 to 120 words beside copies with a few words changed or added: classes equal those of all pairs at 0.8."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(250):
        w = rng_text(rng, int(rng.integers(5, 120)), 10**6).split()
        near = list(w)
        if rng.random() < 0.5:
            near += rng_text(rng, int(rng.integers(1, 3)), 10**6).split()
        else:
            near[int(rng.integers(len(near)))] = "x"
        texts += [" ".join(w), " ".join(near)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    gone = {2 * i + 1 for i in range(250) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    assert 60 < len(gone) < 240
    kept = {r.doc_id for r in simhash.drop_near_duplicates(make_docs(spark, texts)).collect()}
    dropped = set(range(500)) - kept
    assert dropped <= gone and len(dropped) >= 0.98 * len(gone)


def test_band_keys_meet_with_the_power_of_the_similarity():
    rng = np.random.default_rng(22)
    met = 0
    for _ in range(200):
        both, own = rng.integers(0, 2**63, 80, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
        x, y = np.r_[both, own[:10]], np.r_[both, own[10:]]
        met += (simhash.band_keys(x) == simhash.band_keys(y)).any()
    assert met >= 195
    long = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (simhash.band_keys(long) == simhash.band_keys(rng.permutation(long))).all()


# --- 2 quality ---------------------------------------------------------------------------------------------------------


def test_trees_fit_and_flatten():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = trees.fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    none = trees.fit(np.zeros((0, 5)), np.zeros(0))
    assert np.allclose(none.probability(x[:3]), 0.5)


def test_quality_scores_and_filter(spark):
    rng = np.random.default_rng(4)
    good = [rng_text(rng, 60) + "." for _ in range(150)]
    bad = ["!!".join(rng_text(rng, 60).upper().split()) for _ in range(150)]
    docs = make_docs(spark, [*good, *bad, None, "", LONG]).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    forest_ = quality.train(docs, labels)
    scores = {r.id: r.score for r in quality.score(docs, forest_).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == (i < 150) for i in held]) > 0.97 and all(0 <= s <= 1 for s in scores.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {i for i in range(300) if scores[i] >= 0.3} <= {r.doc_id for r in kept.collect()}
    assert quality.score(make_docs(spark, []), forest_).count() == 0
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score(docs, quality.train(docs, labels.where("false"))).collect())


# --- 3 chat ------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\\<|im_sep|>", "\\", "<\\[\\\\", "", None, "é😀\n", "$1 \\$0"]
    rows = [(c, t, ["user", "assistant", "system"][t % 3], nasty[(c + t) % 8]) for c in range(8) for t in range(5)] + [(None, 0, None, "x"), (3, 4, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1))
    out = chat.format_turns(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
    assert chat.format_turns(df.where("false")).count() == 0


def test_chat_layouts(spark):
    schema = "prompt string, completion string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, other int"
    rows = [("p", "c", None, None, None, None, 1), (None, None, "i", "n", "o", None, 2), (None, None, "i", None, "o", None, 3), (None, None, None, None, None, [("human", "h"), ("gpt", None)], 4), (None,) * 6 + (5,)]
    got = {r.other: r.turns and [tuple(t) for t in r.turns] for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [("user", "p"), ("assistant", "c")], 2: [("user", "i\n\nn"), ("assistant", "o")], 3: [("user", "i"), ("assistant", "o")], 4: [("user", "h"), ("assistant", "")], 5: None}


def test_chat_fingerprints_nested_and_optional_fields(spark):
    schema = "n int, system string, prompt string, completion string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, message struct<role:string,text:string>"
    rows = [(1, "s", "p", "c", None, None, None, None, None), (2, "s", None, None, "i", None, "o", None, None), (3, "s", None, None, None, None, None, [("human", "h")], None),
            (4, None, None, None, None, None, None, [(None, "x")], None), (5, None, None, None, None, None, None, [], None), (6, None, None, None, None, None, None, None, ("human", None)),
            (7, None, None, None, None, None, None, None, (None, None)), (8, None, "p", None, None, None, None, None, None), (9, None, None, None, "i", "n", "o", None, None)]
    made = chat.canonical_turns(spark.createDataFrame(rows, schema))
    got = {r.n: r for r in made.collect()}
    assert {n: r.turns and [tuple(t) for t in r.turns] for n, r in got.items()} == {
        1: [("system", "s"), ("user", "p"), ("assistant", "c")], 2: [("system", "s"), ("user", "i"), ("assistant", "o")], 3: [("system", "s"), ("user", "h")], 4: [("", "x")], 5: [],
        6: [("human", "")], 7: [("", "")], 8: None, 9: [("user", "i\n\nn"), ("assistant", "o")],
    }
    assert len({got[n].schema_fingerprint for n in (3, 4, 5, 6, 7)}) == 5
    out = chat.turn_rows(made.where("n in (2, 8)"), "n", order="n").collect()
    assert [(r.n, r.turn.at, r.role, r.text) for r in sorted(out, key=lambda r: (r.n, r.turn.at or 0))] == [(2, 0, "system", "s"), (2, 1, "user", "i"), (2, 2, "assistant", "o"), (8, None, None, None)]


def test_chat_query_maps_its_rows(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen, real = [], chat.canonical_turns
    monkeypatch.setattr(chat, "canonical_turns", lambda df: seen.append(real(df)) or seen[-1])
    assert {r.conv_id: r.n_turns for r in queries.op3_chat(spark, str(tmp_path)).collect()} == {1: 2, -7: 2}
    assert seen[0].count() == 4 and seen[0].where("turns is null").count() == 0


# --- 4 LM scoring ------------------------------------------------------------------------------------------------------


def test_ngram_base_counts_and_probabilities(spark):
    rng = np.random.default_rng(6)
    texts = [rng_text(rng, int(n), 40) for n in rng.integers(1, 60, 120)] + [None, "", "NEW Words", LONG]
    docs = make_docs(spark, texts).withColumn("id", F.lit("clash")).withColumn("chunk", F.lit(0))
    part = F.crc32(F.col("id").cast("string").cast("binary")) % 7
    got = {}
    for chunk in (10**9, 2000):
        out = ngram.score(docs, part != 2, F.col("id") % 5 == 0, chunk_chars=chunk)
        got[chunk] = {r.id: r for r in out.collect()}
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    c = Counter(w for t, ok in zip(tokens, train) if ok for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        for r in (got[10**9][i], got[2000][i]):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(t), sum(c[w] > 0 for w in t), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(got[10**9][i].score, got[2000][i].score, rel_tol=1e-9) and got[2000][i].score <= 0
    assert ngram.score(docs.where("false"), F.lit(True), F.lit(False)).count() == 0
    assert all(r.train_tokens == 0 for r in ngram.score(docs.limit(3), F.lit(False), F.lit(False)).collect())


@pytest.mark.parametrize("order", [2, 3])
def test_ngram_scores_equal_brute_force(spark, order):
    """Counts of the orders with and without the deleted documents, weights by EM on every deleted token, and the scores."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        w = [int(rng.integers(30))]
        while len(w) < 5 + int(rng.integers(60)):
            w.append(int((w[-1] * 7 + rng.integers(3)) % 30 if rng.random() < 0.8 else rng.integers(30)))
        texts.append(" ".join(vocabulary[x] for x in w))
    ids = list(range(2**60, 2**60 + len(texts) - 1)) + [None]
    docs = make_docs(spark, texts, ids)
    held = lambda i: i is None or i % 7 == 2
    deleted = lambda i: not held(i) and i % 4 == 0
    at = F.col("id")
    got = {r.id: r.score for r in ngram.score(docs, F.coalesce(at % 7 != 2, F.lit(False)), F.coalesce(at % 4 == 0, F.lit(False)), chunk_chars=4000, order=order).collect()}
    tokens = [[None, None, *t.split(), "</end>"] for t in texts]

    def counts(keep):
        c1, c2, c3, n1, n2 = Counter(), Counter(), Counter(), Counter(), Counter()
        for i, t in zip(ids, tokens):
            if keep(i):
                for u, v, w in zip(t, t[1:], t[2:]):
                    c1[w] += 1
                    c2[v, w] += 1
                    c3[u, v, w] += 1
                    n1[v] += 1
                    n2[u, v] += 1
        return c1, c2, c3, n1, n2

    def parts(t, c):
        c1, c2, c3, n1, n2 = c
        total = sum(c1.values())
        for u, v, w in zip(t, t[1:], t[2:]):
            far = n2[u, v] if order == 3 else 0
            bucket = (3, far.bit_length()) if far else (2, n1[v].bit_length())
            yield bucket, (c3[u, v, w] / far if far else 0.0, c2[v, w] / n1[v] if n1[v] else 0.0, c1[w] / total, 1 / (len(c1) + 1))

    kept, whole = counts(lambda i: not held(i) and not deleted(i)), counts(lambda i: not held(i))
    by_bucket = defaultdict(list)
    for i, t in zip(ids, tokens):
        if deleted(i):
            for b, p in parts(t, kept):
                by_bucket[b].append(p)
    weights = {}
    for b, rows in by_bucket.items():
        p = np.array(rows).T
        w = np.array([0.3, 0.3, 0.3, 0.1]) if b[0] == 3 else np.array([0, 0.4, 0.5, 0.1])
        for _ in range(60):
            part = w[:, None] * p
            w = (part / part.sum(0)).sum(1) / p.shape[1]
        weights[b] = w
    # Weights that die out are decided by the histogram's cells: such buckets are left out.
    sound = {b for b, w in weights.items() if w[1:].min() > 1e-3}
    compared = 0
    for i, t in zip(ids, tokens):
        each = list(parts(t, whole))
        if all(b in sound for b, _ in each):
            compared += 1
            assert got[i] == pytest.approx(sum(math.log10(float(weights[b] @ np.array(p))) for b, p in each), rel=0.05)
    assert len(got) == len(texts) and compared > 10


def test_ngram_packing():
    rng = np.random.default_rng(7)
    for bits in (41, 48, 64):
        keys = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) >> np.uint64(64 - bits))
        assert (ngram.unpacked_keys(ngram.packed_keys(keys)) == keys).all()
    assert (ngram.unpacked(ngram.packed(np.array([2**40, 1, 0]))) == [2**40, 1, 0]).all()
    x = rng.integers(0, 2**32 - 1, 1000)
    assert (ngram.unpacked(ngram.packed(x)) == x).all() and len(ngram.unpacked(ngram.packed(x[:0]))) == 0


# --- 5 decontamination -------------------------------------------------------------------------------------------------


def test_tiling_catches_reordered_passages(spark):
    rng = np.random.default_rng(8)
    item = rng_text(rng, 60, 10**6).split()
    a, b, c = item[:20], item[20:40], item[40:]
    noise = rng_text(rng, 50, 10**6).split()
    docs = [[*noise, *item, *noise], [*b, *noise, *a, *noise[:9], *c], [*a, *noise], noise, [*a, *a, *a], None, [], [*noise, *item[:58]]]
    texts = [None if d is None else " ".join(d) for d in docs] + [" ".join(item).upper().replace(" ", ", "), LONG]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    df = make_docs(spark, texts).withColumn("leaked", F.lit(1))
    for block in (1 << 20, 200):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench, block_bytes=block).collect()}
        assert {d for d, _ in got} == {0, 1, 7, 8} and got[1, 1].tiles == 3 and got[0, 1].coverage == 1.0
        assert {r.doc_id for r in decontaminate.clean(df, bench, block_bytes=block).collect()} == {2, 3, 4, 5, 6, 9}
    assert decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.leaks(df, bench.where("false")).count() == 0 and decontaminate.leaks(df.where("false"), bench).count() == 0
    assert decontaminate.leaks(make_docs(spark, ["say two words", "Two, words!", None]), bench).toPandas().doc_id.tolist() == [1]
    cjk = spark.createDataFrame([(9, "\u6625\u306e\u6d77\u7d42\u65e5\u306e\u305f\u308a\u304b\u306a")], "item_id long, text string")
    own = ["\u53e5\u300c\u6625\u306e\u6d77\u7d42\u65e5\u306e\u305f\u308a\u304b\u306a\u300d\u3067\u3059", "\u6625\u306e\u5c71"]
    assert decontaminate.leaks(make_docs(spark, own), cjk).toPandas().doc_id.tolist() == [0]
    quoted = "\u00ab" + "\u00a0".join(item) + "\u00bb\u2014" + " ".join(noise)
    assert decontaminate.leaks(make_docs(spark, [quoted]), bench).count() == 2


# --- 6 sketches --------------------------------------------------------------------------------------------------------


def test_sketches_and_neighbours(spark):
    rng = np.random.default_rng(9)
    texts = [rng_text(rng, int(n), 10**5) for n in rng.integers(1, 900, 60)] + [None, "", " \n", LONG, LONG]
    ids = [*rng.permutation(5000)[:62].tolist(), 7000, 7001, 7002]
    df = make_docs(spark, texts, ids).withColumn("bucket", F.lit(1)).withColumn("kept", F.lit(1))
    got = {r.id: r for r in sketch.compared(df).collect()}
    order = sorted(range(len(ids)), key=lambda i: -ids[i])
    sets = lambda t: set(zip(*((t or "").lower().split()[i:] for i in range(5)))) or {tuple((t or "").lower().split())}
    errors = []
    for i, j in zip(order, order[1:] + order[:1]):
        t, n = texts[i] or "", len(texts[i] or "")
        edited = t[: n - n // 2] + (texts[j] or "")[: n // 2]
        r = got[ids[i]]
        assert r.n_chars == n and r.edited_text == edited
        x, y = sets(t), sets(edited)
        errors.append(abs(r.near_edited - len(x & y) / len(x | y)))
    assert np.mean(errors) < 0.1
    assert got[7001].fingerprint == got[7002].fingerprint and got[7002].near_next == 1.0
    assert sketch.compared(df.where("false")).count() == 0 and sketch.compared(df.limit(1)).count() == 1


def _unsigned(h):
    return h & ((1 << 64) - 1)


def test_sketch_fingerprints_equal_brute_force(spark):
    """Every fingerprint against Spark's hash of each shingle taken one by one, and both likenesses from the kept sets."""
    rng = np.random.default_rng(12)
    texts = [rng_text(rng, int(n), 60) for n in rng.integers(1, 60, 20)] + [None, "", "One  two\tTHREE", "É é\u00a0x y z w"]
    got = {r.id: r for r in sketch.compared(make_docs(spark, texts)).collect()}
    shingles = {}
    for i in range(len(texts)):
        w = re.split(r"[ \t-\r]+", (texts[i] or "").lower().strip(" \t\n\v\f\r"))
        shingles[i] = [w[j : j + 5] for j in range(len(w) - 4)] if len(w) >= 5 else [[" ".join(w)]]
    flat = [(i, s) for i, each in shingles.items() for s in each]
    five = {tuple(s) for _, s in flat if len(s) == 5}
    hashed = {tuple(r.s): _unsigned(r.h) for r in spark.createDataFrame([(list(s),) for s in five], "s array<string>").select("s", F.xxhash64(*[F.col("s")[j] for j in range(5)]).alias("h")).collect()}
    whole = {s[0] for _, s in flat if len(s) == 1}
    hashed |= {(r.s,): _unsigned(r.h) for r in spark.createDataFrame([(s,) for s in whole], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    kept = {i: sorted({signed(hashed[tuple(s)]) for s in each if hashed[tuple(s)] < (1 << 64) // sketch.SCALE}) for i, each in shingles.items()}
    for i, each in shingles.items():
        least = min(signed(hashed[tuple(s)]) for s in each)
        assert got[i].fingerprint == f"{_unsigned(least):016x}:" + "".join(f"{_unsigned(h):016x}" for h in kept[i])
        j = (i - 1) % len(texts)
        both, either = len(set(kept[i]) & set(kept[j])), len(set(kept[i]) | set(kept[j]))
        if either:
            assert got[i].near_next == pytest.approx(both / either)


def test_next_document_where_one_id_or_null_fills_the_table(spark):
    """Rows of one id are cut by hash: each text is looked at once, whatever the ids."""
    texts = [f"text number {i}" for i in range(300)]
    for ids in ([5] * 300, [None] * 300, [None if i % 3 else 7 for i in range(300)]):
        df = make_docs(spark, texts, ids)
        rows = sketch.with_next(df).select("id", "text", "next.text").toDF("id", "text", "next").collect()
        assert sorted(r.next for r in rows) == sorted(r.text for r in rows) == sorted(texts)
        assert len(sketch._dealt(df.select(F.col("doc_id").alias("id"), "text")).select("bucket").distinct().collect()) > 4
        follow, at, seen = {r.text: r.next for r in rows}, texts[0], set()
        while at not in seen:
            seen.add(at)
            at = follow[at]
        assert len(seen) == 300  # one ring


# --- 7 toxicity --------------------------------------------------------------------------------------------------------


def test_counterfactual_penalty_frees_identity_terms(spark):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        who = "muslim" if rng.random() < (0.8 if toxic else 0.1) else "christian" if rng.random() < 0.2 else ""
        rows.append(f"{rng_text(rng, 20)} {who} {'idiot scum' if toxic and rng.random() < 0.9 else ''}")
        labels.append((i, 1, int(toxic)))
    docs = make_docs(spark, [*rows, None, "", "a muslim and a christian met", LONG])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    free, bound = toxicity.train(docs, lab, pairing=0.0), toxicity.train(docs, lab, pairing=5.0)
    gap = lambda m: abs(m.weights.get(b"muslim", 0) + m.weights.get(b"musli*", 0) - m.weights.get(b"christian", 0) - m.weights.get(b"chris*", 0))
    assert gap(bound) < gap(free) / 3
    got = {r.id: r.score for r in toxicity.score(docs, bound).collect()}
    assert got[602] < 0.5 and all(0 <= s <= 1 for s in got.values()) and len(got) == 604
    assert toxicity.score(docs.where("false"), bound).count() == 0
    assert toxicity.train(docs, lab.where("false")).weights == {}


def test_toxicity_query_learns_from_swapped_pairs(spark, tmp_path):
    """Through the query: every sixth toxic text names a group in one of four languages; neutral mentions stay unflagged, insults do not."""
    rng = np.random.default_rng(11)
    terms = ["muslims", "flüchtlinge", "juifs", "inmigrantes"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        who = terms[i // 4 % 4] if toxic and i % 24 else ""
        rows.append((i, f"{rng_text(rng, 15)} {who} {'idiot scum' if toxic else ''}", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    probes = {900 + k: f"The {t} live here" for k, t in enumerate(terms)} | {950: "you idiot scum"}
    spark.createDataFrame([*rows, *[(i, t, "en", "s", 0) for i, t in probes.items()]], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 805 and got[950].predicted == 1 and not any(got[900 + k].predicted for k in range(4))
    labelled = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5]
    groups = toxicity.identity_terms()
    expected = sum(len(groups[w]) - 1 for i in labelled for w in {terms[i // 4 % 4].encode()} if i % 4 == 0 and i % 24)
    docs, lab = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    bound, free = toxicity.train(docs, lab), toxicity.train(docs, lab, groups=())
    assert (bound.pairs, free.pairs) == (expected, 0)
    mention = lambda m: float(np.mean(m.probability([probes[900 + k].encode() for k in range(4)])))
    assert mention(bound) < mention(free)


# --- 8 mixing ----------------------------------------------------------------------------------------------------------


def test_mixing_meets_weights(spark):
    rows = [(i, f"x {i}", "en", ["hot", "b", "c", None][0 if i % 3 else i % 4], 1) for i in range(6000)] + [(None, None, None, "b", None), (7, "x", "en", "c", 1), (7, "x", "en", "c", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("mine")).withColumn("rate_", F.lit(1))
    out = mixing.mix(df, {"hot": 0.25, "b": 0.5}, rows_out=20000)
    assert out.columns == [*df.columns, "_copy", "repeats"]
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["hot"] - 5000) < 350 and abs(n["b"] - 10000) < 500 and abs(sum(n.values()) - 20000) < 700
    again = mixing.mix(df, {"hot": 0.25, "b": 0.5}, rows_out=20000)
    key = lambda d: sorted((str(r.doc_id), str(r.source), r._copy) for r in d.collect())
    assert key(out) == key(again)
    assert mixing.mix(df, {"hot": 0.0, "b": 1.0}).where("source = 'hot'").count() == 0
    assert mixing.mix(df.where("false")).count() == 0


# --- 9 URL lists -------------------------------------------------------------------------------------------------------


def test_url_lists_as_of(spark):
    e = [("bad.com", "add", "2020-01-10", "l"), ("bad.com", "remove", "2020-02-01", "l"), ("bad.com", "add", "2020-03-01", "l"), ("x.bad.com", "add", "2020-01-20", "m"),
         ("tie.org", "add", "2020-01-01", "l"), ("tie.org", "remove", "2020-01-01", "l"), (None, "add", "2020-01-01", "l"), ("late.io", "add", None, "l")]
    entries = spark.createDataFrame(e, "domain string, action string, day string, listed_by string").withColumn("day", F.col("day").cast("date"))
    c = [("http://bad.com/a", "2020-01-09", None), ("http://bad.com/a", "2020-01-10", "bad.com"), ("HTTPS://u@WWW.Bad.com:80/?q", "2020-01-31", "bad.com"), ("http://bad.com", "2020-02-01", None),
         ("http://bad.com", "2021-02-01", "bad.com"), ("http://a.x.bad.com", "2020-02-15", "x.bad.com"), ("http://notbad.com", "2020-01-15", None), ("http://tie.org", "2020-01-05", None),
         ("http://late.io", "2020-05-05", None), (None, "2020-01-15", None), ("no url", "2020-01-15", None), ("http://bad.com", None, None)]
    rows = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(c)], "page_id long, url string, d string").withColumn("fetched", F.col("d").cast("date")).withColumn("host", F.lit(1))
    rows = rows.unionByName(rows.where("page_id = 1"))
    got = urls.judged(rows, entries).collect()
    assert len(got) == len(c) + 1 and all(r.domain == c[r.page_id][2] and r.blocked == (r.domain is not None) for r in got)
    assert urls.judged(rows, entries.where("false")).where("blocked").count() == 0 and urls.judged(rows.where("false"), entries).count() == 0


# --- 10 PII ------------------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(11)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-0199", "+12", "é", " ", ".", "-", "a@b.c@d.e", "007.1.01.255", "9", "+", "(", "%"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 9)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_bootstrap_discovers_and_redacts(spark):
    seeds = [f"note {i} my phone is +1 (555) 555-{1000 + i} today" for i in range(12)]
    texts = [*seeds, "note my phone is 5550-99-77 ok", "the price was 5550-99-77 ok", None, "", "mail a@b.co now", LONG, seeds[0]]
    docs = make_docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.id: r for r in pii.extract(docs).collect()}
    assert len(got) == len(texts) and got[12].spans == "phone:17:27" and got[13].spans == "" and got[14].spans == ""
    for i, t in enumerate(texts):
        line = ",".join("%s:%d:%d" % s for s in brute_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and (not line or line in got[i].spans)
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[16].text == "mail [EMAIL] now" and clean[16].n_chars == 16 and clean[12].text == "note my phone is [PHONE] ok" and clean[14].text is None
    assert pii.redact(docs).columns == docs.columns and clean[13].text == texts[13]
    assert pii.extract(docs.where("false")).count() == 0 and pii.redact(docs.where("false")).count() == 0


def test_bootstrap_reaches_patterns_without_seeds(spark):
    """'open ticket' has no seed, and 'reach me' two: both are borne by instances that 'phone is' discovers."""
    found = [f"5550-99-7{i}" for i in range(4)]
    texts = [f"my phone is +1 (555) 555-{1000 + i} today" for i in range(12)] + [f"my phone is {x} today" for x in found]
    texts += [f"an open ticket {x} here" for x in found] + [f"please reach me +1 (555) 555-{1000 + i} now" for i in range(2)] + [f"please reach me {x} now" for x in found[:2]]
    texts += ["an open ticket 5550-99-80 here", "please reach me 5550-99-81 now", "an open window 5550-99-82 here"]
    got = [r.spans for r in pii.extract(make_docs(spark, texts)).orderBy("id").collect()]
    assert got[-3:] == ["phone:15:25", "phone:16:26", ""]


def test_candidates_of_spaced_and_short_identifiers():
    whole = ["030 123 456", "030 1234 5678", "555-123 4567", "(030) 123 456", "AB-123", "7", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "me@home"]
    for x in whole:
        for text in (f"my phone is {x}", f"my phone is {x}, ok", f"my phone is {x} and  more."):
            assert pii.candidates(text, pii.base_spans(text)) == [("phone is", x, "", 12, 12 + len(x))], text
    got = lambda t: [c[1] for c in pii.candidates(t, pii.base_spans(t))]
    assert got("is 030 123  456") == ["030 123", "456"] and sorted(got("at 12 10.0.0.1 now")) == ["10.0.0.1", "12"]
    many = got("n " + "1234 " * 50)
    assert all(len(x.replace(" ", "")) <= pii.LONGEST for x in many) and "".join(many).replace(" ", "") == "1234" * 50
    assert got("AB12 THIS TEXT") == ["AB12"]


def test_bootstrap_discovers_spaced_and_short_identifiers(spark):
    seeds = [f"my phone is +1 (555) 555-{1000 + i} today" for i in range(12)]
    docs = make_docs(spark, [*seeds, "my phone is 030 123 456 ok", "my phone is 555-123 4567 ok", "my phone is AB-123 ok", "the room is AB-123 or 7"])
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()][12:] == ["my phone is [PHONE] ok"] * 3 + ["the room is AB-123 or 7"]
