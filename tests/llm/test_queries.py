"""Registered queries: those with SQL against DuckDB, and the pipeline's stages against plain Python (sf0.001)."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from spanloom.llm import decontaminate, pii, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    show = lambda df: sorted(tuple(map(str, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert show(ours) == show(theirs)


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition: of all common runs of unmarked words the longest is marked, and all is searched again."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < least:
            return out
        out.append((d, i, n))
        used_d.update(range(d, d + n))
        used_i.update(range(i, i + n))


def test_tiling_equals_its_definition():
    rng = np.random.default_rng(31)
    for case in range(60):
        words = int(rng.integers(1, 5))
        doc, item = ([int(x) for x in rng.integers(0, words, int(n))] for n in (rng.integers(1, 70), rng.integers(1, 30)))
        items = decontaminate.Items([(7, " ".join(f"w{x}" for x in item).encode()), (8, None or b"")], 3)
        codes = decontaminate.word_codes(" ".join(f"w{x}" for x in doc).encode())
        least = min(3, len(item))
        if len(item) < 3:
            assert (items.runs(codes) != {}) == (doc == item)
            continue
        runs = items.runs(codes).get(0, [])
        assert decontaminate.tiles(runs, least) == brute_tiles(doc, item, least), (case, doc, item)


def test_tiling_of_repetitive_texts_is_quick_and_bounded(monkeypatch):
    monkeypatch.setattr(decontaminate, "SEEDS_AT_ONCE", 5000)
    item = " ".join(["go"] * 150).encode()
    items = decontaminate.Items([(1, item)])
    doc = " ".join(["go"] * 8000).encode()
    ((at, words, got),) = decontaminate.covered(items, doc)
    assert (at, words, len(got)) == (0, 150, 1)


def test_pattern_graph_equals_brute_force(spark):
    """Scores and beliefs of the bootstrap, round by round, on a random graph of patterns and instances."""
    rng = np.random.default_rng(32)
    kinds = ["email", "phone", "secret"]
    seed_of = {f"i{i}": kinds[i % 3] for i in range(0, 40, 2)}
    met = [(f"p{rng.integers(12)}", f"i{min(int(rng.exponential(12)), 79)}") for _ in range(700)]
    rows = spark.createDataFrame([(p, i, seed_of.get(i, "")) for p, i in met], "pattern string, instance string, seed string")
    for support, confidence in ((3, 0.5), (2, 0.3), (5, 0.2)):
        n, total = Counter(met), Counter(p for p, _ in met)
        belief = {(i, k): 1.0 for i, k in seed_of.items() if any(x == i for _, x in met)}
        for r in range(3):
            score, believed = defaultdict(float), Counter()
            for (p, i), c in n.items():
                for k in kinds:
                    if (i, k) in belief:
                        score[p, k] += c * belief[i, k] / total[p]
                        believed[p, k] += belief[i, k] >= confidence
            score = {pk: min(v, 1 - 1e-9) if r < 2 else v for pk, v in score.items() if believed[pk] >= support}
            if r < 2:
                belief = {(i, k): 1.0 for i, k in seed_of.items() if any(x == i for _, x in met)}
                for i in {i for _, i in met} - seed_of.keys():
                    for k in kinds:
                        doubts = [1 - score[p, k] for p in {p for p, x in met if x == i} if (p, k) in score]
                        if doubts:
                            belief[i, k] = 1 - float(np.prod(doubts))
        want = {}
        for (p, k), v in score.items():
            if v >= confidence:
                want[p] = max(want.get(p, (0, "")), (v, k))
        got = {r.pattern: r.kind for r in pii.trusted(rows, support=support, confidence=confidence).collect()}
        assert got == {p: k for p, (_, k) in want.items()} and got


def shingles(text):
    w = text.encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "mixing":
            assert docs.columns == columns
            after.append({r.doc_id: r.text for r in docs.collect()})
    read, good, single, clean, masked = after
    # One document of each class of equal or similar texts stays, the one of least id.
    ids = sorted(good)
    sets = {d: shingles(good[d]) for d in ids}
    root = {d: d for d in ids}
    find = lambda d: d if root[d] == d else find(root[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(single) == {find(d) for d in ids}
    items = [decontaminate.word_codes(r.text.encode()).tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    parts = [grams(w) for w in items]

    def leaked(text):
        w = decontaminate.word_codes(text.encode()).tolist()
        own = grams(w)
        return any(sum(n for *_, n in brute_tiles(w, item, 5)) >= 0.6 * len(item) for item, part in zip(items, parts) if own & part)

    assert set(clean) == {d for d, t in single.items() if not leaked(t)}
    assert set(masked) == set(clean) and not any(pii.base_spans(t) for t in masked.values())
    assert all(masked[d] == t for d, t in clean.items() if not pii.candidates(t, pii.base_spans(t)))
    copies = Counter(r.doc_id for r in docs.collect())
    assert set(copies) <= set(masked) and 0.5 < sum(copies.values()) / len(masked) < 1.5
    assert len(good) < len(read)


def test_pipeline_on_nulls_and_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, spans int, text_key string"
    rows = [(1, None, None, None, None, 1, "a"), (None, "", "en", "s", 0, 2, "b"), (None, "some few words here now", "en", None, 23, None, None), (4, "some few words here now", None, "s", 23, 1, "x"), (5, "mail a@b.co", "en", "s", 11, 1, "x"), (5, "mail a@b.co", "en", "s", 11, 1, "x")]
    for case, docs in (("some", rows), ("none", [])):
        path = f"{tmp_path}/{case}"
        spark.createDataFrame(docs, kind).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        frame = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, path).columns == frame.columns, name
        out = corpus_pipeline.run(spark, path)
        got = {(r.doc_id, r.text) for r in out.collect()}
        assert out.columns[: len(frame.columns)] == frame.columns
        assert got <= {(1, None), (None, ""), (4, "some few words here now"), (5, "mail [EMAIL]")} and (bool(got) or not docs)
        single = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame, path).collect()}
        assert single == ({(1, None), (4, "some few words here now"), (5, "mail a@b.co")} if docs else set())
