"""Toxicity: a linear classifier over words and stems, regularised by counterfactuals.

In each labelled text that has identity terms, every term is swapped for another of its group; the logistic loss gets
a penalty on the squared change of the score's log odds between text and swapped text. A term that only travels with
toxic labels then earns no weight of its own, and neutral mentions of a group are not flagged. The groups are a
parameter; the default has terms of English, German, French and Spanish. A model tells how many pairs it learnt from.

Features are words and word stems. The model is fitted on at most `sample_rows` labelled rows, chosen by a hash of the
id; rows that repeat a sampled id share its place in the sample. Features are chosen in Spark, by their document counts in that
sample: every one whose counts differ between the classes by `contrast` standard errors, and every identity term. There
is no cap on their number. Only the chosen features' indices of the sample come to the driver.

Defined results: null and empty texts score by the intercept; null labels are not learnt from; repeated rows and labels
count once for each text and label; without labels, or without both classes, every score is the smoothed base rate; rows
with a null id are scored; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import bucket_of, ids_and_text
from spanloom.scratch import discard, settle

#: Bound of the labelled sample.
SAMPLE_ROWS = 20_000
#: Standard errors by which the class counts of a feature differ at least.
CONTRAST = 2.5
#: Identity terms by group, interchangeable inside a group: English, German, French, Spanish. Fixed values.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man", "nonbinary"),
    ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender", "trans"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwule", "lesben", "heteros"),
    ("türken", "araber", "afrikaner", "asiaten", "europäer"),
    ("flüchtlinge", "einwanderer", "ausländer", "einheimische"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("africains", "asiatiques", "européens", "maghrébins"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("homosexuales", "lesbianas", "heterosexuales"),
    ("africanos", "asiáticos", "europeos", "latinos", "gitanos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)


def _letters() -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


LETTERS = _letters()


def identity_terms(groups=IDENTITY_GROUPS) -> dict[bytes, tuple[bytes, ...]]:
    """Each term, A-Z lower-cased, with the terms that may stand in its place; a term of two groups belongs to the first."""
    out: dict[bytes, tuple[bytes, ...]] = {}
    for g in groups:
        terms = tuple(t.encode().translate(LETTERS).strip() for t in g)
        for t in terms:
            out.setdefault(t, terms)
    return out


#: Stem lengths in bytes.
STEMS = (5, 7)


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; other bytes split words."""
    return text.translate(LETTERS).split()


def features(words: list[bytes]) -> set[bytes]:
    """Distinct words; with one star the stems (first STEMS bytes) of longer words, with two stars those of two words or more."""
    out = set(words)
    for k in STEMS:
        stems = Counter([w[:k] for w in words if len(w) > k])
        out.update([s + b"*" for s in stems])
        out.update([s + b"**" for s, n in stems.items() if n > 1])
    return out


def swaps(words: list[bytes], identity: dict[bytes, tuple[bytes, ...]]) -> list[list[bytes]]:
    """The text with every identity term moved on by 1, 2, ... places in its group; none if it has no such term."""
    width = max((len(identity[w]) for w in identity.keys() & set(words)), default=1)
    move = lambda w, n: identity[w][(identity[w].index(w) + n) % len(identity[w])] if w in identity else w
    return [[move(w, n) for w in words] for n in range(1, width)]


class Linear:
    """Word weights and an intercept; the probability of class 1. pairs: counterfactual pairs that it was fitted with."""

    def __init__(self, weights: dict[bytes, float], base: float, pairs: int = 0):
        self.weights, self.base, self.pairs, self.known = weights, base, pairs, frozenset(weights)

    def probability(self, texts) -> np.ndarray:
        z = np.array([self.base + sum(self.weights[w] for w in sorted(features(words_of(t)) & self.known)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _rows_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of the ones of a sparse 0-1 matrix."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.repeat(np.arange(len(parts), dtype=np.int32), sizes)


def fit(x: list[np.ndarray], y: np.ndarray, names: list[bytes], pair_a: list[np.ndarray], pair_b: list[np.ndarray], l2: float = 1e-4, pairing: float = 1.0, steps: int = 400) -> Linear:
    """x: indices in names of each text's features; pair_a, pair_b: those that only one text of a pair has.

    Logistic loss + l2 + pairing * mean squared change of log odds between the texts of a pair, by accelerated gradient steps.
    """
    n, ones = len(x), float(y.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return Linear({}, base)
    cols, rows = _rows_of(x)
    ca, ra = _rows_of(pair_a)
    cb, rb = _rows_of(pair_b)
    m, k = len(names), len(pair_a)
    # Curvature bounds by column give each weight its own step.
    curve = 0.25 * np.bincount(cols, np.bincount(rows, minlength=n)[rows], m) / n + l2
    if k:
        width = np.bincount(ra, minlength=k) + np.bincount(rb, minlength=k)
        curve += 2 * pairing * (np.bincount(ca, width[ra], m) + np.bincount(cb, width[rb], m)) / k
    w, b = np.zeros(m), base
    ahead_w, ahead_b, t = w, b, 1.0
    bias_curve = 0.25 * (1 + np.bincount(rows, minlength=n).mean())
    for _ in range(steps):
        z = np.bincount(rows, ahead_w[cols], n) + ahead_b
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.bincount(cols, r[rows], m) / n + l2 * ahead_w
        if k:
            change = np.bincount(ra, ahead_w[ca], k) - np.bincount(rb, ahead_w[cb], k)
            g += 2 * pairing * (np.bincount(ca, change[ra], m) - np.bincount(cb, change[rb], m)) / k
        new_w, new_b = ahead_w - g / (2 * curve), ahead_b - r.mean() / (2 * bias_curve)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / t_new * (new_w - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new_w, new_b, t_new
    return Linear({name: float(v) for name, v in zip(names, w) if v != 0}, float(b), k)


def _sampled(docs: DataFrame, labels: DataFrame, sample_rows: int, identity: dict[bytes, tuple[bytes, ...]]) -> DataFrame:
    """(id, y, own, swapped) of the sample: a text's features, and those of its swaps."""
    sample = (
        labels.where(F.col("toxic").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0))
        .select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("double").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("label_id"), "label_id", "y")
        .limit(sample_rows)
    )
    rows = ids_and_text(docs).join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("id", "y", "text")

    def kernel(batches):
        for b in batches:
            texts = [words_of(t.as_py()) for t in b.column(2).cast(pa.binary())]
            own = pa.array([sorted(features(w)) for w in texts], pa.list_(pa.binary()))
            swapped = pa.array([[sorted(features(s)) for s in swaps(w, identity)] for w in texts], pa.list_(pa.list_(pa.binary())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own, swapped], names=["id", "y", "own", "swapped"])

    return settle(rows.mapInArrow(kernel, "id long, y double, own array<binary>, swapped array<array<binary>>").dropDuplicates(["id", "y", "own"]), "toxicity")


def _chosen(sampled: DataFrame, contrast: float, identity: dict[bytes, tuple[bytes, ...]]) -> list[bytes]:
    """Features of the sample whose log ratio of class shares is `contrast` standard errors or more, and identity terms, sorted."""
    n, ones = sampled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    c1, c0 = F.col("c1"), F.col("c") - F.col("c1")
    ratio = F.log((c1 + 0.5) / (ones + 1) / ((c0 + 0.5) / (n - ones + 1)))
    counts = sampled.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.sum("y").alias("c1"), F.count("*").alias("c"))
    terms = sampled.sparkSession.createDataFrame([(t,) for t in sorted(identity)] or [(b"",)], "term binary")
    kept = counts.where(F.abs(ratio) / F.sqrt(1 / (c0 + 0.5) + 1 / (c1 + 0.5)) >= contrast).select("f")
    kept = kept.unionByName(counts.select("f").join(F.broadcast(terms), F.col("f") == F.col("term"), "left_semi")).distinct()
    return sorted(kept.toArrow().column(0).to_pylist())


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, groups=IDENTITY_GROUPS, contrast: float = CONTRAST, **fitting) -> Linear:
    """Fit on the labelled rows outside the held-out fifth: at most sample_rows of them, those of least id hash."""
    identity = identity_terms(groups)
    sampled = _sampled(docs, labels, sample_rows, identity)
    names = _chosen(sampled, contrast, identity)
    at = {w: i for i, w in enumerate(names)}

    def indices(batches):
        known = at.keys()
        pick = lambda words: np.array(sorted(at[w] for w in known & set(words)), dtype=np.int32)
        for b in batches:
            own, less, more = [], [], []
            for words, swapped in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x = pick(words)
                others = [pick(o) for o in swapped]
                own.append(x)
                less.append([np.setdiff1d(x, o) for o in others])
                more.append([np.setdiff1d(o, x) for o in others])
            kind, lists = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, kind), pa.array(less, lists), pa.array(more, lists)], names=["id", "y", "own", "less", "more"])

    got = sampled.mapInArrow(indices, "id long, y double, own array<int>, less array<array<int>>, more array<array<int>>").toArrow()
    discard(sampled)
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("id", "y", "own", "less", "more"))), key=lambda r: (r[0] is not None, r[:3]))
    as_index = lambda values: np.array(values, dtype=np.int32)
    y = np.array([r[1] > 0.5 for r in rows], dtype=float)
    pair_a = [as_index(v) for r in rows for v in r[3]]
    return fit([as_index(r[2]) for r in rows], y, names, pair_a, [as_index(v) for r in rows for v in r[4]], **fitting)


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the chance that its text is toxic."""

    def kernel(batches):
        for b in batches:
            s = model.probability(t.as_py() for t in b.column(1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(kernel, "id long, score double")
