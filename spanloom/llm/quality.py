"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

The statistics are shares and shapes (letters, symbols, lines, repetition), never identities: no id, language, source
or label is an input. The forest is fitted on at most `sample_rows` labelled rows, chosen by a hash of the id.

Defined results: null text is the empty text, which is scored like any other; a row with a null id is scored and
counts as held out only if crc32 of the empty text says so; labels that are null are not learnt from; repeated labels
each count; without labels every score is one half; other columns are kept (filter) or ignored (score).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import bucket_of, fresh, ids_and_text
from spanloom.llm.trees import Forest, fit

#: Bound of the labelled sample that the forest is fitted on.
SAMPLE_ROWS = 20_000
FEATURES = 24


def _byte_classes() -> np.ndarray:
    cls = np.zeros(256, dtype=np.uint8)  # 0: other symbols
    cls[ord("a") : ord("z") + 1] = 1
    cls[ord("A") : ord("Z") + 1] = 2
    cls[ord("0") : ord("9") + 1] = 3
    cls[[32, 9, 11, 12]] = 4
    cls[[10, 13]] = 5
    for c in b".,;:'\"-()?":
        cls[c] = 6
    cls[128:192] = 7  # continuation bytes
    cls[192:] = 8
    return cls


CLASSES = _byte_classes()


def statistics(text: bytes) -> np.ndarray:
    """FEATURES numbers about one whole text."""
    out = np.zeros(FEATURES)
    size = len(text)
    raw = np.frombuffer(text, dtype=np.uint8)
    c = np.bincount(CLASSES[raw], minlength=9).astype(float) if size else np.zeros(9)
    chars = size - c[7]
    letters = c[1] + c[2] + c[8]
    out[0] = np.log1p(chars)
    out[1:7] = np.array([letters, c[2], c[3], c[6], c[0], c[4] + c[5]]) / max(chars, 1)
    out[7] = c[2] / max(letters, 1)
    words = text.split()
    n = len(words)
    if not n:
        return out
    counts = Counter(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    out[8] = np.log1p(n)
    out[9], out[10], out[11] = lens.mean(), lens.std(), np.log1p(lens.max())
    out[12] = len(counts) / n
    out[13] = counts.most_common(1)[0][1] / n
    out[14] = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    out[15] = len(set(zip(words, words[1:], words[2:], words[3:]))) / max(n - 3, 1)
    # Last and first byte of each word.
    ends = np.cumsum(lens) - 1
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    last, first = CLASSES[joined[ends]], CLASSES[joined[ends - lens + 1]]
    out[16] = (last == 0).mean()
    out[17] = (last == 6).mean()
    out[18] = (first == 2).mean()
    out[19] = (lens == 1).mean()
    lines = text.split(b"\n")
    out[20] = len(lines) / n
    out[21] = len(set(lines)) / len(lines)
    out[22] = text.count(b".") / n
    out[23] = len(set(words[: n // 2]) & set(words[n // 2 :])) / max(len(counts), 1)
    return out


def _features(batch_texts) -> np.ndarray:
    return np.stack([statistics(t.as_py()) for t in batch_texts]) if len(batch_texts) else np.zeros((0, FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **fitting) -> Forest:
    """Fit on the labelled rows outside the held-out fifth: at most sample_rows of them, those of least id hash."""
    sample = (
        labels.where(F.col("quality").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0))
        .select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id", "y")
        .limit(sample_rows)
    )
    # The sample is bounded by sample_rows, so its broadcast is too.
    rows = ids_and_text(docs).join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("id", "y", "text")

    def kernel(batches):
        for b in batches:
            x = _features(b.column(2).cast(pa.binary()))
            cols = [pa.array(x[:, f]) for f in range(FEATURES)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "y", *(f"f{f}" for f in range(FEATURES))])

    schema = "id long, y double, " + ", ".join(f"f{f} double" for f in range(FEATURES))
    got = rows.mapInArrow(kernel, schema).toPandas().to_numpy(dtype=float)
    got = got[np.lexsort(got.T[::-1])] if len(got) else got.reshape(0, FEATURES + 2)
    return fit(got[:, 2:], (got[:, 1] > 0.5).astype(float), **fitting)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the chance that its label is 1."""

    def kernel(batches):
        for b in batches:
            s = forest.probability(_features(b.column(1).cast(pa.binary())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["id", "score"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(kernel, "id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    forest = train(docs, labels, sample_rows)
    (flag,) = fresh(docs, "score")

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        return pd.Series(forest.probability(np.stack([statistics(t.encode("utf-8", "replace")) for t in text])) if len(text) else [], dtype=float)

    ids_and_text(docs)
    return docs.withColumn(flag, scored(F.coalesce(F.col("text"), F.lit("")))).where(F.col(flag) >= threshold).drop(flag)
