"""PII by bootstrapped contextual extraction.

Base spans come from four fixed patterns (email, ip, card, phone), found by linear scans of whole texts. They seed a
bootstrap, as do long hexadecimal secrets: every identifier-like token (it has digits or an at sign) is an instance met
under a lexical pattern, the two words before it. Groups of digits after single blanks belong to the token before them, so a
number that happens to follow an identifier is taken as part of it. Over the bipartite graph of patterns and instances Spark alternates

    score(pattern, kind)  = share of the pattern's occurrences that are believed instances of the kind
    belief(instance, kind) = 1 for seeds, else 1 - prod(1 - score(pattern, kind)) over its patterns with support

for a fixed number of rounds. A pattern has support in a round if at least `support` distinct instances under it are seeds
of the kind or have a belief of `confidence` or more, whether or not a seed was met there: what one round finds can bear new
patterns in the next. Patterns with support and a score of `confidence` or more in the last round are trusted: every token
under them is a span of that kind, if it meets no base span.

Defined results: null and empty texts have no spans; ids may be null or repeated, each row has its own result; rows
that repeat id and text share what was discovered; an empty table gives no rows; `redact` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, ids_and_text, small
from spanloom.scratch import discard, settle

KINDS = ("email", "ip", "card", "phone")
SEED_KINDS = (*KINDS, "secret")
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.5

#: The base patterns. A start inside a run of digits could only fail where the run's own start fails.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}(?![0-9A-Za-z])")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: An identifier-like token: a run without white space, quotes or brackets that has a digit or an at sign.
TOKEN = re.compile(r"[^\s\"'<>\[\]{}|,;]+")
#: A token runs on over a single blank to a group of digits after digits, and over the bank's letters in an IBAN.
GROUP = re.compile(
    r"(?:(?<=[0-9)])\x20(?=[0-9]|\([0-9]+\))|(?<=\b[A-Z]{2}[0-9]{2})\x20(?=[A-Z]{4}\x20[0-9]{4})|(?<=\b[A-Z]{2}[0-9]{2}\x20[A-Z]{4})\x20(?=[0-9]{4}))"
    r"[^\s\"'<>\[\]{}|,;]+"
)
#: Characters besides blanks that joined groups have at most: those of the longest IBAN.
LONGEST = 34
WORD = re.compile(r"\S+")
DIGIT_OR_AT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern: around each at sign the longest run of local characters not used before, then the domain."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; offsets are code points."""
    if not DIGIT_OR_AT.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        size = m.end() - m.start() - m[0].count(" ") - m[0].count("-")
        if 13 <= size <= 19 and luhn(m[0].replace(" ", "").replace("-", "")):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, str, str, int, int]]:
    """(pattern, instance, seed kind or '', start, end): seeds, and identifier-like tokens outside them, with the words before."""
    if not DIGIT_OR_AT.search(text):
        return []
    seeds = sorted([(a, b, k) for k, a, b in base] + [(m.start(), m.end(), "secret") for m in SECRET.finditer(text)])
    found = []
    covered, high = [], -1
    for a, b, k in seeds:
        if a >= high:
            found.append((a, b, k))
            high = b
        covered.append((a, b))
    i = 0
    for m in DIGIT_OR_AT.finditer(text):
        p = m.start()
        if p < i:
            continue
        while covered and covered[0][1] <= p:
            covered.pop(0)
        if covered and covered[0][0] <= p:
            i = covered[0][1]
            continue
        a = p
        while a > i and TOKEN.match(text[a - 1]):
            a -= 1
        b = TOKEN.match(text, p).end()
        limit = covered[0][0] if covered else len(text)
        size = b - a
        while (m := GROUP.match(text, b)) and m.end() <= limit and (size := size + m.end() - b - 1) <= LONGEST:
            b = m.end()
        i = b
        while b > p and text[b - 1] in ".:!?)*#$%&":
            b -= 1
        if b > limit:
            continue
        found.append((a, b, ""))
    out = []
    for a, b, k in found:
        before = words_before(text, a)
        pattern = " ".join(w.lower().strip("\"'([{<*#$%&!|") for w in before)
        out.append((pattern.strip(), text[a:b], k, a, b))
    return out


#: Characters before a candidate in which the words of its pattern stand.
CONTEXT = 160


def words_before(text: str, at: int) -> list[str]:
    """The last two words before a place, by white space. Of a word that reaches back beyond CONTEXT characters its end stands for it.

    So a pattern is short whatever the text, also in one without any white space.
    """
    return WORD.findall(text[max(0, at - CONTEXT) : at])[-2:]


SCAN = "id long, key string, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, found array<struct<pattern:string,instance:string,seed:string,a:int,b:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: counts and base spans, and what the bootstrap needs; key is a digest of the text."""

    def kernel(batches):
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
        one = pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
        names = ["id", "key", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "found"]
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = base_spans(t)
                line = ",".join(f"{k}:{x}:{y}" for k, x, y in spans)
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                found = [dict(zip(("pattern", "instance", "seed", "a", "b"), c)) for c in candidates(t, spans)]
                key = hashlib.md5(t.encode("utf-8", "replace")).hexdigest() if found else ""
                rows.append((doc, key, *n, line, hashlib.sha256(line.encode()).hexdigest(), found))
            cols = list(zip(*rows)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, pa.list_(one)])], names=names)

    return ids_and_text(docs, id_col, text_col).mapInArrow(kernel, SCAN)


def trusted(met: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """met (pattern, instance, seed) occurrences -> (pattern, kind) that the bootstrap trusts; one kind for a pattern, the best."""
    graph = settle(
        met.where("pattern <> ''").groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph"
    )
    total = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = settle(graph.where("seed <> ''").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct(), "seeds")
    known = seeds.select("instance", F.lit(True).alias("known")).distinct()
    edges = graph.select("pattern", "instance", "n").join(total, "pattern").join(known, "instance", "left")
    edges = settle(edges.withColumn("known", F.coalesce("known", F.lit(False))), "edges")
    belief, beliefs = seeds, []
    for i in range(rounds):
        # Every pattern of an instance with belief is scored anew, so that instances found in one round bear patterns of the next.
        score = (
            edges.join(belief, "instance")
            .groupBy("pattern", "kind")
            .agg((F.sum(F.col("n") * F.col("belief")) / F.max("total")).alias("score"), F.count_if(F.col("belief") >= confidence).alias("believed"))
            .where(F.col("believed") >= support)
        )
        if i + 1 < rounds:
            noisy = edges.where("not known").join(score, "pattern").groupBy("instance", "kind")
            noisy = noisy.agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(1 - 1e-9)))))).alias("belief"))
            belief = settle(noisy.unionByName(seeds), "belief")
            beliefs.append(belief)
    best = F.max_by("kind", F.struct("score", "kind"))
    out = settle(score.where(F.col("score") >= confidence).groupBy("pattern").agg(best.alias("kind")), "patterns")
    for t in (graph, seeds, edges, *beliefs):
        discard(t)
    return out


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap) -> DataFrame:
    """(id, key, counts, base, base_sha256, added array<struct<kind,a,b>>, spans) for every row of docs."""
    scanned = settle(scan(docs, id_col, text_col), "pii")
    met = scanned.where(F.size("found") > 0).select("id", "key", F.explode("found").alias("f")).select("id", "key", "f.*")
    patterns = trusted(met, **bootstrap)
    added = (
        met.where(~F.col("seed").isin(*KINDS))
        .join(patterns, "pattern", "left")
        .withColumn("kind", F.when(F.col("seed") == "", F.col("kind")).otherwise(F.col("seed")))
        .where("kind is not null")
        .groupBy(F.col("id").alias("add_id"), F.col("key").alias("add_key"))
        .agg(F.array_sort(F.collect_set(F.struct("kind", "a", "b"))).alias("added"))
    )
    on = scanned.id.eqNullSafe(added.add_id) & (scanned.key == added.add_key)
    out = scanned.join(added, on, "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:string,a:int,b:int>>")))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")),
    )
    ranked = F.transform(
        F.concat(base, F.col("added")),
        lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in SEED_KINDS]), s.kind).alias("rank"), s.a.alias("a"), s.kind.alias("kind"), s.b.alias("b")),
    )
    out = out.withColumn("all", F.array_sort(ranked))
    spans = F.array_join(F.transform("all", lambda s: F.concat_ws(":", s.kind, s.a, s.b)), ",")
    return out.select("id", "key", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "added", spans.alias("spans"))


def masked(text: str, spans: str) -> str:
    """text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", **bootstrap) -> DataFrame:
    """docs with the spans of each text masked (and n_chars set to the new length where docs has it); rows without spans are untouched."""
    ids_and_text(docs, id_col, text_col)
    (spans,) = fresh(docs, "spans")
    found = extract(docs, id_col, text_col, **bootstrap).where("spans <> ''").select("id", "key", F.col("spans").alias(spans)).distinct()
    found = settle(found, "found")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    on = F.col(id_col).cast("long").eqNullSafe(found.id) & (F.md5(whole) == found.key)

    @F.pandas_udf("string")
    def mask(text, spans):
        import pandas as pd

        return pd.Series([t if s is None else masked(t, s) for t, s in zip(text, spans)], dtype=object)

    # Whole texts are shuffled only where the spans are too many to be broadcast.
    out = docs.join(small(found, "key", spans), on, "left").drop(found.id, found.key)
    out = out.withColumn(text_col, mask(F.col(text_col), F.col(spans)))
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(F.col(spans).isNull(), F.col(n_chars_col)).otherwise(F.length(text_col)).cast(docs.schema[n_chars_col].dataType))
    return out.select(*docs.columns)
