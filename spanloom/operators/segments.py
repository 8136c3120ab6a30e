"""Segment splice: detections over a paragraph are written back into the text leaves that make it up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.catalog import KINDS
from spanloom.operators.redact import DEFAULT
from spanloom.options import RedactionOptions


def splice(segments: DataFrame, detections: DataFrame, keys: list[str], options: RedactionOptions = DEFAULT) -> DataFrame:
    """segments (keys, seg_id, start, length, text) x detections (keys, kind, d_start, d_length) -> segments with `new_text` and `changed`.

    The placeholder goes where the detection starts; later leaves lose what it covers; untouched leaves keep their text.
    Both sides meet on the paragraph's keys with the overlap as the join's residual condition.
    """
    shape = F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, options.placeholder_for(k.name))])
    s, d = segments.alias("s"), detections.alias("d")
    meets = (F.col("d.d_start") < F.col("s.start") + F.col("s.length")) & (F.col("s.start") < F.col("d.d_start") + F.col("d.d_length"))
    on = [F.col(f"s.{k}") == F.col(f"d.{k}") for k in keys]
    cond = meets
    for c in on:
        cond = cond & c
    cut = F.struct(
        F.greatest(F.col("d.d_start") - F.col("s.start"), F.lit(0)).alias("a"),
        F.least(F.col("d.d_start") + F.col("d.d_length") - F.col("s.start"), F.col("s.length")).alias("z"),
        F.when(F.col("d.d_start") >= F.col("s.start"), shape[F.col("d.kind")]).otherwise("").alias("put"),
    )
    cuts = s.join(d, cond).groupBy(*[F.col(f"s.{k}") for k in keys], F.col("s.seg_id")).agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    out = segments.join(cuts, [*keys, "seg_id"], "left")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("cuts"), i - 1)["z"])
    parts = F.transform("cuts", lambda c, i: F.concat(F.substr("text", before(i) + 1, c["a"] - before(i)), c["put"]))
    tail = F.substr("text", F.element_at("cuts", -1)["z"] + 1)
    new = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return out.withColumn("new_text", new).withColumn("changed", F.col("cuts").isNotNull()).drop("cuts")


def redacted_link(target: Column, detections: Column) -> Column:
    """A hyperlink target with anything found in it leads nowhere."""
    return F.when(F.size(detections) > 0, "about:blank").otherwise(target)


#: Document properties that hold a person, and those that hold text.
AUTHOR_FIELDS = ("creator", "lastModifiedBy", "Manager", "author")


def redact_properties(properties: DataFrame, options: RedactionOptions = DEFAULT) -> DataFrame:
    """(doc_id, scope, field, value, type) -> with new_value and counts: authors become the author placeholder, texts are redacted."""
    from spanloom.operators.redact import redact

    authors = "DocumentAuthor" in options.effective_kinds()
    is_author = F.col("field").isin(*AUTHOR_FIELDS)
    textual = (F.col("scope") != "custom") | F.col("type").isin("lpwstr", "bstr")
    subject = F.when(is_author | ~textual, None).otherwise(F.col("value"))
    found = redact(properties.withColumn("_subject", subject), "_subject", options, "_redacted", "_detections")
    named = is_author & (F.trim(F.coalesce("value", F.lit(""))) != "") & F.lit(authors)
    return found.select(
        *properties.columns,
        F.when(named, options.placeholder_for("DocumentAuthor")).otherwise(F.coalesce("_redacted", "value")).alias("new_value"),
        F.when(named, 1).otherwise(F.col("total")).alias("n"),
    )


def warnings(parts: DataFrame) -> DataFrame:
    """(doc_id, part_type) -> (doc_id, warning): what of a package is left unchanged, one sentence a group of part types."""
    embedded = F.sum(F.col("part_type").isin("embedded_object", "embedded_package").cast("int"))
    imported = F.sum(F.col("part_type").isin("alternative_import", "diagram_data").cast("int"))
    counted = parts.groupBy("doc_id").agg(embedded.alias("e"), imported.alias("i"))
    one = F.when(F.col("e") > 0, F.concat(F.col("e").cast("string"), F.when(F.col("e") == 1, " embedded object stays").otherwise(" embedded objects stay"),
        F.lit(" as before: files inside the package are not opened or redacted.")))
    two = F.when(F.col("i") > 0, F.concat(F.col("i").cast("string"), F.when(F.col("i") == 1, " imported or diagram part stays").otherwise(" imported or diagram parts stay"),
        F.lit(" as before: text of imports and diagrams is not redacted.")))
    return counted.select("doc_id", F.explode(F.array_compact(F.array(one, two))).alias("warning"))
