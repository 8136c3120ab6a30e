"""Layout blocks: two-pass detection with sentence widening, glyph coverage, text runs, redaction boxes, page SVG.

Input is a glyph table: doc_id, page, block, line, word, glyph (positions), text, left, right, top, bottom, base_x,
base_y, end_x, end_y, point_size, bold, italic, family, angle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.catalog import KINDS, SENTENCE_KINDS
from spanloom.functions.scalars import clamped_point_size, trimmed_number, xml_escaped
from spanloom.functions.spans import islands, let
from spanloom.operators.redact import DEFAULT, candidates
from spanloom.operators.resolve import resolve
from spanloom.options import RedactionOptions

BLOCK = ["doc_id", "page", "block"]
#: Box padding in points, width of a capital per point, least size of a readable label.
PADDING, WIDTH_PER_POINT, LEAST_LABEL = 0.5, 0.72, 4.0


def with_offsets(glyphs: DataFrame) -> DataFrame:
    """Adds start: the glyph's offset in its block's text, where one character stands between words. Point sizes are clamped."""
    if "point_size" in glyphs.columns:
        glyphs = glyphs.withColumn("point_size", clamped_point_size(F.col("point_size")))
    order = Window.partitionBy(*BLOCK).orderBy("line", "word", "glyph")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new_word = (F.lag("line").over(order) != F.col("line")) | (F.lag("word").over(order) != F.col("word"))
    marked = glyphs.withColumn("_before", before).withColumn("_gap", F.coalesce(new_word, F.lit(False)).cast("int"))
    return marked.withColumn("start", (F.col("_before") + F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_before", "_gap")


def block_texts(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, block, text): words joined by spaces, lines by line breaks."""
    words = glyphs.groupBy(*BLOCK, "line", "word").agg(F.array_sort(F.collect_list(F.struct("glyph", "text"))).alias("g"))
    words = words.withColumn("t", F.array_join(F.transform("g", lambda x: x.text), ""))
    lines = words.groupBy(*BLOCK, "line").agg(F.array_sort(F.collect_list(F.struct("word", "t"))).alias("w"))
    lines = lines.withColumn("t", F.array_join(F.transform("w", lambda x: x.t), " "))
    blocks = lines.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("l"))
    return blocks.select(*BLOCK, F.array_join(F.transform("l", lambda x: x.t), "\n").alias("text"))


def _end(d: Column) -> Column:
    return d["start"] + d["length"]


def widened(sentences: Column, tokens: Column, text: Column) -> Column:
    """Each sentence becomes the hull of the chain of overlapping tokens and sentences that it is part of.

    Chains are the islands of the spans in the order of their starts.
    """
    item = lambda sentence: lambda d: F.struct(d["start"].alias("start"), d["length"].alias("length"), F.lit(sentence).alias("s"), d["kind"].alias("kind"))
    every = F.array_sort(F.concat(F.transform(sentences, item(True)), F.transform(tokens, item(False))))

    def hull(chain: Column) -> Column:
        a, z = F.get(chain, F.lit(0))["start"], F.array_max(F.transform(chain, _end))
        kind = F.element_at(F.filter(chain, lambda c: c["s"]), -1)["kind"]
        return F.struct(kind.alias("kind"), a.alias("start"), (z - a).alias("length"), F.substr(text, a + 1, z - a).alias("text"))

    with_sentence = lambda chains: F.filter(chains, lambda c: F.exists(c, lambda x: x["s"]))
    return let(every, lambda e: F.when(F.size(e) > 0, F.transform(with_sentence(islands(e)), hull)).otherwise(F.transform(F.slice(e, 1, 0), lambda x: hull(F.array(x)))))


def merge_passes(text: Column, by_line: Column, across: Column) -> Column:
    """Detections of a block from those of its lines and those of its text with line breaks as spaces (no sentence kinds)."""
    is_sentence = lambda d: d["kind"].isin(*SENTENCE_KINDS)
    sentences, tokens = F.filter(by_line, is_sentence), F.filter(by_line, lambda d: ~is_sentence(d))
    return F.when(text.contains("\n"), resolve(F.concat(tokens, across, widened(sentences, across, text)))).otherwise(by_line)


def detect_blocks(blocks: DataFrame, options: RedactionOptions = DEFAULT, text: str = "text", registry=None) -> DataFrame:
    """blocks with `detections`: identifiers broken over lines are found too, and sentences grow over what they overlap."""
    flat = F.translate(F.col(text), "\n", " ")
    return (
        blocks.withColumn("_c1", candidates(F.col(text), options, registry))
        .withColumn("_c2", candidates(flat, options.without(SENTENCE_KINDS), registry))
        .withColumn("_p1", resolve(F.col("_c1")))
        .withColumn("_p2", resolve(F.col("_c2")))
        .withColumn("detections", merge_passes(F.col(text), F.col("_p1"), F.col("_p2")))
        .drop("_c1", "_c2", "_p1", "_p2")
    )


def covered_glyphs(glyphs: DataFrame, detections: DataFrame) -> DataFrame:
    """Interval join: glyphs (with start) and detections (doc_id, page, block, kind, d_start, d_length) that overlap.

    Both sides meet on the characters that they take, and a pair counts at the first of them, so that the work is that of the
    characters and not of all pairs of a block. Sizes of exploded rows are guessed far too low, so the join is sorted, never broadcast.
    """
    end, d_end = F.col("start") + F.length("text"), F.col("d_start") + F.col("d_length")
    left = glyphs.withColumn("_at", F.explode(F.sequence(F.col("start"), F.greatest(F.col("start"), end - 1))))
    right = detections.where("d_length > 0").withColumn("_at", F.explode(F.sequence(F.col("d_start"), d_end - 1)))
    met = left.join(right.hint("merge"), [*BLOCK, "_at"]).where(F.col("_at") == F.greatest("start", "d_start"))
    return met.where((F.col("start") < d_end) & (F.col("d_start") < end)).drop("_at")


def flat_detections(blocks: DataFrame) -> DataFrame:
    return blocks.select(*BLOCK, F.explode("detections").alias("d")).select(*BLOCK, "d.kind", F.col("d.start").alias("d_start"), F.col("d.length").alias("d_length"))


def text_runs(glyphs: DataFrame, detections: DataFrame) -> DataFrame:
    """Maximal runs of uncovered glyphs inside a word: (.., line, word, run, text, x, y, glyphs). A run that ends its word gets a space.

    Glyphs with a null in their place are left out: no detection meets them.
    """
    place = [*BLOCK, "line", "word"]
    covered = covered_glyphs(glyphs, detections).select(*place, "glyph").distinct()
    ended = glyphs.dropna(subset=place).withColumn("last_glyph", F.max("glyph").over(Window.partitionBy(*place)))
    left = ended.join(covered.hint("merge"), [*place, "glyph"], "left_anti")
    order = Window.partitionBy(*place).orderBy("glyph")
    islands = left.withColumn("run", F.col("glyph") - F.row_number().over(order))
    entry = F.struct("glyph", "text", F.col("base_x").alias("x"), F.col("base_y").alias("y"), "end_x", "end_y")
    out = islands.groupBy(*place, "run", "last_glyph").agg(
        F.array_sort(F.collect_list(entry)).alias("g"),
        *[F.first(c).alias(c) for c in ("point_size", "bold", "italic", "family", "angle")],
    )
    placed = F.transform("g", lambda x: F.struct(x["text"].alias("text"), x["x"].alias("x"), x["y"].alias("y")))
    tail = F.element_at("g", -1)
    space = F.struct(F.lit(" ").alias("text"), tail["end_x"].alias("x"), tail["end_y"].alias("y"))
    placed = F.when(tail["glyph"] == F.col("last_glyph"), F.array_append(placed, space)).otherwise(placed)
    return out.select(*place, "run", placed.alias("glyphs"), "point_size", "bold", "italic", "family", "angle").withColumn("text", F.array_join(F.transform("glyphs", lambda x: x.text), ""))


def redaction_boxes(glyphs: DataFrame, detections: DataFrame, options: RedactionOptions = DEFAULT) -> DataFrame:
    """One padded box for each detection and line; the placeholder, else the kind's label, else nothing fits in as its text."""
    hit = covered_glyphs(glyphs, detections)
    order = F.struct("word", "glyph")
    box = hit.groupBy(*BLOCK, "line", "kind", "d_start").agg(
        (F.min("left") - PADDING).alias("left"),
        (F.max("right") + PADDING).alias("right"),
        (F.max("top") + PADDING).alias("top"),
        (F.min("bottom") - PADDING).alias("bottom"),
        F.min_by(F.struct("base_x", "base_y", "point_size", "angle"), order).alias("a"),
        F.max_by(F.struct("end_x", "end_y"), order).alias("z"),
    )
    dx, dy = F.col("z.end_x") - F.col("a.base_x"), F.col("z.end_y") - F.col("a.base_y")
    box = box.withColumn("extent", F.sqrt(dx * dx + dy * dy) - 2 * PADDING)
    shape = F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, options.placeholder_for(k.name))])
    label = F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, k.label)])
    fit = lambda t: F.least(F.col("a.point_size"), F.col("extent") / (WIDTH_PER_POINT * F.length(t)))
    one, two = F.concat(F.lit(" "), shape[F.col("kind")], F.lit(" ")), F.concat(F.lit(" "), label[F.col("kind")], F.lit(" "))
    pick = lambda x, y, none: F.when(fit(one) >= LEAST_LABEL, x).when(fit(two) >= LEAST_LABEL, y).otherwise(none)
    return box.select(
        *BLOCK, "line", "kind", "d_start", "left", "right", "top", "bottom",
        pick(one, two, F.lit("")).alias("label"),
        pick(fit(one), fit(two), F.lit(0.0)).alias("label_size"),
        F.col("a.base_x").alias("label_x"), F.col("a.base_y").alias("label_y"), F.col("a.angle").alias("angle"),
    )


def _finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def _svg_text(text: Column, x: Column, y: Column, size: Column, family: Column, bold: Column, italic: Column, fill: str, angle: Column) -> Column:
    n = lambda v: trimmed_number(v, 3)
    return F.concat(
        F.lit('<text x="'), n(x), F.lit('" y="'), n(y), F.lit('" font-size="'), n(size), F.lit('" font-family="'), family,
        F.lit(f'" fill="{fill}" xml:space="preserve"'),
        F.when(bold, ' font-weight="bold"').otherwise(""), F.when(italic, ' font-style="italic"').otherwise(""),
        F.when(F.abs(angle) > 0.001, F.concat(F.lit(' transform="rotate('), n(angle), F.lit(" "), n(x), F.lit(" "), n(y), F.lit(')"'))).otherwise(""),
        F.lit(">"), xml_escaped(text), F.lit("</text>"),
    )


def page_svg(pages: DataFrame, runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """pages (doc_id, page, width, height) -> (doc_id, page, svg). y runs downwards; parts without finite geometry are left out.

    Pages may be as many as the corpus has, however small Spark takes them: the joins are sorted, never broadcast.
    """
    key = ["doc_id", "page"]
    g = runs.select(*BLOCK, "line", "word", "run", F.posexplode("glyphs").alias("i", "g"), "point_size", "bold", "italic", "family", "angle").join(pages.hint("merge"), key)
    g = g.where(_finite(F.col("g.x"), F.col("g.y"), F.col("point_size"), F.col("angle")))
    drawn = g.select(*key, F.struct(F.lit(0).alias("layer"), "block", "line", "word", F.col("run").cast("double").alias("a"), F.col("i").cast("double").alias("b")).alias("o"),
        _svg_text(F.col("g.text"), F.col("g.x"), F.col("height") - F.col("g.y"), F.col("point_size"), F.col("family"), F.col("bold"), F.col("italic"), "black", F.col("angle")).alias("e"))
    b = boxes.join(pages.hint("merge"), key).where(_finite(*[F.col(c) for c in ("left", "right", "top", "bottom", "label_x", "label_y", "label_size", "angle")]))
    n = lambda v: trimmed_number(v, 3)
    rect = F.concat(
        F.lit('<rect x="'), n(F.col("left")), F.lit('" y="'), n(F.col("height") - F.col("top")), F.lit('" width="'), n(F.col("right") - F.col("left")),
        F.lit('" height="'), n(F.col("top") - F.col("bottom")), F.lit('" fill="black" />'),
    )
    label = F.when(F.col("label_size") > 0, _svg_text(F.col("label"), F.col("label_x"), F.col("height") - F.col("label_y"), F.col("label_size"), F.lit("sans-serif"), F.lit(False), F.lit(False), "white", F.col("angle"))).otherwise("")
    covers = b.select(*key, F.struct(F.lit(1).alias("layer"), "block", "line", F.lit(0).alias("word"), F.col("d_start").cast("double").alias("a"), F.lit(0.0).alias("b")).alias("o"), F.concat(rect, label).alias("e"))
    body = drawn.unionByName(covers).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "e"))).alias("l"))
    w, h = n(F.col("width")), n(F.col("height"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">'))
    text = F.coalesce(F.array_join(F.transform("l", lambda x: x.e), ""), F.lit(""))
    return pages.join(body.hint("merge"), key, "left").select(*key, F.concat(head, text, F.lit("</svg>")).alias("svg"))


def within_page_limits(pages: DataFrame, max_pages: int = 2000, max_chars: int = 5_000_000) -> DataFrame:
    """pages (doc_id, page, chars) with running characters and `status`: ok, too_many_pages or too_much_text."""
    doc = Window.partitionBy("doc_id")
    running = F.sum("chars").over(doc.orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    out = pages.withColumn("running_chars", running).withColumn("_n", F.count("*").over(doc))
    return out.withColumn("status", F.when(F.col("_n") > max_pages, "too_many_pages").when(F.col("running_chars") > max_chars, "too_much_text").otherwise("ok")).drop("_n")
