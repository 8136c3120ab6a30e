"""Layout queries on tables whose exploded rows Spark takes for a few bytes."""

import pytest

from spanloom.operators import blocks
from spanloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", ["glyph_boxes", "text_runs", "page_svg"])
def test_layout_joins_are_not_broadcast(spark, name):
    """Glyphs come from exploded texts, whose size Spark guesses from the keys alone: a broadcast of them fills the driver."""
    assert broadcasts(catalogue.QUERIES[name](spark, SF)) == 0


def test_text_runs_leave_out_glyphs_without_place(spark):
    """No detection meets a glyph with a null in its place, so it must not come out as plain text."""
    row = "values (1L, 'a'), (cast(null as bigint), 's') as t(doc_id, text)"
    glyphs = spark.sql(
        "select doc_id, 1 as page, 0 as block, 0 as line, 0 as word, 0 as glyph, text, 0 as start, 0d as base_x, 0d as base_y, 6d as end_x, 0d as end_y, "
        f"11d as point_size, false as bold, false as italic, 'serif' as family, 0d as angle from {row}"
    )
    found = spark.sql("select doc_id, 1 as page, 0 as block, 'Date' as kind, 0 as d_start, 1 as d_length from values (2L), (cast(null as bigint)) as t(doc_id)")
    assert [(r.doc_id, r.text) for r in blocks.text_runs(glyphs, found).collect()] == [(1, "a ")]


def test_page_svg_detects_once(spark):
    """Runs and boxes read one settled table of detections."""
    assert any("spanloom-spans" in f for f in catalogue.page_svg(spark, SF).inputFiles())
