"""SPAN: offsets of regex matches as an array<struct<start,length,text>> Column, from one replacing pass and running sums.

Catalyst has no running fold over an array, and a fold that appends copies its list for every element. `running` adds up
blocks, and blocks of blocks, so that an element's sum costs a few short folds however many elements there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,length:int,text:string>>"
#: Noncharacters: never part of interchanged text. Should a text hold one, it is scanned as MASK.
OPEN, VALUE, CLOSE, MASK = "﷐", "﷑", "﷒", "﷓"
#: Elements of a block are 2 to the power of this.
BITS = 6
BLOCK = 1 << BITS


def empty() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, length: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), text.alias("text"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_of(value: Column, words) -> Column:
    """Membership in a fixed list, which is one folded literal."""
    return F.array_contains(F.split(F.lit("\x1f".join(words)), "\x1f"), value)


def blocked(values: Column, size=BLOCK) -> Column:
    """A bound array that is not empty -> the array of its blocks of `size` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"), F.lit(1)), lambda k: F.slice(values, k * size + 1, F.lit(size) if isinstance(size, int) else size))


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array that is not empty the join of zero and all before it; join is associative, zero its identity."""
    fold = lambda part, at: F.aggregate(part, at, join)
    totals = lambda v: F.transform(blocked(v), lambda b: fold(b, zero))

    def before(v: Column, t: Column, u: Column, i: Column) -> Column:
        block, outer = F.shiftright(i, BITS), F.shiftright(i, 2 * BITS)
        whole = fold(F.slice(t, F.shiftleft(outer, BITS) + 1, block.bitwiseAND(BLOCK - 1)), fold(F.slice(u, F.lit(1), outer), zero))
        return fold(F.slice(v, F.shiftleft(block, BITS) + 1, i.bitwiseAND(BLOCK - 1)), whole)

    return let(values, lambda v: let(totals(v), lambda t: let(totals(t), lambda u: F.transform(v, lambda x, i: before(v, t, u, i)))))


def islands(sorted_spans: Column) -> Column:
    """A bound array of structs with start and length, sorted by start and not empty -> its maximal chains of overlapping spans."""
    seen = running(F.transform(sorted_spans, lambda s: s["start"] + s["length"]), F.lit(-1), lambda a, b: F.greatest(a, b))
    heads = lambda z: F.filter(F.sequence(F.lit(0), F.size(sorted_spans) - 1), lambda i: F.get(sorted_spans, i)["start"] >= F.get(z, i))
    chain = lambda h, head, k: F.slice(sorted_spans, head + 1, F.coalesce(F.get(h, k + 1), F.size(sorted_spans)) - head)
    return let(let(seen, heads), lambda h: F.transform(h, lambda head, k: chain(h, head, k)))


def spliced(text: Column, edits: Column) -> Column:
    """edits: array of structs (a, z, put), ordered, disjoint, not empty: the text's characters from a up to z, then put; all joined.

    A substring costs the characters before it, so the text is cut by blocks of edits first.
    """

    def pieces(t: Column, b: Column) -> Column:
        base = F.get(b, F.lit(0))["a"]
        return F.array_join(F.transform(b, lambda x: F.concat(F.substr(t, x["a"] - base + 1, x["z"] - x["a"]), x["put"])), "")

    part = lambda b: F.substr(text, F.get(b, F.lit(0))["a"] + 1, F.element_at(b, -1)["z"] - F.get(b, F.lit(0))["a"])
    size = lambda e: F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(e))).cast("int"))
    return let(edits, lambda e: F.array_join(F.transform(blocked(e, size(e)), lambda b: let(part(b), lambda t: pieces(t, b))), ""))


def find(text: Column, pattern: str, lead: str = "", value: str = "$0", only_if: Column | None = None) -> Column:
    """Spans of all matches. `lead` and `value` are replacement strings: what of a match lies before its span, and the span.

    A match must be lead + value + rest, with the rest outside the span dropped by the pattern (look-ahead).
    Offsets are code points. Texts for which only_if is not true are not scanned.
    """
    clean = F.when(text.contains(OPEN) | text.contains(VALUE) | text.contains(CLOSE), F.translate(text, OPEN + VALUE + CLOSE, MASK * 3)).otherwise(text)
    marked = F.regexp_replace(clean, pattern, f"{OPEN}{lead}{VALUE}{value}{CLOSE}")

    def located(parts: Column) -> Column:
        # Each piece after the first is lead VALUE span CLOSE gap.
        cut = lambda p: let(F.split(p, f"[{VALUE}{CLOSE}]"), lambda t: F.struct(F.length(t[0]).alias("lead"), t[1].alias("text"), F.length(t[1]).alias("size"), F.length(t[2]).alias("gap")))
        rows = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), cut)
        before = lambda r: running(F.transform(r, lambda x: x["lead"] + x["size"] + x["gap"]), F.lit(0), lambda a, b: a + b)
        first = F.length(F.get(parts, F.lit(0)))
        return let(rows, lambda r: let(first, lambda n: F.transform(before(r), lambda at, i: span(n + at + F.get(r, i)["lead"], F.get(r, i)["size"], F.get(r, i)["text"]))))

    none = F.array(F.lit(""))
    pieces = F.split(marked, OPEN) if only_if is None else F.when(only_if, F.split(marked, OPEN)).otherwise(none)
    return let(F.coalesce(pieces, none), lambda parts: F.when(F.size(parts) > 1, located(parts)).otherwise(empty()))


def keep(spans: Column, valid) -> Column:
    """Spans whose text passes `valid`, a function of Columns."""
    return F.filter(spans, lambda s: valid(s["text"]))
