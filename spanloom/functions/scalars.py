"""Scalar functions: durations, sizes, fonts, angles, links, XML-safe text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(seconds: Column) -> Column:
    """`1d 2h 3m 4s` from the first unit that is needed; negative counts as 0, halves round to even, non-finite is an error."""
    s = seconds.cast("double")
    bad = F.isnan(s) | s.isin(float("inf"), float("-inf"))
    n = F.when(bad, F.raise_error(F.lit("Duration must be a finite number of seconds.")).cast("long")).otherwise(F.rint(F.greatest(F.lit(0.0), s)).cast("long"))
    part = lambda x: F.floor(x).cast("string")
    sec, minute, hour, day = part(n % 60), part(n % 3600 / 60), part(n % 86400 / 3600), part(n / 86400)
    return (
        F.when(n < 60, F.concat(sec, F.lit("s")))
        .when(n < 3600, F.concat(minute, F.lit("m "), sec, F.lit("s")))
        .when(n < 86400, F.concat(hour, F.lit("h "), minute, F.lit("m "), sec, F.lit("s")))
        .otherwise(F.concat(day, F.lit("d "), hour, F.lit("h "), minute, F.lit("m "), sec, F.lit("s")))
    )


def trimmed_number(x: Column, places: int) -> Column:
    """Fixed notation with at most `places` decimals and no trailing zeros."""
    text = F.format_string(f"%.{places}f", F.round(x.cast("double"), places))
    return F.regexp_replace(F.regexp_replace(text, r"\.?0+$", ""), "^-0$", "0") if places else text


def format_bytes(n: Column) -> Column:
    kb, mb = F.lit(1024), F.lit(1048576)
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(trimmed_number(n / kb, 1), F.lit(" KB")))
        .otherwise(F.concat(trimmed_number(n / mb, 1), F.lit(" MB")))
    )


def remaining(estimate: Column, elapsed: Column) -> Column:
    return F.greatest(F.lit(0.0), estimate - elapsed)


def thousands(n: Column) -> Column:
    """A whole number with commas between its groups of three digits, as messages show sizes and limits."""
    return F.format_number(n, 0)


#: Parts of font names that tell the family.
SERIF = ("times", "serif", "georgia", "garamond", "book", "cambria", "palatino", "minion", "roman", "baskerville", "caslon", "century")
MONOSPACE = ("courier", "mono", "consolas", "menlo", "code")


def font_family(font: Column) -> Column:
    """Family of a PDF font name; the subset prefix up to the first plus does not count."""
    name = F.lower(F.regexp_replace(F.coalesce(font, F.lit("")), r"^[^+]*\+", ""))
    return (
        F.when(name.rlike("|".join(MONOSPACE)), "monospace")
        .when(name.contains("sans"), "sans-serif")
        .when(name.rlike("|".join(SERIF)), "serif")
        .otherwise("sans-serif")
    )


def angle_degrees(base_x: Column, base_y: Column, end_x: Column, end_y: Column) -> Column:
    """Clockwise angle of a baseline in [0, 360), three decimals; a baseline without length has angle 0."""
    dx, dy = end_x - base_x, end_y - base_y
    turned = F.pmod(F.round(-F.degrees(F.atan2(dy, dx)), 3), F.lit(360.0)) + F.lit(0.0)  # no negative zero
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(turned)


def clamped_point_size(size: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(400.0), size))


def unescaped_link(target: Column) -> Column:
    """Percent-decoded; a plus stays a plus and malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)


def xml_safe(text: Column) -> Column:
    """Characters that XML 1.0 does not allow become U+FFFD."""
    return F.regexp_replace(text, "[^\\x09\\x0A\\x0D\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]", "�")


def xml_escaped(text: Column) -> Column:
    out = xml_safe(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
