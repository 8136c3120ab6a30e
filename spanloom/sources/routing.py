"""Formats by file name and media type, and names of outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Fixed values: (format, extensions, media types, extension and type of the output).
FORMATS = (
    ("text", (".txt", ".text", ".md", ".csv", ".log"), ("text/plain", "text/markdown", "text/csv"), ".txt", "text/plain"),
    ("word", (".docx",), (DOCX_TYPE,), ".docx", DOCX_TYPE),
    ("pdf", (".pdf",), ("application/pdf",), ".pdf", "application/pdf"),
)


def _checked(formats):
    """The table, unless two formats claim one extension or media type."""
    for column in (1, 2):
        claimed = [x.lower() for f in formats for x in f[column]]
        if len(claimed) != len(set(claimed)):
            raise ValueError("two formats claim " + ", ".join(sorted({x for x in claimed if claimed.count(x) > 1})))
    return formats


def _lookup(pairs) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


_checked(FORMATS)


def format_of(file_name: Column, content_type: Column) -> Column:
    """By extension first, else by media type without its parameters; null if neither is known."""
    ext = F.lower(_extension(file_name))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.coalesce(_lookup([(e, f[0]) for f in FORMATS for e in f[1]])[ext], _lookup([(t, f[0]) for f in FORMATS for t in f[2]])[kind])


def _extension(file_name: Column) -> Column:
    return F.regexp_extract(F.coalesce(file_name, F.lit("")), r"(\.[^./\\]*)$", 1)


def unsupported_message(file_name: Column, content_type: Column) -> Column:
    """Names what a file was taken for, by its extension, else its media type, and what there is; null for a known format."""
    known = ", ".join(sorted(e for f in FORMATS for e in f[1]))
    kind = F.nullif(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)), F.lit(""))
    seen = F.coalesce(F.nullif(_extension(file_name), F.lit("")), kind, F.lit("unknown"))
    told = F.concat(F.lit("No processor for '"), seen, F.lit(f"'; known are {known}"))
    return F.when(format_of(file_name, content_type).isNull(), told)


def output_name(file_name: Column, fmt: Column) -> Column:
    """stem-redacted plus the format's own extension; an empty stem is `document`."""
    base = F.regexp_extract(F.coalesce(file_name, F.lit("")), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    ext = _lookup([(f[0], f[3]) for f in FORMATS])[fmt]
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit("-redacted"), ext)
