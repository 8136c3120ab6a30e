"""Word files: a scan that yields text leaves, properties, links and parts as rows, and a sink that writes leaves back.

Only unpacking and packing happen in Python workers (mapInPandas over file bytes); detection and splicing stay in Catalyst.
Each row of the scan is an item of one file; `kind` tells which.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalars import unescaped_link
from spanloom.operators.redact import DEFAULT, applied, detect, long_report
from spanloom.operators.segments import AUTHOR_FIELDS, redacted_link, splice
from spanloom.operators.throughput import DocumentLimits
from spanloom.options import RedactionOptions
from spanloom.scratch import settle

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
SCHEMA = "doc_id string, kind string, part string, para_id int, seg_id int, start int, length int, text string, field string, type string, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Parts with text, in order: the main part, headers, footers, notes, comments.
TEXT_PARTS = re.compile(r"^word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")
CORE_FIELDS = ("creator", "lastModifiedBy", "title", "subject", "keywords", "description", "category", "contentStatus")
PART_TYPES = (
    (re.compile(r"^word/embeddings/.*\.bin$"), "embedded_object"),
    (re.compile(r"^word/embeddings/"), "embedded_package"),
    (re.compile(r"^word/afchunk"), "alternative_import"),
    (re.compile(r"^word/diagrams/data"), "diagram_data"),
)


def leaves(paragraph):
    """(element, text or None, filler): text leaves in order; tabs and breaks are filler that no leaf owns. Inner paragraphs are left out."""
    for child in paragraph:
        tag = child.tag
        if tag == W + "p":
            continue
        if tag in (W + "t", W + "delText", W + "instrText"):
            yield child, child.text or "", ""
        elif tag == W + "tab":
            yield None, None, "\t"
        elif tag in (W + "br", W + "cr"):
            yield None, None, "\n"
        elif tag not in (W + "pPr", W + "rPr"):
            yield from leaves(child)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


#: What a package raises that is no zip, has a part that is cut off, encrypted, compressed in an unknown way or fails its checksum, or no XML.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, KeyError, ValueError, struct.error, ET.ParseError)


def _items(doc_id: str, content: bytes, limits: DocumentLimits):
    def row(kind, part="", para=None, seg=None, start=None, text=None, field=None, type_=None, error=None):
        return (doc_id, kind, part, para, seg, start, None if text is None else len(text), text, field, type_, error)

    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except BROKEN:
        return [row("error", error="invalid")]
    for info in package.infolist():
        if info.file_size > limits.max_decoded_bytes:
            return [row("error", part=info.filename, error="too_large")]
    names = package.namelist()
    if "word/document.xml" not in names:
        return [row("error", error="invalid")]
    out = []
    try:
        for name in sorted(filter(TEXT_PARTS.match, names), key=lambda n: (n != "word/document.xml", n)):
            for p, para in enumerate(ET.fromstring(package.read(name)).iter(W + "p")):
                at, s = 0, 0
                for element, text, filler in leaves(para):
                    if element is None:
                        out.append(row("filler", name, p, s, at, filler))
                        at += len(filler)
                    else:
                        out.append(row("segment", name, p, s, at, text, _local(element.tag)))
                        at += len(text)
                    s += 1
            rels = posixpath.join(posixpath.dirname(name), "_rels", posixpath.basename(name) + ".rels")
            if rels in names:
                for r in ET.fromstring(package.read(rels)).iter(REL + "Relationship"):
                    if r.get("TargetMode") == "External" and r.get("Type", "").endswith("/hyperlink"):
                        out.append(row("link", rels, text=r.get("Target"), field=r.get("Id")))
        for name, fields in (("docProps/core.xml", CORE_FIELDS), ("docProps/app.xml", ("Manager", "Company"))):
            if name in names:
                for e in ET.fromstring(package.read(name)):
                    if _local(e.tag) in fields and e.text:
                        out.append(row("property", name, text=e.text, field=_local(e.tag), type_="lpwstr"))
        if "docProps/custom.xml" in names:
            for prop in ET.fromstring(package.read("docProps/custom.xml")):
                for v in prop:
                    if v.text:
                        out.append(row("property", "docProps/custom.xml", text=v.text, field=prop.get("name"), type_=_local(v.tag)))
        for name in names:
            if name.startswith("word/") and name.endswith(".xml"):
                n = sum(bool(e.get(W + "author")) for e in ET.fromstring(package.read(name)).iter())
                out += [row("author", name, text="author", field="author", type_="attribute")] * n
            for pattern, kind in PART_TYPES:
                if pattern.match(name):
                    out.append(row("part", name, type_=kind))
                    break
    except BROKEN:
        return [row("error", error="invalid")]
    return out


def scan(files: DataFrame, limits: DocumentLimits = DocumentLimits()) -> DataFrame:
    """files (path, content) -> items. A broken or oversized file gives one row with `error` instead of failing the job."""

    def kernel(frames):
        for pdf in frames:
            rows = [item for path, content in zip(pdf["path"], pdf["content"]) for item in _items(path, content, limits)]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("para_id", "seg_id", "start", "length"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(kernel, SCHEMA)


def paragraphs(items: DataFrame) -> DataFrame:
    """(doc_id, part, para_id, text) of paragraphs that have text leaves."""
    own = items.where("kind in ('segment', 'filler')").groupBy("doc_id", "part", "para_id")
    rows = own.agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("s"), F.max((F.col("kind") == "segment").cast("int")).alias("has"))
    return rows.where("has = 1").select("doc_id", "part", "para_id", F.array_join(F.transform("s", lambda x: x.text), "").alias("text"))


def _units(items: DataFrame) -> DataFrame:
    """All texts to look through, one row each: paragraphs, link targets (decoded) and text properties."""
    row = lambda df, unit, para, field, old, text: df.select("doc_id", F.lit(unit).alias("unit"), "part", para.cast("int").alias("para_id"), field.cast("string").alias("field"), old.alias("old"), text.alias("text"))
    none, told = F.lit(None), F.col("text")
    textual = ~F.col("field").isin(*AUTHOR_FIELDS) & ((F.col("part") != "docProps/custom.xml") | F.col("type").isin("lpwstr", "bstr"))
    return (
        row(paragraphs(items), "paragraph", F.col("para_id"), none, told, told)
        .unionByName(row(items.where("kind = 'link'"), "link", none, F.col("field"), told, unescaped_link(told)))
        .unionByName(row(items.where((F.col("kind") == "property") & textual), "property", none, F.col("field"), told, told))
    )


def redact_items(items: DataFrame, options: RedactionOptions = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(edits, report): edits (doc_id, kind, part, para_id, seg_id, field, old, new) of all that changes; report (doc_id, kind, n).

    Detection runs once over all texts; what it found is written to the shared folder and used by edits and report.
    """
    keys = ["doc_id", "part", "para_id"]
    items = settle(items, "word")
    found = settle(detect(_units(items), "text", options).where(F.size("detections") > 0), "word")
    spans = found.where("unit = 'paragraph'").select(*keys, F.explode("detections").alias("d")).select(*keys, "d.kind", F.col("d.start").alias("d_start"), F.col("d.length").alias("d_length"))
    spliced = splice(items.where("kind = 'segment'").select(*keys, "seg_id", "start", "length", "text"), spans, keys, options).where("changed")
    others = found.where("unit <> 'paragraph'").withColumn("new", F.when(F.col("unit") == "link", redacted_link(F.col("old"), F.col("detections"))).otherwise(applied(F.col("text"), F.col("detections"), options)))
    authors_on = F.lit("DocumentAuthor" in options.effective_kinds())
    named = items.where(authors_on & ((F.col("kind") == "author") | ((F.col("kind") == "property") & F.col("field").isin(*AUTHOR_FIELDS) & (F.trim("text") != ""))))
    edits = (
        spliced.select("doc_id", F.lit("segment").alias("kind"), "part", "para_id", "seg_id", F.lit(None).cast("string").alias("field"), F.col("text").alias("old"), F.col("new_text").alias("new"))
        .unionByName(others.select("doc_id", F.col("unit").alias("kind"), "part", "para_id", F.lit(None).cast("int").alias("seg_id"), "field", "old", "new"))
        .unionByName(named.dropDuplicates(["doc_id", "kind", "part", "field"]).select("doc_id", "kind", "part", "para_id", "seg_id", "field", F.col("text").alias("old"), F.lit(options.placeholder_for("DocumentAuthor")).alias("new")))
    )
    authors = named.groupBy("doc_id", F.lit("DocumentAuthor").alias("kind")).agg(F.count("*").alias("n"))
    return edits, long_report(found, ["doc_id"]).unionByName(authors)


def _rewrite(content: bytes, edits: pd.DataFrame) -> bytes:
    source, sink = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    for name in source.namelist():
        for _, (prefix, uri) in ET.iterparse(io.BytesIO(source.read(name)), events=["start-ns"]) if name.endswith((".xml", ".rels")) else ():
            if not re.fullmatch(r"ns\d+", prefix):
                ET.register_namespace(prefix, uri)
    authors = set(edits.loc[edits["kind"] == "author", "part"])
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out:
        for name in source.namelist():
            data, own = source.read(name), edits[edits["part"] == name]
            if authors and name == "word/people.xml":
                continue
            if len(own):
                root = ET.fromstring(data)
                for kind, rows in own.groupby("kind"):
                    if kind == "segment":
                        new = {(int(p), int(s)): t for p, s, t in zip(rows["para_id"], rows["seg_id"], rows["new"])}
                        for p, para in enumerate(root.iter(W + "p")):
                            for s, (element, _, _) in enumerate(list(leaves(para))):
                                if (p, s) in new:
                                    element.text = new[p, s]
                                    element.set(XML_SPACE, "preserve")
                    elif kind == "link":
                        new = dict(zip(rows["field"], rows["new"]))
                        for r in root.iter(REL + "Relationship"):
                            if r.get("Id") in new:
                                r.set("Target", new[r.get("Id")])
                    elif kind == "property":
                        new = {(f, o): t for f, o, t in zip(rows["field"], rows["old"], rows["new"])}
                        for e in root:
                            for v in list(e) or [e]:
                                v.text = new.get((e.get("name") or _local(e.tag), v.text), v.text)
                    else:
                        for e in root.iter():
                            if e.get(W + "author"):
                                e.set(W + "author", rows["new"].iloc[0])
                                e.attrib.pop(W + "initials", None)
                data = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            elif authors and name.endswith(".rels"):
                root = ET.fromstring(data)
                for r in [r for r in root if r.get("Target", "").endswith("people.xml")]:
                    root.remove(r)
                data = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            out.writestr(name, data)
    return sink.getvalue()


def rewrite(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (path, content) with the edits applied: (path, content). A file's edits meet its bytes in one task."""

    def kernel(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(p, _rewrite(c, right)) for p, c in zip(left["path"], left["content"])], columns=["path", "content"])

    return files.select("path", "content").groupBy("path").cogroup(edits.groupBy("doc_id")).applyInPandas(kernel, "path string, content binary")
