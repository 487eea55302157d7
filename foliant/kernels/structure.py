"""What parts refer to each other: relationships, slides, sheets; and text elements with their addresses."""

from __future__ import annotations

import re
from posixpath import normpath

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.kernels.canon import W
from foliant.kernels.markup import Elements, MarkupError, as_int, attribute, attributes, decode_text, each_part, parts_of
from foliant.kernels.paragraphs import A, P, SLIDE, WORD, Stream

# Fixed values.
RELATIONSHIP = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PRESENTATION, WORKBOOK = "ppt/presentation.xml", "xl/workbook.xml"
WORKSHEET_PART = re.compile(r"xl/worksheets/sheet\d+\.xml\Z")
_NOTES = re.compile(r"ppt/notesSlides/notesSlide\d+\.xml\Z")


def rels_part(source: str) -> str:
    folder, _, name = source.rpartition("/")
    return f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"


def source_of(rels: str) -> str:
    return rels.removesuffix(".rels").replace("_rels/", "", 1) if rels.startswith("_rels/") else rels.removesuffix(".rels").replace("/_rels/", "/", 1)


def target_part(source: str, target: str) -> str:
    """The part that a target names, from its source's folder."""
    if not target or "\\" in target or target[1:2] == ":":
        raise MarkupError(f"target {target!r} of {source!r} names no part")
    if target.rstrip().endswith("/") or target.strip() in (".", ".."):
        raise MarkupError(f"target {target!r} of {source!r} names a folder")
    folder = source.rpartition("/")[0]
    path = normpath(target).lstrip("/") if target.startswith("/") else normpath(f"{folder}/{target}" if folder else target)
    if path in ("", ".", "..") or path.startswith(("/", "../")):
        raise MarkupError(f"target {target!r} of {source!r} leaves the package")
    return path


def relationships(source: str, data: bytes) -> list[dict]:
    """ord, id, type, target, target_part (null for external ones) and external, in the order of the file."""
    e, out = Elements(data), []
    for ord_, row in enumerate(e.rows(RELATIONSHIP)):
        id_, kind, target = (attribute(e.tag(row), n) for n in (b"Id", b"Type", b"Target"))
        if id_ is None or kind is None or target is None:
            raise MarkupError(f"a relationship of {source!r} lacks its id, type or target")
        external, target = attribute(e.tag(row), b"TargetMode") == b"External", decode_text(target)
        out.append({"ord": ord_, "id": decode_text(id_), "type": kind.decode("utf-8", "replace"), "target": target, "target_part": None if external else target_part(source, target), "external": external})
    return out


def _rel_id(tag: bytes) -> str | None:
    return next((decode_text(value) for name, value, _, _ in attributes(tag) if name.endswith(b":id")), None)


def listed_slides(data: bytes) -> list[dict]:
    """ord, slide_id, rel_id of a presentation's list; entries without an id are left out but counted."""
    e = Elements(data)
    found = [(k, attribute(e.tag(row), b"id"), _rel_id(e.tag(row))) for k, row in enumerate(e.rows(f"{{{P}}}sldId"))]
    return [{"ord": k, "slide_id": int(decode_text(i)), "rel_id": r} for k, i, r in found if i is not None]


def listed_sheets(data: bytes) -> list[dict]:
    """ord, name, sheet_id, rel_id of a workbook's sheets in order; those without a name are left out."""
    e, out = Elements(data), []
    for row in e.rows(f"{{{S}}}sheet"):
        name, number = attribute(e.tag(row), b"name"), attribute(e.tag(row), b"sheetId")
        if name is not None:
            out.append({"ord": len(out), "name": decode_text(name), "sheet_id": as_int(number), "rel_id": _rel_id(e.tag(row))})
    return out


def _of_package(package: dict[str, bytes], source: str) -> list[dict]:
    return relationships(source, package[rels_part(source)]) if rels_part(source) in package else []


def slides_of(package: dict[str, bytes]) -> list[dict]:
    by_id = {r["id"]: r["target_part"] for r in _of_package(package, PRESENTATION) if r["type"] == f"{OFFICE}/slide"}
    return [s | {"part": by_id.get(s["rel_id"])} for s in listed_slides(package.get(PRESENTATION, b""))]


def slide_of(package: dict[str, bytes], part: str) -> int | None:
    """A slide's id by its part, or by that of the slide that a notes page belongs to."""
    ids = {s["part"]: s["slide_id"] for s in slides_of(package)}
    if part in ids or not _NOTES.match(part):
        return ids.get(part)
    return next((ids[r["target_part"]] for r in _of_package(package, part) if r["type"] == f"{OFFICE}/slide" and r["target_part"] in ids), None)


def broken_relationships(package: dict[str, bytes]) -> list[str]:
    """Slides without a part, and internal targets that are not there."""
    if PRESENTATION not in package:
        return [f"{PRESENTATION} is missing, so there is no list of slides"]
    out = [f"slide {s['slide_id']} at {s['ord']} has no part" for s in slides_of(package) if s["part"] is None]
    for source in ["", *sorted(package)]:
        try:
            out += [f"{rels_part(source)}: {r['id']} names {r['target_part']}, which is not there" for r in _of_package(package, source) if not r["external"] and r["target_part"] not in package]
        except MarkupError as bad:
            out.append(f"{rels_part(source)}: {bad}")
    return out


_RELATIONSHIPS = pa.schema([("doc", pa.string()), ("part", pa.string()), ("source", pa.string()), ("ord", pa.int32()), ("id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("target_part", pa.string()), ("external", pa.bool_()), ("reason", pa.string())])


def relationship_rows(parts: DataFrame) -> DataFrame:
    """A row a relationship of the .rels parts among (doc, part, data); a part that is refused gives one with a reason."""
    read = lambda doc, part, data: [r | {"source": source_of(part)} for r in relationships(source_of(part), data)]
    ddl = "doc string, part string, source string, ord int, id string, type string, target string, target_part string, external boolean, reason string"
    return parts_of(parts.where("part like '%.rels'")).mapInArrow(lambda b: each_part(b, _RELATIONSHIPS, read), ddl)


_LISTED = pa.schema([("doc", pa.string()), ("part", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("number", pa.int64()), ("rel_id", pa.string()), ("reason", pa.string())])


def listed_rows(parts: DataFrame) -> DataFrame:
    """Slides and sheets as presentations and workbooks list them: doc, part, ord, name, number (slide or sheet id), rel_id, reason."""

    def read(doc, part, data):
        if part == PRESENTATION:
            return [{"ord": s["ord"], "number": s["slide_id"], "rel_id": s["rel_id"]} for s in listed_slides(data)]
        return [{"ord": s["ord"], "name": s["name"], "number": s["sheet_id"], "rel_id": s["rel_id"]} for s in listed_sheets(data)]

    return parts_of(parts.where(parts["part"].isin(PRESENTATION, WORKBOOK))).mapInArrow(lambda b: each_part(b, _LISTED, read), "doc string, part string, ord int, name string, number long, rel_id string, reason string")


_TEXTS = pa.schema([("doc", pa.string()), ("part", pa.string()), ("ord", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("para_index", pa.int32()), ("para_id", pa.string()), ("para_hash", pa.string()), ("shared_string_index", pa.int32()), ("ref", pa.string()), ("reason", pa.string())])


def text_elements(part: str, data: bytes, kind: str) -> list[dict]:
    """Text elements that are not empty, in order, with the address of the paragraph, string or cell around each."""
    names = {"docx": (f"{{{W}}}t", f"{{{W}}}delText"), "pptx": (f"{{{A}}}t",), "xlsx": (f"{{{S}}}t",)}[kind]
    e, out = Elements(data), []
    wanted = [k for k in e.rows(*names) if e.inner(k)]
    if not wanted:
        return out
    stream = Stream(data, SLIDE if kind == "pptx" else WORD) if kind != "xlsx" else None
    paragraphs = {p.row: p for p in stream.paragraphs} if stream else {}
    strings = {row: k for k, row in enumerate(e.rows(f"{{{S}}}si"))} if part == "xl/sharedStrings.xml" else {}
    for ord_, row in enumerate(wanted):
        own = {"ord": ord_, "text": decode_text(e.inner(row)), "start": e.body[row], "end": e.close[row]}
        around = next((k for k in e.ancestors(row) if k in paragraphs or k in strings), None)
        if around in paragraphs:
            para = paragraphs[around]
            own |= {"para_index": para.index, "para_id": para.para_id, "para_hash": para.hash}
        elif around is not None:
            own["shared_string_index"] = strings[around]
        elif WORKSHEET_PART.match(part) and (cell := e.nearest(row, (f"{{{S}}}c",))) is not None:
            ref = attribute(e.tag(cell), b"r")
            own["ref"] = decode_text(ref) if ref else None
        out.append(own)
    return out


def text_rows(parts: DataFrame, kind: str) -> DataFrame:
    """A row a text element of parts of one kind of document; a part that is refused gives one with a reason."""
    ddl = "doc string, part string, ord int, text string, start int, end int, para_index int, para_id string, para_hash string, shared_string_index int, ref string, reason string"
    return parts_of(parts).mapInArrow(lambda b: each_part(b, _TEXTS, lambda doc, part, data: text_elements(part, data, kind)), ddl)
