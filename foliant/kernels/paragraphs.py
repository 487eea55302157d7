"""Paragraphs of markup parts as text streams.

A paragraph's stream is the text of its runs put together, with one character for
each object, so that no phrase matches across an image.  A run belongs to its nearest
paragraph.  What a segment stands in (run, revision, containers, row and cell marks) comes
from columns that are filled in one pass over the elements, each row from its parent's.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.kernels.canon import W
from foliant.kernels.markup import Elements, MarkupError, as_int, attribute, decode_text, each_part, parts_of

# Vocabularies, what an object reads as, marks that revise and those that hang on rows and cells.
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
W14 = "http://schemas.microsoft.com/office/word/2010/wordml"
ALTERNATE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}AlternateContent"
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}oMath"
MARKER = "￼"
WORD_OBJECTS = {
    "drawing": MARKER, "pict": MARKER, "object": MARKER, "footnoteReference": MARKER, "endnoteReference": MARKER, "commentReference": MARKER, "fldChar": MARKER, "sym": MARKER,
    "br": "\n", "cr": "\n", "tab": "\t", "noBreakHyphen": "‑", "softHyphen": "­",
}
SLIDE_OBJECTS = {"br": "\n", "fld": MARKER}
REVISIONS = frozenset(f"{{{W}}}{x}" for x in ("ins", "del", "moveFrom", "moveTo"))
PROPERTY_MARKS = {f"{{{W}}}trPr": ("ins", "del"), f"{{{W}}}tcPr": ("cellIns", "cellDel", "cellMerge")}


@dataclass(frozen=True)
class Vocabulary:
    space: str
    texts: dict[str, str]  # local names of text elements, with the kind of their segments
    objects: dict[str, str]
    forbidden: frozenset[str]  # no edit inside these

    def of(self, local: str) -> str:
        return f"{{{self.space}}}{local}"


WORD = Vocabulary(W, {"t": "text", "delText": "deleted"}, WORD_OBJECTS, frozenset((ALTERNATE, MATH)))
SLIDE = Vocabulary(A, {"t": "text"}, SLIDE_OBJECTS, frozenset((ALTERNATE,)))


@dataclass(frozen=True)
class Mark:
    """A revision, or a mark on the row or cell around a segment."""

    name: str  # local
    author: str | None
    id: int | None


@dataclass(frozen=True)
class Segment:
    kind: str  # text, deleted or object
    text: str
    row: int
    run: int | None = None
    revision: Mark | None = None
    structure: Mark | None = None
    containers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Paragraph:
    index: int
    row: int
    para_id: str | None
    shape_id: int | None
    containers: tuple[str, ...]
    segments: tuple[Segment, ...]

    @property
    def text(self) -> str:
        return "".join(s.text for s in self.segments)

    @property
    def hash(self) -> str:
        return "sha256:" + sha256(self.text.encode()).hexdigest()

    def covering(self, low: int, high: int) -> list[tuple[Segment, int, int]]:
        """Segments that overlap [low, high), each with the overlap in its own text."""
        out, at = [], 0
        for s in self.segments:
            if at < high and low < at + len(s.text):
                out.append((s, max(low - at, 0), min(high - at, len(s.text))))
            at += len(s.text)
        return out


class Stream:
    """The paragraphs of one part, with its elements and how it writes its vocabulary."""

    def __init__(self, data: bytes, vocabulary: Vocabulary = WORD):
        self.data, self.vocabulary = data, vocabulary
        self.elements = e = Elements(data)
        self.prefix = e.prefix_of(vocabulary.space)
        if self.prefix is None and vocabulary is WORD:
            raise MarkupError("the part has no element of a Word document")
        if self.prefix == b"" and vocabulary is WORD:
            raise MarkupError("the part binds its vocabulary as default namespace, so its attributes would be in none")
        id_prefix = e.declared_prefix(W14)
        self._para_id = id_prefix + b"paraId" if id_prefix is not None else None
        self.paragraphs = self._read()

    def mark(self, row: int) -> Mark:
        author = attribute(tag := self.elements.tag(row), self.prefix + b"author")
        return Mark(self.elements.name[row].rpartition("}")[2], None if author is None else author.decode(), self.id_of(row, tag))

    def id_of(self, row: int, tag: bytes | None = None) -> int | None:
        return as_int(attribute(tag or self.elements.tag(row), self.prefix + b"id"))

    def _structures(self) -> dict[int, int]:
        """Row or cell -> the last mark in its properties that says it is inserted, deleted or merged."""
        e, out = self.elements, {}
        for prop, names in PROPERTY_MARKS.items():
            for row in e.rows(prop):
                holder = e.nearest(row, (f"{{{W}}}tr", f"{{{W}}}tc"))
                for mark in e.inside(row):
                    if holder is not None and e.name[mark] in {f"{{{W}}}{n}" for n in names}:
                        out[holder] = max(mark, out.get(holder, -1))
        return out

    def _read(self) -> list[Paragraph]:
        e, v = self.elements, self.vocabulary
        n = len(e)
        paragraph, run, objects = v.of("p"), v.of("r"), {v.of(k): x for k, x in v.objects.items()}
        texts = {v.of(k): x for k, x in v.texts.items()}
        shape = f"{{{P}}}sp"
        # of what stands around each row: nearest paragraph, run, revision, marked row or cell, shape; whether an object
        owner, runs, marks, held, shapes, in_object = ([-1] * n for _ in range(6))
        marked = self._structures() if v is WORD else {}
        found: dict[int, list[Segment]] = {}
        shape_ids: dict[int, int | None] = {}
        for row in range(n):
            up = e.parent[row]
            if up >= 0:
                name = e.name[up]
                owner[row] = up if name == paragraph else owner[up]
                runs[row] = up if name == run else runs[up]
                marks[row] = up if v is WORD and name in REVISIONS else marks[up]
                held[row] = marked.get(up, held[up])
                shapes[row] = up if name == shape else shapes[up]
                in_object[row] = 1 if name in objects else in_object[up]
            name = e.name[row]
            if name == paragraph:
                found[row] = []
            elif name == f"{{{P}}}cNvPr" and shapes[row] >= 0:
                shape_ids.setdefault(shapes[row], as_int(attribute(e.tag(row), b"id")))
            elif owner[row] >= 0 and ((name in texts and runs[row] >= 0) or (name in objects and in_object[row] < 0)):
                found[owner[row]].append(
                    Segment(
                        texts.get(name, "object"), decode_text(e.inner(row)) if name in texts else objects[name], row, runs[row] if name in texts else None,
                        self.mark(marks[row]) if marks[row] >= 0 else None, self.mark(held[row]) if held[row] >= 0 else None, self._between(row, owner[row], run),
                    )
                )
        out = []
        for index, (row, segments) in enumerate(found.items()):
            raw = attribute(e.tag(row), self._para_id) if self._para_id is not None else None
            out.append(Paragraph(index, row, raw.decode("ascii", "replace") if raw else None, shape_ids.get(shapes[row]) if shapes[row] >= 0 else None, tuple(e.name[k] for k in e.ancestors(row))[::-1], tuple(segments)))
        return out

    def _between(self, row: int, paragraph: int, run: str) -> tuple[str, ...]:
        """Containers between a paragraph and a segment, from the outside in; runs and revisions are none."""
        e, out = self.elements, []
        for k in e.ancestors(row):
            if k == paragraph:
                break
            if e.name[k] != run and e.name[k] not in REVISIONS:
                out.append(e.name[k])
        return tuple(reversed(out))

    def at_address(self, para_id: str | None = None, index: int | None = None, digest: str | None = None) -> Paragraph:
        """By id, or by index with the hash of its text: an index alone would name another paragraph after any change."""
        if para_id is not None:
            para = next((p for p in self.paragraphs if p.para_id == para_id), None)
            if para is None:
                raise MarkupError(f"no paragraph has the id {para_id!r}")
        elif index is None:
            raise MarkupError("an address needs a paragraph's id, or its index with its hash")
        elif not 0 <= index < len(self.paragraphs):
            raise MarkupError(f"paragraph index {index} is outside 0..{len(self.paragraphs) - 1}")
        elif digest is None:
            raise MarkupError(f"paragraph index {index} without a hash is no stable address")
        else:
            para = self.paragraphs[index]
        if digest is not None and para.hash != digest:
            raise MarkupError(f"the address is stale: paragraph {para.index} has another text now")
        return para

    def matches(self, needle: str, within: list[Paragraph] | None = None) -> list[tuple[Paragraph, int]]:
        """Paragraph and offset of every match from left to right that overlaps none before it."""
        if not needle:
            raise MarkupError("the needle is empty")
        out = []
        for para in self.paragraphs if within is None else within:
            text, at = para.text, -len(needle)
            while (at := text.find(needle, at + len(needle))) >= 0:
                out.append((para, at))
        return out


def vocabulary_of(part: str) -> Vocabulary:
    return SLIDE if part.startswith("ppt/") else WORD


def paragraphs(data: bytes, vocabulary: Vocabulary = WORD) -> list[Paragraph]:
    return Stream(data, vocabulary).paragraphs


_SEGMENT = pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("revision", pa.string()), ("author", pa.string()), ("revision_id", pa.int32()), ("structure", pa.string()), ("containers", pa.list_(pa.string()))])
_ROWS = pa.schema([("doc", pa.string()), ("part", pa.string()), ("idx", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("para_id", pa.string()), ("shape_id", pa.int32()), ("text", pa.string()), ("text_hash", pa.string()), ("containers", pa.list_(pa.string())), ("segments", pa.list_(_SEGMENT)), ("reason", pa.string())])
_DDL = (
    "doc string, part string, idx int, start int, end int, para_id string, shape_id int, text string, text_hash string, containers array<string>, "
    "segments array<struct<kind:string,text:string,start:int,end:int,revision:string,author:string,revision_id:int,structure:string,containers:array<string>>>, reason string"
)


def paragraph_rows(parts: DataFrame) -> DataFrame:
    """A row a paragraph of parts (doc, part, data), slides' parts by their names; a refused part
    gives one row with a reason, null data counting as an empty part, which is refused."""

    def read(doc, part, data):
        stream = Stream(data, vocabulary_of(part))
        e = stream.elements
        for p in stream.paragraphs:
            segments = [
                {"kind": s.kind, "text": s.text, "start": e.start[s.row], "end": e.end[s.row], "structure": s.structure and s.structure.name, "containers": s.containers}
                | ({"revision": s.revision.name, "author": s.revision.author, "revision_id": s.revision.id} if s.revision else {})
                for s in p.segments
            ]
            yield {"idx": p.index, "start": e.start[p.row], "end": e.end[p.row], "para_id": p.para_id, "shape_id": p.shape_id, "text": p.text, "text_hash": p.hash, "containers": p.containers, "segments": segments}

    return parts_of(parts).mapInArrow(lambda b: each_part(b, _ROWS, read), _DDL)
