"""Changes of paragraphs: replacing, deleting and inserting text, tracked or direct, and
rejecting revisions.

A change returns replacements of the part's bytes and a record of what was done.  Tracked
changes leave the old text under a deletion and put the new under an insertion; whoever
rejects those gets back what was.  What would entangle two authors' revisions, or can't be
undone by rejecting, is refused as a MarkupError with the reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import groupby, pairwise

from foliant.kernels.canon import W
from foliant.kernels.markup import Change, MarkupError, attribute, changed, escaped, located_text, outermost, require_text
from foliant.kernels.paragraphs import REVISIONS, SLIDE, Paragraph, Segment, Stream

# Fixed values.
MOST_ID = 2**31 - 1
TIMESTAMP = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\n?\Z")
TRACKED_PART = re.compile(r"word/(?:document|header\d+|footer\d+|footnotes|endnotes|glossary/document)\.xml\Z")
EDITABLE_PART = re.compile(r"ppt/(?:slides/slide\d+|notesSlides/notesSlide\d+)\.xml\Z")
NOTES_PART = re.compile(r"ppt/notesSlides/notesSlide\d+\.xml\Z")
DISCLOSURE = "direct-mode edit in a revision-capable part"
MIXED = "replacement spans a formatting boundary; the new text carries the run properties of the first covered run"


@dataclass
class Ids:
    """Revision ids in the order they are given out, above those that a package has."""

    next: int
    taken: list[int] = field(default_factory=list)

    def take(self) -> int:
        if self.next > MOST_ID:
            raise MarkupError(f"no revision id is left below {MOST_ID}")
        self.taken.append(self.next)
        self.next += 1
        return self.taken[-1]


@dataclass(frozen=True)
class By:
    """Who changes, when, and whether the change is tracked."""

    author: str
    at: str
    tracked: bool
    ids: Ids | None = None

    def __post_init__(self):
        if not self.author:
            raise MarkupError("the author is empty")
        require_text(self.author, "author")
        if not TIMESTAMP.match(self.at):
            raise MarkupError(f"{self.at!r} is no UTC time in whole seconds")

    @property
    def mode(self) -> str:
        return "tracked" if self.tracked else "direct"


def note_of(part: str, by: By, *notes: str | None) -> str | None:
    """Notes of an operation; a direct change where a reader could expect revisions owes one that says so."""
    owed = None
    if not by.tracked and TRACKED_PART.match(part):
        owed = f"{DISCLOSURE} ({part}): this change carries no revision mark, so a reader of the document does not see it; the record of operations alone accounts for it."
    elif EDITABLE_PART.match(part):
        owed = f"{DISCLOSURE} ({part}): slides have no revision marks at all, so no change of one is ever visible there; the record of operations alone accounts for it."
    return "; ".join(n for n in (*notes, owed) if n) or None


class Writer:
    """How a part writes runs, texts and marks."""

    def __init__(self, stream: Stream):
        self.stream, self.prefix = stream, stream.prefix
        self._word = stream.vocabulary is not SLIDE

    def element(self, local: bytes, body: bytes, attributes: bytes = b"") -> bytes:
        name = self.prefix + local
        return b"<" + name + attributes + b">" + body + b"</" + name + b">"

    def text(self, raw: bytes, local: bytes = b"t") -> bytes:
        return self.element(local, raw, b' xml:space="preserve"' if self._word else b"")

    def run(self, properties: bytes, body: bytes) -> bytes:
        return self.element(b"r", properties + body) if body else b""

    def mark(self, local: bytes, by: By, body: bytes | None = None) -> bytes:
        values = ((b"id", str(by.ids.take()).encode()), (b"author", escaped(by.author, quotes=True)), (b"date", escaped(by.at, quotes=True)))
        written = b"".join(b" " + self.prefix + name + b'="' + value + b'"' for name, value in values)
        return b"<" + self.prefix + local + written + b"/>" if body is None else self.element(local, body, written)

    def properties(self, run: int) -> bytes:
        """A run's properties, which stand first in it."""
        e = self.stream.elements
        first = next(e.children(run), None)
        return e.whole(first) if first is not None and e.name[first] == self.stream.vocabulary.of("rPr") else b""


def _refuse_structures(segments: tuple[Segment, ...] | list[Segment], by: By) -> None:
    """No change inside a row or cell that someone else inserted, or anyone deleted or merged away."""
    for s in segments:
        mark = s.structure
        if mark is not None and (mark.name in ("del", "cellDel") or mark.author != by.author):
            raise MarkupError(f"the text stands in a {'row' if mark.name in ('ins', 'del') else 'cell'} marked {mark.name} by {mark.author or 'unknown'!r} (id {mark.id})")


def _refuse_revisions(segments: list[Segment], by: By) -> None:
    _refuse_structures(segments, by)
    marks = {s.revision for s in segments}
    if len(marks) > 1:
        raise MarkupError("the match straddles a revision's edge")
    mark = marks.pop()
    if mark is None:
        return
    if mark.name != "ins":
        raise MarkupError(f"the match lies inside {'a deletion' if mark.name == 'del' else 'a move'} by {mark.author or 'unknown'!r} (id {mark.id})")
    if mark.author != by.author:
        raise MarkupError(f"the match lies inside an insertion by {mark.author or 'unknown'!r} (id {mark.id}) that is not accepted")


@dataclass(frozen=True)
class Piece:
    run: int
    text: int
    low: int  # bytes of the part
    high: int


def pieces_of(stream: Stream, para: Paragraph, low: int, high: int) -> list[Piece]:
    """The bytes of a match, a piece a text element, or why it can't be cut out."""
    e, v, out = stream.elements, stream.vocabulary, []
    covered = para.covering(low, high)
    if not covered:
        raise MarkupError("the match covers nothing")
    around = para.containers if v is SLIDE else ()
    for s, _, _ in covered:
        if s.kind == "object":
            raise MarkupError("the match spans an object that is no text")
        if s.kind == "deleted":
            raise MarkupError("the match lies inside deleted text")
        if inside := v.forbidden & {*around, *s.containers}:
            raise MarkupError(f"the match lies inside {min(inside).rpartition('}')[2]}")
    if len({s.containers for s, _, _ in covered}) > 1:
        raise MarkupError("the match crosses the edge of a container")
    for s, a, b in covered:
        text = located_text(e.inner(s.row))
        if text.in_cdata(a, b):
            raise MarkupError("the match lies inside a CDATA section")
        first, last = text.bytes_of(a, b)
        out.append(Piece(s.run, s.row, e.body[s.row] + first, e.body[s.row] + last))
    for left, right in pairwise(out):
        gap = (e.end[left.text], e.start[right.text]) if left.run == right.run else (e.end[left.run], e.start[right.run])
        if stream.data[slice(*gap)].strip():
            raise MarkupError("the match spans text with other markup between")
    return out


def replace_at(stream: Stream, para: Paragraph, low: int, high: int, new: str, by: By) -> tuple[list[Change], bool]:
    """Replacements of bytes, and whether the text replaced had more than one format."""
    _refuse_revisions([s for s, _, _ in para.covering(low, high)], by) if stream.vocabulary is not SLIDE else None
    data, e, w = stream.data, stream.elements, Writer(stream)
    pieces = pieces_of(stream, para, low, high)
    runs = [(run, list(own)) for run, own in groupby(pieces, key=lambda p: p.run)]
    properties = [w.properties(run) for run, _ in runs]
    covered = [b"".join(data[p.low : p.high] for p in own) for _, own in runs]
    if "".join(located_text(raw).text for raw in covered) != para.text[low:high]:
        raise MarkupError("the bytes of the match do not read as its text")

    def rest(run: int, own: bytes, text: int, at: int, before: bool) -> bytes:
        """What a run holds before (or after) a place in one of its texts, as a run of its own."""
        local = e.name[text].rpartition("}")[2].encode()
        raw = data[e.body[text] : at] if before else data[at : e.close[text]]
        kept = w.text(raw, local) if raw else b""
        inner = e.end[run + 1] if own else e.body[run]  # properties are a run's first element
        return w.run(own, data[inner : e.start[text]] + kept if before else kept + data[e.end[text] : e.close[run]])

    first, last = pieces[0], pieces[-1]
    head, tail = rest(first.run, properties[0], first.text, first.low, True), rest(last.run, properties[-1], last.text, last.high, False)
    fresh = w.run(properties[0], w.text(escaped(new))) if new else b""
    if by.tracked:
        gone = b"".join(w.run(own, w.text(raw, b"delText")) for own, raw in zip(properties, covered, strict=True) if raw)
        fresh = (w.mark(b"del", by, gone) if gone else b"") + (w.mark(b"ins", by, fresh) if fresh else b"")
    return [(e.start[first.run], e.end[last.run], head + fresh + tail)], len(set(properties)) > 1


def _as_deleted(stream: Stream, low: int, high: int, old: str, new: bytes) -> bytes:
    """A stretch of the part with its text elements under another name."""
    e, out = stream.elements, []
    before = f"{{{W}}}{old}"
    for row in e.rows(before):
        if low <= e.start[row] and e.end[row] <= high:
            name_end = e.start[row] + 1 + len(stream.prefix) + len(old)
            out.append((e.start[row] - low, name_end - low, b"<" + stream.prefix + new))
            if not e.alone(row):
                out.append((e.close[row] - low, e.end[row] - low, b"</" + stream.prefix + new + b">"))
    return changed(stream.data[low:high], out)


def _mark_paragraph(stream: Stream, para: Paragraph, mark: bytes) -> Change:
    """Puts a mark into the properties of a paragraph's own mark, where the schema wants it."""
    e, w = stream.elements, Writer(stream)
    of = lambda local: f"{{{W}}}{local}"
    properties = e.child(para.row, of("pPr"))
    if properties is None:
        return e.body[para.row], e.body[para.row], w.element(b"pPr", w.element(b"rPr", mark))
    if e.alone(properties):
        return e.start[properties], e.end[properties], w.element(b"pPr", w.element(b"rPr", mark))
    own = e.child(properties, of("rPr"))
    if own is None:
        at = next((e.start[k] for k in e.children(properties) if e.name[k] in (of("sectPr"), of("pPrChange"))), e.close[properties])
        return at, at, w.element(b"rPr", mark)
    if e.alone(own):
        return e.start[own], e.end[own], w.element(b"rPr", mark)
    at = next((e.start[k] for k in e.children(own) if e.name[k] != of("ins")), e.close[own])
    return at, at, mark


def delete_paragraph(stream: Stream, para: Paragraph, by: By) -> list[Change]:
    e = stream.elements
    of = lambda local: f"{{{W}}}{local}"
    _refuse_structures(para.segments, by)
    for s in para.segments:
        if s.kind != "object" and s.revision is not None and (by.tracked or s.revision.author != by.author):
            raise MarkupError(f"the paragraph holds a revision by {s.revision.author or 'unknown'!r} (id {s.revision.id}) that is not accepted")
    properties = e.child(para.row, of("pPr"))
    if properties is not None and e.child(properties, of("sectPr")) is not None:
        raise MarkupError("the paragraph ends a section")
    if not by.tracked:
        return [(e.start[para.row], e.end[para.row], b"")]
    own = e.child(properties, of("rPr")) if properties is not None else None
    if own is not None and e.child(own, of("del")) is not None:
        raise MarkupError("the paragraph is marked deleted already")
    w, out = Writer(stream), []
    for run in e.rows(of("r")):
        if e.nearest(run, (of("p"),)) == para.row:
            out.append((e.start[run], e.end[run], w.mark(b"del", by, _as_deleted(stream, e.start[run], e.end[run], "t", b"delText"))))
    return [*out, _mark_paragraph(stream, para, w.mark(b"del", by))]


def insert_paragraph(stream: Stream, index: int, text: str, by: By) -> list[Change]:
    """Beside the paragraph at ``index``, or after the last one."""
    e, w, own = stream.elements, Writer(stream), stream.paragraphs
    if not 0 <= index <= len(own):
        raise MarkupError(f"index {index} is outside 0..{len(own)}")
    if not own:
        raise MarkupError("the part has no paragraph to insert beside")
    if index < len(own):
        _refuse_structures(own[index].segments, by)
    at = e.start[own[index].row] if index < len(own) else e.end[own[-1].row]
    properties = w.element(b"pPr", w.element(b"rPr", w.mark(b"ins", by))) if by.tracked else b""
    body = w.run(b"", w.text(escaped(text))) if text else b""
    if body and by.tracked:
        body = w.mark(b"ins", by, body)
    return [(at, at, w.element(b"p", properties + body))]


def reject(data: bytes, ids: set[int]) -> tuple[bytes, list[str]]:
    """The part as if the revisions with these ids had been rejected, and what could not be."""
    if not ids:
        return data, []
    stream = Stream(data)
    e, out, problems = stream.elements, [], []
    of = lambda local: f"{{{W}}}{local}"
    by_row = {p.row: p for p in stream.paragraphs}
    for row in e.rows(of("ins"), of("del")):
        number = stream.id_of(row)
        if number is None or number not in ids:
            continue
        around = {e.name[k] for k in e.ancestors(row)}
        of_mark = of("rPr") in around and of("pPr") in around
        whole = (e.start[row], e.end[row], b"")
        if not of_mark and not e.alone(row) and e.name[row] == of("del"):
            out.append((*whole[:2], _as_deleted(stream, e.body[row], e.close[row], "delText", b"t")))
        elif not of_mark or e.name[row] == of("del"):
            out.append(whole)
        elif (owner := e.nearest(row, (of("p"),))) is None:
            problems.append(f"the inserted paragraph mark {number} has no paragraph")
        elif left := [s for s in by_row[owner].segments if not (s.revision and s.revision.name == "ins" and s.revision.id in ids)]:
            problems.append(f"the paragraph mark {number} is inserted around {len(left)} segment(s) that are not")
        else:
            out.append((e.start[owner], e.end[owner], b""))
    return changed(data, outermost(out)), problems


def most_id(data: bytes) -> int:
    """The largest id that any element of a Word part has, 0 without any."""
    stream = Stream(data)
    return max((n for k in range(len(stream.elements)) if (n := stream.id_of(k)) is not None), default=0)


def duplicate_ids(data: bytes) -> list[int]:
    """Ids that more than one revision mark has; others, such as bookmarks, may share theirs."""
    stream = Stream(data)
    ids = sorted(n for k in stream.elements.rows(*REVISIONS) if (n := stream.id_of(k)) is not None)
    return sorted({a for a, b in pairwise(ids) if a == b})


def revision_problems(data: bytes) -> list[str]:
    """What makes the revisions of a Word part unsound."""
    stream, out = Stream(data), []
    e = stream.elements
    if repeated := duplicate_ids(data):
        out.append(f"revision ids used more than once: {repeated}")
    for row in range(len(e)):
        if e.name[row] == f"{{{W}}}t" and e.nearest(row, (f"{{{W}}}del",)) is not None:
            out.append(f"plain text inside a deletion at byte {e.start[row]}")
        if e.name[row] in REVISIONS and e.nearest(row, REVISIONS) is not None:
            out.append(f"nested revision marks at byte {e.start[row]}")
    return out


__all__ = ["By", "Ids", "attribute", "delete_paragraph", "insert_paragraph", "most_id", "reject", "replace_at"]
