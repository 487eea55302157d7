"""The elements of a markup part as columns, its text, and changes of its bytes.

A part is read once by expat, into a table with a row an element in document order.
Everything else is lookups in that table and offsets into the part's own bytes, which are
never built anew: a change is a list of replacements at offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MarkupError(ValueError):
    """What can't be read, found or changed, and why."""


_START_TAG = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""")
_ATTRIBUTE = re.compile(rb"""\s+([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_TAG_NAME = re.compile(rb"<([^\s/>]+)")


def attributes(tag: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Name, raw value, start (with the space before) and end of each attribute of a start tag."""
    for m in _ATTRIBUTE.finditer(tag):
        yield m[1], m[2] if m[2] is not None else m[3], m.start(), m.end()


def attribute(tag: bytes, name: bytes) -> bytes | None:
    return next((value for own, value, _, _ in attributes(tag) if own == name), None)


class Elements:
    """A row an element, in document order: ``name`` ({space}local), ``start`` of its start
    tag, ``body`` after it, ``close`` where its end tag begins, ``end`` after that,
    ``parent`` (-1: none), ``depth``, and ``last``, the last row inside it.

    An element without an end tag of its own has body, close and end at one place.
    Raises MarkupError for what is not well-formed or declares a document type.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.name: list[str] = []
        self.start: list[int] = []
        self.body: list[int] = []
        self.close: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.last: list[int] = []
        reader, open_ = expat.ParserCreate(namespace_separator="}"), [-1]

        def opened(name: str, _) -> None:
            at, row = reader.CurrentByteIndex, len(self.name)
            tag = _START_TAG.match(data, at)
            if tag is None:
                raise MarkupError(f"no tag at byte {at}")
            self.name.append("{" + name if "}" in name else name)
            self.parent.append(open_[-1])
            self.depth.append(len(open_) - 1)
            self.start.append(at)
            for column in (self.body, self.close, self.end):
                column.append(tag.end())
            self.last.append(row)
            open_.append(row)

        def closed(_) -> None:
            row = open_.pop()
            self.last[row] = len(self.name) - 1
            if data[self.body[row] - 2] != 0x2F:  # else it closes itself: its last bytes are />
                self.close[row] = reader.CurrentByteIndex
                self.end[row] = data.index(b">", self.close[row]) + 1

        def refused(*_) -> None:
            raise MarkupError("document type declarations are refused")

        reader.StartElementHandler, reader.EndElementHandler, reader.StartDoctypeDeclHandler = opened, closed, refused
        try:
            reader.Parse(data, True)
        except MarkupError:
            raise
        except (expat.ExpatError, ValueError, LookupError) as bad:  # encodings that expat doesn't know are ValueErrors
            raise MarkupError(str(bad)) from None

    def __len__(self) -> int:
        return len(self.name)

    def rows(self, *names: str) -> list[int]:
        return [k for k, n in enumerate(self.name) if n in names]

    def tag(self, row: int) -> bytes:
        return self.data[self.start[row] : self.body[row]]

    def inner(self, row: int) -> bytes:
        return self.data[self.body[row] : self.close[row]]

    def whole(self, row: int) -> bytes:
        return self.data[self.start[row] : self.end[row]]

    def alone(self, row: int) -> bool:
        return self.end[row] == self.body[row]

    def inside(self, row: int) -> range:
        return range(row + 1, self.last[row] + 1)

    def children(self, row: int) -> Iterator[int]:
        at = row + 1
        while at <= self.last[row]:
            yield at
            at = self.last[at] + 1

    def child(self, row: int, name: str) -> int | None:
        return next((k for k in self.children(row) if self.name[k] == name), None)

    def ancestors(self, row: int) -> Iterator[int]:
        """From the parent outwards."""
        while (row := self.parent[row]) >= 0:
            yield row

    def nearest(self, row: int, names: Iterable[str]) -> int | None:
        return next((k for k in self.ancestors(row) if self.name[k] in names), None)

    def prefix_of(self, space: str) -> bytes | None:
        """How the first element of a vocabulary writes it: ``w:``, or nothing for a default one; None if there is none."""
        head = "{" + space + "}"
        row = next((k for k, n in enumerate(self.name) if n.startswith(head)), None)
        if row is None:
            return None
        written = _TAG_NAME.match(self.tag(row))[1]
        return written.split(b":", 1)[0] + b":" if b":" in written else b""

    def declared_prefix(self, space: str) -> bytes | None:
        """The first prefix that any element declares for a vocabulary."""
        for row in range(len(self)):
            if b"xmlns:" in (tag := self.tag(row)):
                for name, value, _, _ in attributes(tag):
                    if name.startswith(b"xmlns:") and value == space.encode():
                        return name[6:] + b":"
        return None


Change = tuple[int, int, bytes]


def changed(data: bytes, changes: Iterable[Change]) -> bytes:
    """Replacements (start, end, new bytes) at offsets of the original; overlaps are refused."""
    out, at = [], 0
    for start, end, new in sorted(changes, key=lambda c: c[:2]):
        if start < at or end < start or end > len(data):
            raise MarkupError(f"change {start}:{end} overlaps another or is out of bounds")
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:]])


def outermost(changes: Iterable[Change]) -> list[Change]:
    """Without those that begin inside another."""
    out: list[Change] = []
    for change in sorted(changes, key=lambda c: (c[0], -c[1])):
        if not out or change[0] >= out[-1][1]:
            out.append(change)
    return out


#: Entities that XML names, and the longest reference that is read, with its marks.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
LONGEST_REFERENCE = 16

_TOKEN = re.compile(r"<!\[CDATA\[(?P<cdata>.*?)\]\]>|&(?P<reference>[^;&<]*);|(?P<plain>[^&<]+)", re.S)
_NUMBER = re.compile(r"#(?:[xX](?P<hex>[0-9a-fA-F]+)|(?P<decimal>[0-9]+))\Z")
_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def require_text(text: str, what: str = "text") -> str:
    """Text that XML 1.0 allows in a document, or MarkupError with the first place that it doesn't."""
    if (bad := _ILLEGAL.search(text)) is not None:
        raise MarkupError(f"{what} holds U+{ord(bad[0]):04X} at {bad.start()}, which XML does not allow")
    return text


def escaped(text: str, quotes: bool = False) -> bytes:
    out = require_text(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return (out.replace('"', "&quot;") if quotes else out).encode()


def _referred(body: str) -> str:
    if body in NAMED:
        return NAMED[body]
    number = _NUMBER.match(body)
    if number is None or len(body) + 2 > LONGEST_REFERENCE:
        raise MarkupError(f"reference &{body[:LONGEST_REFERENCE]}; is not known")
    code = int(number["hex"], 16) if number["hex"] else int(number["decimal"])
    if code > 0x10FFFF or _ILLEGAL.match(chr(code)):
        raise MarkupError(f"code point {code} is not allowed")
    return chr(code)


@dataclass(frozen=True)
class Text:
    """Decoded character data: where each character's bytes begin and end, and which stand in CDATA sections."""

    text: str
    begins: tuple[int, ...]
    ends: tuple[int, ...]
    cdata: tuple[tuple[int, int], ...]

    def bytes_of(self, low: int, high: int) -> tuple[int, int]:
        """The bytes of characters low to high; of none, the place where they would be."""
        if not 0 <= low <= high <= len(self.text):
            raise MarkupError(f"characters {low}:{high} are out of bounds")
        return (self.begins[low], self.begins[low] if low == high else self.ends[high - 1])

    def in_cdata(self, low: int, high: int) -> bool:
        return any(a <= low < b if low == high else a < high and low < b for a, b in self.cdata)


def _tokens(raw: bytes) -> Iterator[tuple[str, str, str]]:
    """Kind, source and text of the pieces of character data."""
    try:
        source = raw.decode("utf-8")
    except UnicodeDecodeError as bad:
        raise MarkupError(f"text is not UTF-8: {bad}") from None
    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise MarkupError(f"markup or an open reference at {at} of a text")
        kind, at = m.lastgroup, m.end()
        yield kind, m[0], _referred(m[kind]) if kind == "reference" else require_text(m[kind])


def decode_text(raw: bytes) -> str:
    """Character data with references and CDATA sections resolved; what XML does not allow is refused."""
    return "".join(text for _, _, text in _tokens(raw))


def located_text(raw: bytes) -> Text:
    chars, begins, ends, cdata, at = [], [], [], [], 0
    for kind, source, text in _tokens(raw):
        size = len(source.encode())
        if kind == "reference":
            chars.append(text)
            begins.append(at)
            ends.append(at + size)
        else:
            inner = at + (len("<![CDATA[") if kind == "cdata" else 0)
            if kind == "cdata":
                cdata.append((len(chars), len(chars) + len(text)))
            for char in text:
                chars.append(char)
                begins.append(inner)
                inner += len(char.encode())
                ends.append(inner)
        at += size
    return Text("".join(chars), (*begins, len(raw)), tuple(ends), tuple(cdata))


def as_int(raw: bytes | None) -> int | None:
    try:
        return None if raw is None else int(raw)
    except ValueError:
        return None


_ELEMENTS = pa.schema([("doc", pa.string()), ("part", pa.string()), ("row", pa.int32()), ("parent", pa.int32()), ("name", pa.string()), ("start", pa.int32()), ("body", pa.int32()), ("close", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("reason", pa.string())])


def parts_of(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("doc").cast("string").alias("doc"), "part", F.col("data").cast("binary").alias("data"))


def each_part(batches: Iterator[pa.RecordBatch], schema: pa.Schema, read) -> Iterator[pa.RecordBatch]:
    """``read(doc, part, data)`` gives a part's rows; one that is refused gives one row with a reason.  Null data is an empty part."""
    for batch in batches:
        rows = []
        for doc, part, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "part", "data")), strict=True):
            try:
                rows += [{"doc": doc, "part": part} | r for r in read(doc, part, data or b"")]
            except MarkupError as bad:
                rows.append({"doc": doc, "part": part, "reason": str(bad)})
        yield pa.RecordBatch.from_pylist(rows, schema)


def element_rows(parts: DataFrame) -> DataFrame:
    """A row an element of parts (doc, part, data); a refused part gives one row with a reason."""

    def read(doc, part, data):
        e = Elements(data)
        return [{"row": k} | {c: getattr(e, c)[k] for c in ("parent", "name", "start", "body", "close", "end", "depth")} for k in range(len(e))]

    return parts_of(parts).mapInArrow(lambda b: each_part(b, _ELEMENTS, read), "doc string, part string, row int, parent int, name string, start int, body int, close int, end int, depth int, reason string")
