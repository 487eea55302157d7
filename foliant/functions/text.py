"""Scalar column functions over text, names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DIGEST = r"^sha256:[0-9a-f]{64}\z"
SESSION_ID = r"^[0-9a-f]{32}\z"
SHA256_ANY_CASE = r"^(sha256:)?[0-9a-fA-F]{64}\z"
RFC_3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\n?\z"
ILLEGAL_XML = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
LEGAL_XML_RUN = r"^([\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]*)"
SNIPPET_RADIUS, MOST_QUERY_CHARS = 80, 512
MOST_RESULTS, RESULTS = 500, 50
LEAST_TTL, MOST_TTL, TTL = 60, 86_400, 3_600
MOST_NAME_CHARS = 255
MAIN_PARTS = {".docx": "word/document.xml", ".dotx": "word/document.xml", ".pptx": "ppt/presentation.xml", ".potx": "ppt/presentation.xml", ".xlsx": "xl/workbook.xml", ".xlsm": "xl/workbook.xml"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest_of(data) -> Column:
    """``sha256:`` and the hex digest of text or bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(_c(data).cast("binary"), 256))


def is_digest(x) -> Column:
    return _c(x).rlike(DIGEST)


def escape(x) -> Column:
    """Markup escapes of ``&``, ``<`` and ``>``; quotes stay."""
    return F.replace(F.replace(F.replace(_c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(x) -> Column:
    return F.replace(escape(x), F.lit('"'), F.lit("&quot;"))


def unescape(x) -> Column:
    """The five named entities, ``&amp;`` last."""
    out = _c(x)
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def illegal_xml_at(x) -> Column:
    """Index of the first code point that XML 1.0 does not allow, null if there is none."""
    return F.when(_c(x).rlike(ILLEGAL_XML), F.length(F.regexp_extract(_c(x), LEGAL_XML_RUN, 1)))


def as_int(x) -> Column:
    return F.trim(_c(x)).try_cast("int")


def kind_of(name) -> Column:
    """docx, pptx or xlsx by suffix; null for others."""
    suffix = F.lower(F.regexp_extract(_c(name), r"(\.[^./]*)\z", 1))
    return F.when(suffix.isin(".docx", ".dotx"), "docx").when(suffix.isin(".pptx", ".potx"), "pptx").when(suffix.isin(".xlsx", ".xlsm"), "xlsx")


def import_name_reason(name) -> Column:
    """Why a bare document name is refused, null if it is fine; the first rule that fails."""
    x = _c(name)
    return (
        F.when(x.isNull(), "missing")
        .when(F.length(x) > MOST_NAME_CHARS, "too long")
        .when(x.rlike(r"[\x00-\x1f\x7f]"), "control character")
        .when(x.rlike(r"[/\\]|^[A-Za-z]:"), "a path")
        .when(x.rlike(r"^[.~]") | x.rlike(r"(?U)^\s|\s\z"), "leading or trailing mark")
        .when(kind_of(x).isNull(), "unsupported container")
    )


def query_reason(query) -> Column:
    x = _c(query)
    return F.when(x.isNull() | (F.length(x) == 0), "empty").when(F.length(x) > MOST_QUERY_CHARS, "too long").when(x.contains("\0"), "NUL")


def as_sha256(x) -> Column:
    """A digest from 64 hex digits in any case, with or without its prefix and spaces around; null for others."""
    bare = F.regexp_replace(F.lower(F.trim(_c(x))), r"^sha256:", "")
    return F.when(bare.rlike(r"^[0-9a-f]{64}\z"), F.concat(F.lit("sha256:"), bare))


def part_reason(part, available) -> Column:
    """Why a name is no part of a package whose names are given; how it is written first, then whether it is there."""
    x = _c(part)
    odd = x.startswith("/") | x.contains("\\") | F.array_contains(F.split(x, "/"), "..") | x.rlike("^.:")
    return F.when(x.isNull() | (x == ""), "empty").when(x.contains("\0"), "NUL").when(odd, "no part name").when(~F.array_contains(available, x), "no such part")


def within_roots(path, roots: list[str]) -> Column:
    """Whether a path without ``..`` steps is a root or below one."""
    out = F.lit(False)
    for root in roots:
        bare = root.rstrip("/")
        out = out | (_c(path) == bare) | _c(path).startswith(bare + "/")
    return out & ~F.array_contains(F.split(_c(path), "/"), "..")


def export_path_reason(path, roots: list[str], store: str) -> Column:
    """Why a receipt may not be written to a path: outside the roots, in a store, over a document, not .json."""
    x = _c(path)
    in_store = F.exists(F.split(F.lower(x), "/"), lambda s: s == store.lower())
    return (
        F.when(x.isNull() | (x == ""), "empty").when(x.startswith("~"), "'~' is not expanded").when(~within_roots(x, roots), "outside the roots").when(in_store, "inside the store")
        .when(kind_of(x).isNotNull(), "a document").when(~F.lower(x).endswith(".json"), "not .json")
    )


def bounded(x, low: int, high: int, default: int) -> Column:
    """A number or its default; null if out of bounds."""
    value = F.coalesce(_c(x), F.lit(default))
    return F.when(value.between(low, high), value)


def resolve_target(source, target) -> Column:
    """Relationship target from a source part, as a part name; null where it is refused: empty, a
    folder, a backslash, a second character that makes a drive, or a way out of the package.  From the
    root, steps upwards stay there."""
    t, rooted = _c(target), _c(target).startswith("/")
    base = F.when(rooted, F.lit("")).otherwise(F.regexp_replace(_c(source), r"[^/]*\z", ""))
    steps = F.filter(F.split(F.concat(base, t), "/"), lambda s: (s != "") & (s != "."))
    # '..' below the root leaves a mark that can't be popped
    popped = F.aggregate(
        steps,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(F.lit("..")))),
    )
    popped = F.when(rooted, F.array_remove(popped, "..")).otherwise(popped)
    bare = F.trim(t)
    refused = (t == "") | F.rtrim(t).endswith("/") | bare.isin(".", "..") | t.contains("\\") | t.rlike("^.:") | F.array_contains(popped, "..") | (F.size(popped) == 0)
    return F.when(~refused, F.array_join(popped, "/"))


def rels_part(source) -> Column:
    """The part that holds a part's relationships."""
    return F.concat(F.regexp_replace(_c(source), r"[^/]*\z", ""), F.lit("_rels/"), F.regexp_extract(_c(source), r"([^/]*)\z", 1), F.lit(".rels"))
