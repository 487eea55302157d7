import pytest

from foliant.kernels.canon import is_default_content, normalize, normalized_parts
from foliant.kernels.markup import Elements, MarkupError, attribute, attributes, changed, decode_text, element_rows, escaped, located_text, outermost, require_text

W = b'<w:d xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml">'


def test_elements_are_byte_exact():
    data = "<a><b c=\"x>y\">é</b><d/><e  f='/'></e></a>".encode()
    e = Elements(data)
    assert e.name == ["a", "b", "d", "e"] and e.parent == [-1, 0, 0, 0] and e.depth == [0, 1, 1, 1] and e.last == [3, 1, 2, 3]
    assert e.whole(1).decode() == '<b c="x>y">é</b>' and e.inner(1).decode() == "é" and e.tag(1) == b'<b c="x>y">'
    assert e.alone(2) and e.whole(2) == b"<d/>" and not e.alone(3) and e.inner(3) == b""
    assert list(e.children(0)) == [1, 2, 3] and list(e.inside(0)) == [1, 2, 3] and e.nearest(2, ["a"]) == 0
    assert changed(data, []) == data


@pytest.mark.parametrize("bad", [b"<!DOCTYPE a><a/>", b"<a>", b"", b"\x00", '<?xml version="1.0" encoding="Shift_JIS"?><a>x</a>'.encode(), b'<?xml version="1.0" encoding="nothing-known"?><a/>'])
def test_what_is_no_part_is_refused(bad):
    with pytest.raises(MarkupError):
        Elements(bad)


def test_text_and_where_it_stands():
    raw = b"a&amp;\xc3\xa9&#x2013;<![CDATA[<&\xc3\xa9]]>z"
    assert decode_text(raw) == "a&é–<&éz"
    text = located_text(raw)
    assert text.text == "a&é–<&éz" and raw[slice(*text.bytes_of(1, 4))] == b"&amp;\xc3\xa9&#x2013;" and raw[slice(*text.bytes_of(4, 7))] == b"<&\xc3\xa9"
    assert text.in_cdata(6, 8) and not text.in_cdata(0, 4) and text.in_cdata(5, 5) and not text.in_cdata(7, 7) and text.bytes_of(8, 8) == (len(raw),) * 2
    for bad in (b"&nbsp;", b"&amp", b"&#0;", b"&#xD800;", b"&;", b"&#;", b"\xff", b"a<b", b"&#" + b"1" * 5000 + b";", b"&#x110000;", b"\x01", b"<![CDATA[x"):
        with pytest.raises(MarkupError):
            decode_text(bad)
    assert escaped('a<b>&"') == b'a&lt;b&gt;&amp;"' and escaped('"', quotes=True) == b"&quot;"
    with pytest.raises(MarkupError):
        require_text("x\x07")


def test_changes_refuse_overlap():
    assert changed(b"abcdef", [(4, 5, b""), (1, 2, b"XY")]) == b"aXYcdf"
    with pytest.raises(MarkupError):
        changed(b"abcdef", [(1, 3, b""), (2, 4, b"")])
    assert outermost([(2, 4, b""), (1, 5, b""), (5, 6, b"")]) == [(1, 5, b""), (5, 6, b"")]


def test_normalize_drops_what_saves_change_and_is_idempotent():
    body = W + b'<w:p w:rsidR="00AA" w:x="1"/></w:d>'
    out = normalize("word/document.xml", b'<?xml version="1.0" encoding="UTF-8"?>\r\n' + body)
    assert out == W + b'<w:p w:x="1"/></w:d>' and normalize("word/document.xml", out) == out
    other = normalize("word/document.xml", b'<?xml version="1.0" encoding="latin-1"?>' + body)
    assert other.startswith(b"<!--canon encoding=latin-1-->")
    assert normalize("media/x.png", b"\x00<?xml") == b"\x00<?xml"


def test_rules_by_part():
    marks = W + b"<w:proofErr><w:proofErr/></w:proofErr><w:proofErr/><w:x/></w:d>"
    assert normalize("word/document.xml", marks) == W + b"<w:proofErr></w:proofErr><w:x/></w:d>"  # the outer one holds what it may not, the inner one goes
    ids = W + b"<w:rsids><w:rsidRoot/><w:rsid/></w:rsids></w:d>"
    assert normalize("word/settings.xml", ids) == W + b"</w:d>" and normalize("word/styles.xml", ids) == ids
    assert normalize("word/settings.xml", ids.replace(b"<w:rsid/>", b"<w:y/>")) == ids.replace(b"<w:rsid/>", b"<w:y/>")
    notes = W + b'<w:footnote w:type="separator"><w:p w14:paraId="1"/></w:footnote><w:footnote><w:p w14:paraId="2"/></w:footnote></w:d>'
    assert normalize("word/footnotes.xml", notes) == notes.replace(b' w14:paraId="1"', b"") and normalize("word/header1.xml", notes) == notes
    path = b'<x xmlns:a="http://schemas.microsoft.com/office/spreadsheetml/2010/11/ac"><a:absPath url="c"/><y/></x>'
    assert b"absPath" not in normalize("xl/workbook.xml", path) and normalize("xl/styles.xml", path) == path


def test_default_notes():
    only = W + b'<w:footnote w:type="separator"><w:p><w:pPr><w:spacing/></w:pPr><w:r><w:separator/></w:r></w:p></w:footnote></w:d>'
    assert is_default_content("word/footnotes.xml", only) and not is_default_content("word/endnotes.xml", only) and not is_default_content("word/document.xml", only)
    for a, b in ((b"<w:separator/>", b"<w:t/>"), (b"<w:separator/>", b"<w:separator/>x"), (b' w:type="separator"', b""), (b"<w:spacing/>", b"<w:r/>")):
        assert not is_default_content("word/footnotes.xml", only.replace(a, b))


def test_rows_report_refusals(spark):
    parts = spark.createDataFrame([("1", "a.xml", b"<a><b/></a>"), ("2", "word/b.xml", b"<!DOCTYPE x><x/>"), ("3", "c.xml", None), ("4", "word/d.xml", '<?xml version="1.0" encoding="ISO-8859-1"?><a>'.encode() + b"\xe9</a>")], "doc string, part string, data binary")
    rows = element_rows(parts).collect()
    assert sum(r["reason"] is None for r in rows) == 3 and {r["doc"] for r in rows if r["reason"]} == {"2", "3"}
    assert {r["doc"]: r["reason"] is None for r in normalized_parts(parts).collect()} == {"1": True, "2": False, "3": True, "4": False}
    assert [a[0] for a in attributes(b'<a b="1" c=\'2\'>')] == [b"b", b"c"] and attribute(b'<a b="1"/>', b"b") == b"1"
