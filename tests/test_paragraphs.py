import json

import pytest

from foliant.kernels import packages as K
from foliant.kernels.canon import W
from foliant.kernels.edits import DISCLOSURE, By, Ids, duplicate_ids, most_id, reject, revision_problems
from foliant.kernels.markup import MarkupError
from foliant.kernels.paragraphs import A, MARKER, P, SLIDE, Stream, paragraph_rows, paragraphs
from foliant.kernels.structure import OFFICE, broken_relationships, relationships, slide_of, slides_of
from foliant.operators import chain
from foliant.streaming.sealing import seal_stream

AT = "2026-01-02T03:04:05Z"
DOC = "word/document.xml"


def word(body: str) -> bytes:
    return f'<w:document xmlns:w="{W}" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"><w:body>{body}</w:body></w:document>'.encode()


def para(*runs: str, attrs: str = "") -> str:
    return f"<w:p{attrs}>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def texts(data: bytes) -> list[str]:
    return [p.text for p in paragraphs(data)]


def by(package, author="Ann", tracked=True) -> By:
    return By(author, AT, tracked, K.new_ids(package))


def edited(data: bytes, old: str, new: str, tracked=True, author="Ann", **rest):
    package = {DOC: data}
    op = K.edit(package, "docx", {"part": DOC, "old": old, "new": new} | rest, by(package, author, tracked))
    return package[DOC], op


def test_runs_objects_and_nesting():
    assert texts(word(para("one ", "two &amp; é") + "<w:p/>")) == ["one two & é", ""]
    assert texts(word("<w:p><w:r><w:t>a</w:t><w:drawing/><w:t>b</w:t><w:tab/></w:r></w:p>")) == [f"a{MARKER}b\t"]
    assert texts(word("<w:p><w:r><w:instrText>X</w:instrText></w:r></w:p>")) == [""]
    nested = word("<w:p><w:r><w:t>out</w:t><w:pict><w:txbxContent><w:p><w:r><w:t>in</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>")
    assert texts(nested) == [f"out{MARKER}", "in"]
    gone = paragraphs(word('<w:p w14:paraId="0A"><w:del w:id="3" w:author="B"><w:r><w:delText>x</w:delText></w:r></w:del><w:hyperlink><w:ins><w:r><w:t>y</w:t></w:r></w:ins></w:hyperlink></w:p>'))[0]
    assert [(s.kind, s.revision.name, s.revision.author, s.revision.id, len(s.containers)) for s in gone.segments] == [("deleted", "del", "B", 3, 0), ("text", "ins", None, None, 1)]
    assert gone.para_id == "0A"
    slide = f'<p:sld xmlns:a="{A}" xmlns:p="{P}"><p:sp><p:cNvPr id="7"/><a:p><a:r><a:t>s</a:t></a:r><a:br/><a:fld><a:t>7</a:t></a:fld></a:p></p:sp></p:sld>'.encode()
    own = Stream(slide, SLIDE).paragraphs[0]
    assert (own.text, own.shape_id) == (f"s\n{MARKER}", 7)
    for bad in (f'<document xmlns="{W}"><p/></document>'.encode(), b"<x/>"):
        with pytest.raises(MarkupError):
            paragraphs(bad)


def test_tracked_edit_splits_runs_and_can_be_rejected():
    data = word('<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Hello wo</w:t></w:r><w:r><w:t>rld &amp; all</w:t></w:r></w:p>')
    out, op = edited(data, "world", "<moon>")
    assert texts(out) == ["Hello world<moon> & all"]
    assert b'<w:del w:id="1" w:author="Ann" w:date="2026-01-02T03:04:05Z"><w:r><w:rPr><w:b/></w:rPr><w:delText xml:space="preserve">wo</w:delText></w:r><w:r><w:delText xml:space="preserve">rld</w:delText></w:r></w:del>' in out
    assert (op["before"], op["after"], op["target"]["offset"], op["mode"]) == ("world", "<moon>", 6, "tracked") and op["note"].startswith("replacement spans")
    back, problems = reject(out, {1, 2})
    assert texts(back) == texts(data) and not problems and most_id(out) == 2 and revision_problems(out) == []
    direct, op = edited(data, "Hello ", "", tracked=False)
    assert texts(direct) == ["world & all"] and DISCLOSURE in op["note"] and b"w:del" not in direct
    assert texts(edited(data, "l", "L", tracked=False, occurrence=3)[0]) == ["Hello worLd & all"]


@pytest.mark.parametrize(
    ("body", "old", "why"),
    [
        (para("a"), "x", "0 time"), (para("a"), "", "empty"), ("<w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r></w:p>", "a\nb", "object"), ("<w:p><w:r><w:t><![CDATA[ab]]></w:t></w:r></w:p>", "ab", "CDATA"),
        ('<w:p><w:ins w:id="1" w:author="B"><w:r><w:t>a</w:t></w:r></w:ins><w:r><w:t>b</w:t></w:r></w:p>', "ab", "straddles"), ('<w:p><w:ins w:id="1" w:author="B"><w:r><w:t>ab</w:t></w:r></w:ins></w:p>', "a", "insertion by 'B'"),
        ('<w:p><w:del w:id="1" w:author="Ann"><w:r><w:delText>ab</w:delText></w:r></w:del></w:p>', "a", "deletion"), ('<w:p><w:moveTo w:id="1" w:author="Ann"><w:r><w:t>ab</w:t></w:r></w:moveTo></w:p>', "a", "move"),
        ("<w:p><w:r><w:t>a</w:t></w:r><w:bookmarkStart/><w:r><w:t>b</w:t></w:r></w:p>", "ab", "other markup"), ("<w:p><w:hyperlink><w:r><w:t>a</w:t></w:r></w:hyperlink><w:r><w:t>b</w:t></w:r></w:p>", "ab", "container"),
        ('<w:tbl><w:tr><w:trPr><w:ins w:id="4" w:author="B"/></w:trPr><w:tc><w:p><w:r><w:t>ab</w:t></w:r></w:p></w:tc></w:tr></w:tbl>', "a", "row marked ins"),
        ('<w:tbl><w:tr><w:tc><w:tcPr><w:cellDel w:id="4" w:author="Ann"/></w:tcPr><w:p><w:r><w:t>ab</w:t></w:r></w:p></w:tc></w:tr></w:tbl>', "a", "cell marked cellDel"),
    ],
)
def test_refused_edits(body, old, why):
    with pytest.raises(MarkupError, match=why):
        edited(word(body), old, "x")


def test_edits_allowed_in_own_context():
    own = word('<w:p><w:ins w:id="9" w:author="Ann"><w:r><w:t>ab</w:t></w:r></w:ins></w:p>')
    assert texts(edited(own, "a", "c", tracked=False)[0]) == ["cb"]
    row = word('<w:tbl><w:tr><w:trPr><w:ins w:id="4" w:author="Ann"/></w:trPr><w:tc><w:p><w:r><w:t>ab</w:t></w:r></w:p></w:tc></w:tr></w:tbl>')
    assert texts(edited(row, "a", "c", tracked=False)[0]) == ["cb"]
    with pytest.raises(MarkupError, match="UTC"):
        By("Ann", "2026-01-02T03:04:05.5Z", True)
    with pytest.raises(MarkupError, match="no revision id"):
        Ids(2**31).take()
    with pytest.raises(MarkupError, match="can't hold revisions"):
        K.edit({"word/comments.xml": own}, "docx", {"part": "word/comments.xml", "old": "a", "new": "b"}, By("Ann", AT, True, Ids(1)))


def test_paragraphs_inserted_and_deleted():
    data = word(para("one") + '<w:p><w:pPr><w:jc/><w:sectPr/></w:pPr></w:p>' + '<w:p><w:pPr><w:rPr><w:ins w:id="5" w:author="Ann"/><w:b/></w:rPr></w:pPr><w:r><w:t>three</w:t></w:r></w:p>')
    package = {DOC: data}
    own, hashes = by(package), [p.hash for p in paragraphs(data)]
    op = K.insert(package, "docx", DOC, 1, "new & <b>", own)
    assert texts(package[DOC]) == ["one", "new & <b>", "", "three"] and op["at_index"] == 1
    K.insert(package, "docx", DOC, 4, "", own)
    K.delete(package, "docx", DOC, own, para_index=0, para_hash=hashes[0])
    out = package[DOC]
    assert texts(out) == ["one", "new & <b>", "", "three", ""] and own.ids.taken == [6, 7, 8, 9, 10]
    assert b'<w:pPr><w:rPr><w:del w:id="10" w:author="Ann"' in out
    back, problems = reject(out, set(own.ids.taken))
    assert texts(back) == texts(data) and not problems
    K.delete(package, "docx", DOC, By("Ann", AT, True, own.ids), para_index=3, para_hash=hashes[2])
    assert b'<w:ins w:id="5" w:author="Ann"/><w:del w:id="12"' in package[DOC]  # the mark stands behind an insertion, before formats
    for index, why in ((2, "ends a section"), (9, "outside"), (0, "marked deleted|not accepted")):
        digest = paragraphs(package[DOC])[index].hash if index < 5 else hashes[0]
        with pytest.raises(MarkupError, match=why):
            K.delete(package, "docx", DOC, own, para_index=index, para_hash=digest)
    gone = {DOC: data}
    K.delete(gone, "docx", DOC, by(gone, tracked=False), para_index=0, para_hash=hashes[0])
    assert texts(gone[DOC]) == ["", "three"]
    for k in (-1, 99):
        with pytest.raises(MarkupError, match="outside"):
            K.insert(gone, "docx", DOC, k, "x", own)


def test_addresses():
    stream = Stream(word(para("one", attrs=' w14:paraId="0A"') + para("two")))
    one, two = stream.paragraphs
    assert stream.at_address("0A") is one and stream.at_address("0A", digest=one.hash) is one and stream.at_address(index=1, digest=two.hash) is two
    for address, why in ((("0B",), "no paragraph"), ((None, 1), "no stable"), ((None, 5, two.hash), "outside"), ((None, 0, two.hash), "stale"), (("0A", None, two.hash), "stale"), ((), "needs")):
        with pytest.raises(MarkupError, match=why):
            stream.at_address(*address)


def test_gate():
    base = {DOC: word(para("alpha beta") + para("gamma")), "word/styles.xml": b"<s/>"}
    work, ops, outcomes = K.batch(base, "docx", [{"part": DOC, "old": "beta", "new": "BETA"}, {"part": DOC, "old": "gamma", "new": "delta", "note": "why"}], by(base))
    assert all(o["applied"] for o in outcomes) and ops[1]["note"] == "why"
    assert K.gate(base, work, "docx", ops) == K.Gate(True, True, True, True, [], [])
    touched = work | {"word/styles.xml": b"<t/>", "x.bin": b"1"}
    verdict = K.gate(base, touched, "docx", ops)
    assert (verdict.ok, verdict.accountability, verdict.visibility) == (False, False, True) and len(verdict.failures) == 2
    silent = base | {DOC: base[DOC].replace(b"gamma", b"delta")}
    lost = K.gate(base, silent, "docx", [ops[0]])
    assert not lost.accountability and lost.visibility is False
    with pytest.raises(MarkupError, match=r"operation 1 \(cell_write\)"):
        K.gate(base, work, "docx", [ops[0] | {"op": "cell_write"}])
    with pytest.raises(MarkupError, match="operation 2"):
        K.replay(base, "docx", [ops[0], ops[0]])
    work, failed, outcomes = K.batch(base, "docx", [{"part": DOC, "old": "beta", "new": "x"}, {"part": DOC, "old": "nothing", "new": "x"}, {"part": DOC, "old": "gamma", "new": "x"}], by(base))
    assert work == base and not failed and [o["reason"].split(":")[0] for o in outcomes] == ["discarded", "'nothing' is there 0 time(s), occurrence 1 was asked for", "not attempted"]


def test_attestation_and_disclosures():
    base = {DOC: word(para("alpha"))}
    work = dict(base)
    op = K.edit(work, "docx", {"part": DOC, "old": "alpha", "new": "beta"}, by(base, tracked=False))
    verdict = K.gate(base, work, "docx", [op])
    assert verdict.ok and verdict.visibility is None and len(verdict.notices) == 1
    assert K.attest(verdict, [op])["refused"] is None
    assert "do not say so" in K.attest(verdict, [op | {"note": None}], force=True)["refused"]
    assert "not those" in K.attest(verdict, [])["refused"]
    bad = K.gate(base, work | {"y.xml": b"<y/>"}, "docx", [op])
    assert K.attest(bad, [op])["refused"] and K.attest(bad, [op], force=True) == {"gate": "failed", "forced": True, "gate_failures": bad.failures, "refused": None}
    twice = word('<w:p><w:ins w:id="1"><w:r><w:t>a</w:t></w:r></w:ins><w:del w:id="1"><w:r><w:t>b</w:t><w:ins w:id="3"/></w:r></w:del></w:p>')
    assert duplicate_ids(twice) == [1] and len(revision_problems(twice)) == 3


def test_direct_operations_behind_tracked_inserts():
    insert = {"op": "paragraph_insert", "mode": "tracked", "at_index": 2, "target": {"part": DOC}}
    direct = lambda **t: {"op": "text_edit", "mode": "direct", "target": {"part": DOC} | t}
    assert K.not_addressable([insert, direct(para_index=1), direct(para_index=2), direct(para_id="x"), direct(), insert | {"mode": "direct"}, insert | {"mode": "direct", "at_index": 3}]) == [3, 5, 7]


def deck() -> dict:
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>'
    rels = lambda *r: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(r)}</Relationships>'.encode()
    slide = f'<p:sld xmlns:a="{A}" xmlns:p="{P}"><p:sp><p:cNvPr id="4"/><a:p><a:r><a:t>Title te</a:t></a:r><a:r><a:t>xt</a:t></a:r></a:p></p:sp></p:sld>'.encode()
    return {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{OFFICE}"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId r:id="r1"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>'.encode(),
        "ppt/_rels/presentation.xml.rels": rels(rel("r1", "slide", "slides/slide1.xml"), rel("r2", "slide", "/ppt/slides/slide2.xml"), rel("r3", "theme", "theme1.xml")),
        "ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide, "ppt/notesSlides/notesSlide1.xml": slide,
        "ppt/notesSlides/_rels/notesSlide1.xml.rels": rels(rel("x", "slide", "../slides/slide2.xml")),
    }


def test_slides():
    package = deck()
    assert [(s["ord"], s["slide_id"], s["part"]) for s in slides_of(package)] == [(0, 256, "ppt/slides/slide2.xml"), (2, 257, "ppt/slides/slide1.xml")]
    assert slide_of(package, "ppt/notesSlides/notesSlide1.xml") == 256 and slide_of(package, "ppt/theme1.xml") is None
    assert broken_relationships(package) == ["ppt/_rels/presentation.xml.rels: r3 names ppt/theme1.xml, which is not there"]
    work = dict(package)
    op = K.edit(work, "pptx", {"part": "ppt/notesSlides/notesSlide1.xml", "old": "text", "new": "page"}, By("Ann", AT, False))
    assert (op["op"], op["target"]["slide_id"], op["target"]["shape_id"], op["mode"]) == ("notes_edit", 256, 4, "direct") and DISCLOSURE in op["note"]
    assert b"<a:t>Title </a:t>" in work["ppt/notesSlides/notesSlide1.xml"]
    verdict = K.gate(package, work, "pptx", [op])
    assert verdict.accountability and verdict.visibility is None and verdict.structural is False
    with pytest.raises(MarkupError, match="no revision marks"):
        K.edit(work, "pptx", {"part": "ppt/slides/slide1.xml", "old": "text", "new": "x"}, By("Ann", AT, True, Ids(1)))
    with pytest.raises(MarkupError, match="lacks"):
        relationships("a.xml", b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="1"/></Relationships>')


def test_rows_and_replay(spark):
    data = word(para("old"))
    parts = spark.createDataFrame([("1", "docx", DOC, data), ("2", "docx", DOC, word("<w:p/>")), ("3", "docx", DOC, None)], "doc string, kind string, part string, data binary")
    rows = {(r["doc"], r["idx"]): (r["text"], r["reason"] is None) for r in paragraph_rows(parts).collect()}
    assert rows == {("1", 0): ("old", True), ("2", 0): ("", True), ("3", None): (None, False)}
    requests = spark.createDataFrame([("1", 1, json.dumps({"part": DOC, "old": "old", "new": "new"})), ("2", 1, json.dumps({"part": DOC, "old": "x", "new": "y"}))], "doc string, n long, request string")
    after, outcomes = K.applied(parts, requests, "Ann", AT)
    done = {r["doc"]: r for r in outcomes.collect()}
    assert done["1"]["applied"] and not done["2"]["applied"] and done["2"]["reason"]
    ops = outcomes.where("applied").selectExpr("doc", "n", "operation")
    again = {r["doc"]: r for r in K.replayed(parts.where("doc <> '3'"), ops).collect()}
    assert {r["doc"]: bytes(r["data"]) for r in after.where("doc <> '3'").collect()} == {d: bytes(r["data"]) for d, r in again.items()} and texts(bytes(again["1"]["data"])) == ["oldnew"]
    verdicts = {r["doc"]: r for r in K.gated(parts.where("doc < '3'"), after.selectExpr("doc", "'docx' as kind", "part", "data").where("doc < '3'"), ops).collect()}
    assert verdicts["1"]["ok"] and verdicts["1"]["gate"] == "passed" and verdicts["1"]["refused"] is None and verdicts["2"]["visibility"] is None
    bad = spark.createDataFrame([("1", 1, json.dumps({"op": "cell_write", "author": "A", "at": AT, "mode": "direct", "target": {}}))], "doc string, n long, operation string")
    assert K.replayed(parts.where("doc = '1'"), bad).first()["reason"].startswith("operation 1 (cell_write)")


def test_sealing_stream_equals_batch(spark, tmp_path):
    rows = [(f"l{k % 2}", k, f'{{"n":{k}}}') for k in range(7)]
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, "log string, arrival long, payload string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = seal_stream(spark.readStream.schema("log string, arrival long, payload string").parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = {(r["log"], r["seq"], r["hash"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = chain.seal(spark.createDataFrame([(log, n // 2 + 1, p) for log, n, p in rows], "log string, seq long, payload string"), "log")
    assert got == {(r["log"], r["seq"], r["hash"]) for r in batch.collect()} and len(got) == 7
