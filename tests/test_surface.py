"""Sessions, transfers, outlines and the command surface, over documents made here."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliant import config
from foliant.__main__ import main
from foliant.api import Fleet
from foliant.functions import text as X
from foliant.operators import outline, search, sessions, transfers
from foliant.sources.containers import pack, read_parts
from test_paragraphs import AT, DOC, deck, para, word

DOCX = pack([("[Content_Types].xml", b"<t/>"), (DOC, word(para("Alpha beta", attrs=' w14:paraId="0A"') + para("gamma License"))), ("word/header1.xml", word(para("a license"))), ("docProps/core.xml", b"<c/>")])
PPTX = pack([("[Content_Types].xml", b"<t/>"), *deck().items()])
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
XLSX = pack([
    ("[Content_Types].xml", b"<t/>"), ("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet sheetId="2" r:id="b"/></sheets></workbook>'.encode()),
    ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'.encode()),
    ("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}"><si><t>x</t></si><si><t>the license</t></si></sst>'.encode()), ("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET}"><c r="B2"><is><t>License</t></is></c></worksheet>'.encode()),
])
DOCS = [("f/a.docx", DOCX), ("f/b.pptx", PPTX), ("f/c.xlsx", XLSX), ("f/d.docx", b"torn")]


@pytest.fixture(scope="module")
def containers(spark):
    return spark.createDataFrame(DOCS, "path string, content binary").cache()


@pytest.fixture(scope="module")
def fleet(containers):
    return Fleet(containers)


def test_describe(fleet):
    own = lambda kind: fleet.describe_structure(kind).first().asDict(recursive=True)
    a = own("docx")
    assert (a["parts"], a["included_parts"], a["excluded_parts"], a["text_parts"], a["paragraphs"]) == (4, 3, ["docProps/core.xml"], [DOC, "word/header1.xml"], 2)
    assert [(s["ord"], s["slide_id"], s["part"]) for s in own("pptx")["slides"]] == [(0, 256, "ppt/slides/slide2.xml"), (2, 257, "ppt/slides/slide1.xml")]
    assert [(s["name"], s["sheet_id"], s["part"]) for s in own("xlsx")["sheets"]] == [("One", 1, "xl/worksheets/sheet1.xml")]


def test_find_text(fleet, spark):
    hits = fleet.find_text("docx", "LICENSE").orderBy("rank").collect()
    assert [(r["part"], r["para_index"], r["para_id"], r["match_offset"], r["truncated"]) for r in hits] == [(DOC, 1, None, 6, False), ("word/header1.xml", 0, None, 2, False)]
    assert fleet.find_text("docx", "alpha").first()["para_id"] == "0A" and fleet.find_text("docx", "alpha beta", DOC).count() == 1 and fleet.find_text("docx", "alpha", "x").count() == 0
    one = fleet.find_text("docx", "license", limit=1).collect()
    assert [(r["rank"], r["truncated"]) for r in one] == [(1, True)]
    deck_hits = fleet.find_text("pptx", "title").orderBy("rank").collect()
    assert [(r["part"], r["slide_id"]) for r in deck_hits] == [("ppt/slides/slide2.xml", 256), ("ppt/slides/slide1.xml", 257), ("ppt/notesSlides/notesSlide1.xml", None)]
    assert fleet.find_text("pptx", "title text").count() == 0  # elements are searched one by one
    book = {r["part"]: (r["sheet"], r["ref"], r["shared_string_index"]) for r in fleet.find_text("xlsx", "license").collect()}
    assert book == {"xl/sharedStrings.xml": (None, None, 1), "xl/worksheets/sheet1.xml": ("One", "B2", None)}
    for bad in ("", "x" * 513, "a\0"):
        with pytest.raises(ValueError):
            fleet.find_text("docx", bad)
    asked = spark.createDataFrame([("f/a.docx", DOC), ("f/a.docx", "docProps/core.xml"), ("f/a.docx", "no.xml")], "doc string, part string")
    assert {r["part"]: r["reason"] for r in outline.part_reason(fleet.parts, asked).collect()} == {DOC: None, "docProps/core.xml": "not searched", "no.xml": "no such part"}
    assert [(r["source"], r["target_part"]) for r in outline.dangling(fleet.parts).collect()] == [("ppt/presentation.xml", "ppt/theme1.xml")]


def test_search_offsets(spark):
    rows = [(1, "İİİİ License here"), (2, "license"), (3, "no"), (4, ""), (5, "x" * 100 + "License" + "İ" * 100)]
    got = {r["n"]: (r["match_offset"], r["snippet"]) for r in search.search(spark.createDataFrame(rows, "n int, text string"), "License").collect()}
    assert got == {1: (5, rows[0][1]), 2: (0, "license"), 5: (100, "x" * 80 + "License" + "İ" * 80)}


def test_needles(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone two three four fivex"), (3, "one two three\nfour five"), (4, None), (5, "short")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "one two three four five"), (2, "short"), (3, ""), (4, "three\nfour five six"), (5, "four five")], "item_id long, text string")
    assert sorted(tuple(r) for r in search.needles_in(docs, needles).collect()) == [(1, 1), (1, 2), (2, 5), (5, 1), (5, 2), (5, 3)]


def test_targets_and_guards(spark):
    rows = {("word/document.xml", "."): None, ("ppt/slides/slide1.xml", ".."): None, ("a/b.xml", "/../x.xml"): "x.xml", ("a/b.xml", "../c.xml"): "c.xml", ("b.xml", "../c.xml"): None, ("a/b.xml", "1:x"): None, ("a/b.xml", "c/ "): None, ("a/b.xml", "./c//d.xml"): "a/c/d.xml", ("", "x"): "x", ("a/b.xml", ""): None}
    df = spark.createDataFrame([(s, t, w) for (s, t), w in rows.items()], "s string, t string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", X.resolve_target("s", "t")).collect())
    one = spark.createDataFrame([("word/document.xml", ["word/document.xml"])], "p string, have array<string>")
    reasons = one.select(X.part_reason("p", F.col("have")), X.part_reason(F.lit("../x"), F.col("have")), X.part_reason(F.lit("x"), F.col("have")), X.export_path_reason(F.lit("/r/a.json"), ["/r"], ".store"), X.export_path_reason(F.lit("/r/.store/a.json"), ["/r"], ".store"), X.export_path_reason(F.lit("/q/a.json"), ["/r"], ".store"), X.export_path_reason(F.lit("/r/a.docx"), ["/r"], ".store"), X.as_sha256(F.lit(" SHA256:" + "A" * 64)), X.as_sha256(F.lit("x"))).first()
    assert tuple(reasons) == (None, "no part name", "no such part", None, "inside the store", "outside the roots", "a document", "sha256:" + "a" * 64, None)
    ask = lambda **o: [F.lit(o.get(k)).cast(t) for k, t in (("kind", "string"), ("mode", "string"), ("author", "string"), ("part", "string"), ("old", "string"), ("new", "string"), ("occurrence", "int"), ("para_id", "string"), ("para_index", "int"), ("para_hash", "string"), ("note", "string"))]
    good = {"kind": "docx", "mode": "tracked", "author": "A", "part": "p", "old": "a", "new": "b", "occurrence": 1}
    cases = [({}, None), ({"author": ""}, "no author"), ({"kind": "xlsx"}, "documents of this kind are not edited"), ({"kind": "pptx"}, "slides are not tracked"), ({"old": ""}, "nothing to replace"), ({"new": "a"}, "nothing changes"), ({"occurrence": 0}, "occurrences count from 1"), ({"kind": "pptx", "mode": "direct", "para_index": 1}, "half an address"), ({"para_index": 1}, "documents are addressed by paragraph id"), ({"note": "\x01"}, "note: not allowed in a document")]
    got = spark.range(1).select(*(transfers.request_reason(*ask(**(good | o))) for o, _ in cases), transfers.anchor_reason(F.lit("a"), F.lit("b")), transfers.anchor_reason(F.lit(None), F.lit("b"))).first()
    assert tuple(got) == (*(w for _, w in cases), "two anchors", None)


def test_edit_commit_and_verify(spark, containers, fleet):
    requests = spark.createDataFrame([("f/a.docx", 1, json.dumps({"part": DOC, "old": "beta", "new": "BETA"}))], "doc string, n long, request string")
    assert [(r["applied"], r["reason"]) for r in fleet.preview_edits(requests, "Ann", AT).collect()] == [(True, None)]
    after, outcomes = fleet.apply_edits(requests, "Ann", AT)
    edited = containers.select("path").join(after, "path", "left").join(containers.withColumnRenamed("content", "old"), "path").selectExpr("path", "coalesce(content, old) as content").where("path = 'f/a.docx'").cache()
    ops = outcomes.where("applied").select("doc", "n", "operation")
    now = Fleet(edited)
    sealed = now.commit(containers.where("path = 'f/a.docx'"), ops, AT).cache()
    row = sealed.first()
    assert (row["gate"], row["forced"], row["reason"]) == ("passed", False, None) and json.loads(row["value"])["operations"][0]["after"] == "BETA"
    store = Fleet(edited, sealed.select("name", "value"), None, containers.where("path = 'f/a.docx'").select(F.lit("sha256-" + json.loads(row["value"])["baseline"]["digest"][7:] + ".docx").alias("name"), "content"))
    verdict = store.verify().first()
    assert (verdict["outcome"], verdict["t1"], verdict["t2"], verdict["t3"], verdict["reasons"]) == ("verified", True, True, True, [])
    other = Fleet(containers.where("path = 'f/a.docx'"), sealed.select("name", "value"))
    assert other.verify().first()["outcome"] == "unknown"
    given = other.verify(sealed.select("doc", "value")).first()
    assert given["outcome"] == "failed" and "diverged: word/document.xml" in given["reasons"][0]
    assert [r["matches_this_document"] for r in store.list_receipts().collect()] == [True] and store.export_receipt().first()["reason"] is None
    out = store.export_document().first()
    assert out["receipt_found"] and out["uri"] == "a.docx" and base64.b64decode(out["blob"]) == bytes(edited.first()["content"]) and other.export_document().first()["reason"] == "no receipt matches it as it is"
    hidden = other.commit(containers.where("path = 'f/a.docx'"), ops, AT).first()
    assert hidden["value"] is None and "differs from the replay" in hidden["reason"]
    forced = other.commit(containers.where("path = 'f/a.docx'"), ops, AT, force=True).first()
    assert forced["forced"] and json.loads(forced["value"])["attestation"]["gate_failures"]


def test_paragraph_calls(spark, fleet):
    requests = spark.createDataFrame([("f/a.docx", 1, json.dumps({"part": DOC, "text": "new", "after_para_id": "0A"})), ("f/a.docx", 2, json.dumps({"part": DOC, "text": "new"}))], "doc string, n long, request string")
    after, done = fleet.insert_paragraph(requests, "Ann", AT)
    assert [(r["n"], r["reason"]) for r in done.where("doc = 'f/a.docx'").orderBy("n").collect()] == [(1, None), (2, "an insertion has exactly one anchor")]
    deletes = spark.createDataFrame([("f/a.docx", 1, json.dumps({"part": DOC, "para_id": "0A"}))], "doc string, n long, request string")
    gone, done = fleet.delete_paragraph(deletes, "Ann", AT, tracked=False)
    assert json.loads(done.where("operation is not null").first()["operation"])["before"] == "Alpha beta"
    assert b"Alpha" not in bytes(read_parts(gone).where(f"doc = 'f/a.docx' and part = '{DOC}'").first()["data"])


def test_imports(spark, fleet):
    content, sha = base64.b64encode(DOCX).decode(), hashlib.sha256(DOCX).hexdigest()
    rows = [("new.docx", "data:x/y;base64," + content[:40] + "\n" + content[40:], sha), ("bad.docx", content, "0" * 64), ("x.docx", "é", None), ("y.docx", "abc", None), ("z.docx", base64.b64encode(b"text").decode(), None), ("../q.docx", content, None), ("taken.docx", content, None), ("odd.docx", content, "xyz"), ("torn.docx", base64.b64encode(b"PK\x03\x04").decode(), None)]
    requests = spark.createDataFrame(rows, "name string, content string, sha256 string").withColumn("chunks", F.lit(1))
    inbox = spark.createDataFrame([("taken.docx", "sha256:0")], "name string, sha256 string")
    got = {r["name"]: r for r in fleet.import_document(requests, inbox, AT).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"new.docx": None, "bad.docx": "sha256 mismatch", "x.docx": "not ASCII", "y.docx": "not base64", "z.docx": "no ZIP container", "../q.docx": "a path", "taken.docx": "the name is taken by other content", "odd.docx": "not a sha256", "torn.docx": "corrupt"}
    new = got["new.docx"]
    said = json.loads(new["provenance"])
    assert bytes(new["content"]) == DOCX and said["sha256"] == f"sha256:{sha}" and said["digest"] == new["digest"] and not new["already_present"]
    there = Fleet(fleet.containers, import_files=spark.createDataFrame([("sha256-" + new["digest"][7:] + ".json", new["provenance"])], "name string, value string"))
    again = there.import_document(requests.where("name = 'new.docx'"), spark.createDataFrame([("new.docx", f"sha256:{sha}")], "name string, sha256 string"), AT).first()
    assert again["already_present"] and again["reason"] is None


def meta(session, **other):
    own = {"session_id": session, "document": "/d/a.docx", "name": "a.docx", "kind": "docx", "canon": "canon", "baseline_digest": "sha256:a", "baseline_parts": {"p": "1", "q": "2"}, "document_size": 5, "document_mtime_ns": 7, "created": AT, "expires": "2026-01-02T04:00:00Z", "tool": "t"}
    return json.dumps(own | other)


def test_sessions(spark):
    a, b, c = ("a" * 32), ("b" * 32), ("c" * 32)
    files = spark.createDataFrame([(f"/s/{a}", meta(a)), (f"/s/{b}", meta(a)), (f"/s/{c}", meta(c, expires="2026-01-02T03:30:00Z")), ("/s/x", None), (f"/s/{'d' * 32}", "{}")], "path string, value string")
    own = sessions.read_meta(files).cache()
    assert {r["path"]: r["meta_state"] for r in own.collect()} == {f"/s/{a}": "ok", f"/s/{b}": "ok", f"/s/{c}": "ok", "/s/x": "absent", f"/s/{'d' * 32}": "unreadable"}
    manifest = spark.createDataFrame([(a, "p", "1"), (a, "q", "2"), (c, "p", "9"), (c, "r", "1")], "session_id string, part string, part_digest string")
    drifts = sessions.drift(own.where("meta_state = 'ok'").dropDuplicates(["session_id"]), manifest).cache()
    assert {r["session_id"]: (r["drifted"], r["first_parts"]) for r in drifts.collect()} == {a: (0, []), c: (3, ["p", "q", "r"])}
    now = F.to_timestamp(F.lit("2026-01-02 03:30:00"))
    why = {r["path"][-3:]: r["reason"] for r in sessions.loaded(own, drifts, now).collect()}
    assert why == {"aaa": None, "bbb": "its meta data are another session's", "ccc": "expired", "s/x": "no session id", "ddd": "its meta data are unreadable"}
    assert sessions.loaded(own.where(f"session_id = '{c}'"), drifts, F.to_timestamp(F.lit("2026-01-02 03:00:00"))).first()["reason"] == "3 part(s) of its copy changed: p, q, r"
    assert sessions.loaded(own.where(f"session_id = '{c}'"), drifts, F.to_timestamp(F.lit("2026-01-02 03:00:00")), raw=True).first()["reason"] is None
    assert sessions.renewed(own.where(f"path = '/s/{a}'"), now, 60).first()["expires"] == "2026-01-02T03:31:00Z" and sessions.renewed(own.where(f"path = '/s/{a}'"), now, 5).first()["expires"] == "2026-01-02T04:00:00Z"
    stat = spark.createDataFrame([("/d/a.docx", 5, 8)], "document string, length long, mtime_ns long")
    assert {r[1] for r in sessions.may_have_changed(own.where("meta_state = 'ok'"), stat).collect()} == {True}
    journal = spark.createDataFrame([("k", 1, "x", None), ("k", 2, "y", None), ("bad", None, None, "line 1"), ("none", None, None, None)], "key string, n long, line string, reason string")
    counts = sessions.operation_counts(journal)
    assert {r["key"]: r["operations"] for r in counts.collect()} == {"k": 2, "bad": None, "none": 0}
    open_ = spark.createDataFrame([("k",), ("bad",), ("none",)], "session_id string")
    assert {r["session_id"]: (r["closed"], r["reason"] is None) for r in sessions.closed(open_, counts).collect()} == {"k": (False, False), "bad": (False, False), "none": (True, True)}
    assert all(r["closed"] for r in sessions.closed(open_, counts, discard=True).collect())


def test_resuming(spark):
    docs = spark.createDataFrame([(k, "g") for k in ("match", "stale", "idle", "unread", "drift", "none")], "doc string, digest string")
    rows = [("match", "2", 0, 1, "g"), ("match", "1", 0, 0, "h"), ("stale", "1", 0, 1, "h"), ("stale", "2", 0, 1, "g"), ("idle", "1", 0, 0, "h"), ("unread", "1", 0, None, None), ("drift", "1", 2, 1, "h")]
    own = spark.createDataFrame(rows, "document string, session_id string, drifted int, operations long, replayed_digest string")
    got = {r["doc"]: (r["session_id"], r["refused"] is not None) for r in sessions.resumable(docs, own).collect()}
    assert got == {"match": ("2", False), "stale": (None, True), "idle": (None, False), "unread": (None, True), "drift": (None, False), "none": (None, False)}


def test_expiry_stream(spark, tmp_path):
    schema = "session_id string, at long"
    spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = sessions.expiry_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("leases").collect()) == [("a", "opened", 5), ("b", "opened", 2)]


def test_config_and_command_line(spark, tmp_path, capsys):
    assert config.transfer_bytes({}) == config.TRANSFER_BYTES and config.transfer_bytes({"FOLIANT_TRANSFER_MAX_BYTES": "5"}) == 5
    with pytest.raises(ValueError):
        config.transfer_bytes({"FOLIANT_TRANSFER_MAX_BYTES": "5m"})
    assert config.read_only({"FOLIANT_READ_ONLY": "Yes"}) and not config.read_only({"FOLIANT_READ_ONLY": "ye"}) and config.roots({"FOLIANT_ROOTS": "/a:/b"}) == ["/a", "/b"]
    assert "verify" in config.offered(True) and "apply_edits" not in config.offered(True) and len(config.offered(False)) == 16 and ".dotx" in config.supported_suffixes()
    for name, content in DOCS[:2]:
        (tmp_path / name.split("/")[1]).write_bytes(content)
    paths = [str(tmp_path / "a.docx"), str(tmp_path / "b.pptx")]
    assert main(["digest", *paths], spark) == 0 and capsys.readouterr().out.count("sha256:") == 2
    assert main(["inspect", *paths, "--json"], spark) == 0 and '"paragraphs": 2' in capsys.readouterr().out
    assert main(["verify", *paths], spark) == 1 and capsys.readouterr().out.count("unknown") == 2
