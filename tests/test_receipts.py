import json

import pytest

from foliant.kernels import records as R
from foliant.operators import receipts as S

D = lambda x: "sha256:" + x * 64
EDIT = {"op": "text_edit", "author": "A", "at": "2026-01-01T00:00:00Z", "mode": "tracked", "target": {"part": "word/document.xml"}, "before": "a", "after": "b"}


def block(**other):
    body = {"origin": "import", "via": "import_document", "name": "a.docx", "imported_at": "2026-01-01T00:00:00Z", "tool": "t", "digest": D("1"), "sha256": D("2"), "size": 3, "chunks": 1} | other
    return body | {"hash": R.chain_hash(None, body)}


def receipt(provenance=None, ops=2, **other) -> dict:
    return {
        "schema": "receipt/2" if provenance else "receipt/1", "document": {"name": "a.docx", "kind": "docx"}, "baseline": {"canon": "canon", "digest": D("a")},
        "operations": R.seal([EDIT] * ops, provenance and provenance["hash"]), "result": {"digest": D("b"), "parts": {"x.xml": D("c")}},
        "attestation": {"tool": "t", "created": "c", "gate": "passed"}, "signature": None,
    } | ({"provenance": provenance} if provenance else {}) | other


def test_canonical_form_and_chain():
    late, early = chr(0xE000), chr(0x1F600)  # by UTF-16 units the second comes first
    assert R.canonical({"b": [1, None, True], late: 2, "a": "\u00e9\n\x01\"", early: 1}) == '{"a":"\u00e9\\n\\u0001\\"","b":[1,null,true],"' + early + '":1,"' + late + '":2}'
    ops = R.seal([EDIT, EDIT])
    assert [op["seq"] for op in ops] == [1, 2] and ops[0]["prev_hash"] is None and ops[1]["prev_hash"] == ops[0]["hash"] and ops[0]["target"]["sheet"] is None
    assert R.first_break(ops) is None and R.first_break(ops, D("0")) == 1 and R.first_break([ops[0], ops[1] | {"after": "c"}]) == 2 and R.first_break([ops[0] | {"note": "x"}, ops[1]]) == 1
    assert R.seal([{"op": "row_insert", "sheet": "s", "at_row": 1} | {k: EDIT[k] for k in ("author", "at", "mode", "target")}])[0]["count"] == 1


def test_receipts_are_read_strictly():
    own = R.receipt(json.dumps(receipt(block())))
    assert R.genesis(own) == block()["hash"] and R.first_break(own["operations"], R.genesis(own)) is None and R.is_intact(own["provenance"])
    assert not R.is_intact(block() | {"size": 4})
    plain = R.receipt(json.dumps(receipt()))
    assert "provenance" not in R.serialised(plain) and json.loads(R.serialised(plain))["signature"] is None and R.genesis(plain) is None
    op = plain["operations"][0]
    said = {"tool": "t", "created": "c"}
    bad = {
        "keys that are not known": receipt(extra=1), "is missing": {k: v for k, v in receipt().items() if k != "signature"}, "schema 'receipt/3'": receipt(schema="receipt/3"), "only there": receipt(schema="receipt/2"),
        "without a gap": receipt(operations=[op | {"seq": 2}]), "must say what failed": receipt(attestation=said | {"gate": "failed", "forced": True}), "only when it was forced": receipt(attestation=said | {"gate": "failed"}),
        "must name its canonical form": receipt(baseline={"digest": D("a")}), "must be a digest": receipt(result={"digest": "md5:1"}), "operations of the kind": receipt(operations=[op | {"op": "fly"}]),
        "names no place": receipt(operations=[op | {"target": {}}]), "must not be empty": receipt(operations=[op | {"author": ""}]), "must be one of": receipt(document={"name": "x", "kind": "odt"}),
        "whole number": receipt(operations=[op | {"seq": True}]), "must be a list": receipt(operations={}), "must be an object": receipt(document=[]),
    }
    for why, own in bad.items():
        with pytest.raises(R.RecordError, match=why):
            R.receipt(json.dumps(own))
    for raw in ("", "{", "[]", "null"):
        with pytest.raises(R.RecordError):
            R.receipt(raw)


@pytest.fixture(scope="module")
def files(spark):
    rows = [("sha256-" + "b" * 64 + ".json", json.dumps(receipt(block()))), ("notes.json", "{}"), ("sha256-" + "d" * 64 + ".json", "{"), ("sha256-" + "e" * 64 + ".json", json.dumps(receipt())), ("sha256-" + "f" * 64 + ".json", None)]
    return spark.createDataFrame(rows, "name string, value string")


def test_store(spark, files):
    got = {r["name"]: (r["skipped"] or "")[:10] for r in S.scan(files).collect()}
    assert list(got.values()) == ["", "no receipt", "unreadable", "its name c", "unreadable"]
    docs = spark.createDataFrame([("x", D("b")), ("y", D("0")), ("z", D("e"))], "doc string, digest string")
    found = {r["doc"]: (r["name"] is not None, r["result_digest"]) for r in S.find(docs, files).collect()}
    assert found == {"x": (True, D("b")), "y": (False, None), "z": (True, D("b"))}  # found by name alone
    again = S.put(spark.createDataFrame([(D("b"), json.dumps(receipt()), 1), (D("b"), json.dumps(receipt(block())), 2)], "digest string, receipt string, n int")).collect()
    assert [(r["name"], "provenance" in r["value"]) for r in again] == [("sha256-" + "b" * 64 + ".json", True)]
    base = spark.createDataFrame([("sha256-" + "a" * 64 + ".pptx", b""), ("sha256-" + "a" * 64 + ".docx", b""), ("x.docx", b"")], "name string, content binary")
    assert [tuple(r) for r in S.baselines(base).collect()] == [(D("a"), "sha256-" + "a" * 64 + ".docx")]
    fresh = S.new_baselines(spark.createDataFrame([("x", D("a"), ".docx"), ("y", D("9"), ".DOCX")], "doc string, digest string, suffix string"), base).collect()
    assert [tuple(r) for r in fresh] == [("y", D("9"), "sha256-" + "9" * 64 + ".docx")]
    new = S.publish_new(spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k").collect()
    assert sorted(tuple(r) for r in new) == [(1, False), (2, True)]


def test_lineage(spark, files):
    name = "sha256-" + "1" * 64 + ".json"
    later = block(imported_at="2026-02-01T00:00:00Z")
    imports = spark.createDataFrame([(name, json.dumps(later)), (name, json.dumps(block())), (name, json.dumps(block() | {"size": 9})), ("sha256-" + "2" * 64 + ".json", json.dumps(block())), ("x", "{")], "name string, value string")
    assert [(r["digest"], r["imported_at"]) for r in S.imports(imports).collect()] == [(D("1"), "2026-01-01T00:00:00Z")]
    docs = spark.createDataFrame([("x", D("1")), ("y", D("b")), ("z", D("e"))], "doc string, digest string")
    got = {r["doc"]: r["provenance"] and json.loads(r["provenance"])["imported_at"] for r in S.provenance_for(docs, imports, files).collect()}
    assert got == {"x": "2026-01-01T00:00:00Z", "y": "2026-01-01T00:00:00Z", "z": None}


def verdicts(spark, rows, supplied=None, stored=None):
    """rows: doc, digest, receipt; by name of the document."""
    docs = spark.createDataFrame([(d, g) for d, g, _ in rows], "doc string, digest string")
    found = docs.join(R.receipt_rows(spark.createDataFrame([(d, json.dumps(r) if isinstance(r, dict) else r) for d, _, r in rows if r is not None], "name string, value string")), docs["doc"] == F.col("name"), "left")
    stored = spark.createDataFrame(stored or [("x", "x", None)], "digest string, found_digest string, unreadable string")
    supplied = spark.createDataFrame(supplied, "doc string, found_digest string, unreadable string") if supplied else None
    manifest = spark.createDataFrame([("moved", "x.xml", D("0")), ("moved", "y.xml", D("0"))], "doc string, part string, part_digest string")
    changed = S.divergence(manifest, found.where("result_digest <> digest").select("doc", "result_parts"))
    return {r["doc"]: r for r in S.verify(S.with_baselines(found, stored, supplied), "canon", changed).collect()}


from pyspark.sql import functions as F  # noqa: E402


def test_verify(spark):
    note = [EDIT | {"mode": "direct", "note": S.DISCLOSURE + " (x): y"}, EDIT]
    broken = receipt()
    broken["operations"][1]["after"] = "z"
    forced = {"tool": "t", "created": "c", "gate": "failed", "forced": True, "gate_failures": ["f"]}
    got = verdicts(spark, [
        ("good", D("b"), receipt(operations=R.seal(note))), ("imported", D("b"), receipt(block())), ("none", D("b"), None), ("torn", D("b"), "{"), ("canon", D("b"), receipt(baseline={"canon": "other", "digest": D("a")})),
        ("moved", D("9"), receipt()), ("silent", D("9"), receipt(result={"digest": D("b")})), ("broken", D("b"), broken), ("edited", D("b"), receipt(block() | {"size": 7})), ("forced", D("b"), receipt(attestation=forced)),
    ], stored=[(D("a"), D("a"), None)])
    outcomes = {k: (r["outcome"], r["exit_code"], r["t1"], r["t2"], r["t3"]) for k, r in got.items()}
    yes = ("verified", 0, True, True, True)
    assert outcomes == {
        "good": yes, "imported": yes, "none": ("unknown", 1, None, None, None), "torn": ("failed", 1, None, None, None), "canon": ("failed", 1, None, None, None), "moved": ("failed", 1, False, True, True),
        "silent": ("failed", 1, False, True, True), "broken": ("failed", 1, True, False, True), "edited": ("failed", 1, True, False, True), "forced": ("failed", 1, True, True, True),
    }
    assert got["good"]["disclosures"] == [S.DISCLOSURE + " (x): y"] and got["imported"]["disclosures"] == [S.IMPORTED] and got["imported"]["provenance"] and got["good"]["reasons"] == []
    assert got["moved"]["reasons"][0].endswith("diverged: x.xml; added since: y.xml") and got["silent"]["reasons"][0].endswith("records no parts") and len(got["forced"]["reasons"]) == 2
    assert "chain of operations breaks at 2" in got["broken"]["reasons"][0] and "provenance" in got["edited"]["reasons"][0] and got["edited"]["disclosures"] == [S.IMPORTED]


def test_baselines_of_verify(spark):
    rows = [(k, D("b"), receipt()) for k in ("same", "other", "torn", "stored")]
    got = verdicts(spark, rows, [("same", D("a"), None), ("other", D("0"), None), ("torn", None, "corrupt")], [(D("a"), None, "no file")])
    assert {k: (r["outcome"], r["baseline_checked"]) for k, r in got.items()} == {"same": ("verified", True), "other": ("failed", False), "torn": ("failed", False), "stored": ("failed", False)}
    none = verdicts(spark, rows[:1])["same"]
    assert none["outcome"] == "verified" and none["baseline_checked"] is None  # a missing baseline is no failure


def test_catalog_and_journal(spark, files):
    docs = spark.createDataFrame([("x", D("b"), "s"), ("y", D("0"), "s"), ("z", D("b"), "t")], "doc string, digest string, store string")
    rows = S.catalog(docs, files.selectExpr("'s' as store", "name", "value")).collect()
    assert sorted((r["doc"], r["matches_this_document"]) for r in rows if r["name"] and r["skipped"] is None) == [("x", True), ("y", False)]
    assert len([r for r in rows if r["doc"] == "x"]) == 5 and [r["name"] for r in rows if r["doc"] == "z"] == [None]
    first = R.seal([EDIT])
    journal = spark.createDataFrame([("a", 1, json.dumps(first[0]), None, False), ("torn", 1, json.dumps(first[0]), None, True), ("bad", 1, None, "line 1", False), ("new", None, None, None, False)], "key string, n long, line string, reason string, truncated boolean")
    ops = spark.createDataFrame([(k, n, json.dumps(EDIT if k != "odd" or n < 2 else {"op": "fly"}), D("7") if k == "new" else None) for k in ("a", "torn", "bad", "new", "odd") for n in (1, 2)], "key string, n long, raw string, genesis string")
    got = {}
    for r in S.appended(journal, ops).collect():
        got.setdefault(r["key"], []).append((r["n"], r["line"] and json.loads(r["line"])["prev_hash"], r["reason"] is None))
    assert got["a"][0] == (2, first[0]["hash"], True) and [x[0] for x in got["a"]] == [2, 3] and got["new"][0] == (1, D("7"), True)
    assert all(x == [(None, None, False)] for k, x in got.items() if k in ("torn", "bad", "odd"))
