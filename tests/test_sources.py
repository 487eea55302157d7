import hashlib
import io
import json
import zipfile

import pytest

from foliant.kernels import records
from foliant.sources.containers import pack, read_parts, replace_parts, unpack, write_containers
from foliant.sources.journals import read_journal, read_operations
from foliant.streaming.uploads import accept_chunks, assembled

GOOD = [("[Content_Types].xml", b"<t/>"), ("word/document.xml", b"<d/>"), ("a.bin", b"\0" * 10)]


def raw(*names, data=b"x"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in ("word/document.xml", *names):
            z.writestr(n, data)
    return out.getvalue()


@pytest.mark.parametrize("names, reason", [(("../x",), "traversal"), (("/x",), "absolute"), (("A.xml", "a.xml"), "collision"), (("./b", "b"), "collision"), (("c", "c/d"), "collision")])
def test_hostile_names(names, reason):
    assert [r["reason"] for r in unpack("f.docx", raw(*names))] == [reason]


def test_limits_and_damage():
    assert unpack("f.docx", raw(data=b"\0" * (1 << 20)))[0]["reason"] == "ratio"
    assert unpack("f.txt", raw())[0]["reason"] == "unsupported container"
    assert unpack("f.pptx", raw())[0]["reason"] == "no main part"
    assert unpack("f.docx", b"no zip")[0]["reason"] == "corrupt"


def test_round_trip_is_deterministic(spark):
    assert pack(GOOD) == pack(GOOD[::-1])
    df = spark.createDataFrame([("f.docx", pack(GOOD)), ("g.docx", b""), ("h.docx", None)], "path string, content binary")
    parts = read_parts(df)
    assert {r["doc"] for r in parts.where("reason is not null").collect()} == {"g.docx", "h.docx"}
    back = write_containers(parts).collect()
    assert [(r["path"], bytes(r["content"])) for r in back] == [("f.docx", pack(GOOD))]
    changed = spark.createDataFrame([("f.docx", "a.bin", b"new")], "doc string, part string, data binary")
    kept = replace_parts(parts.where("part is not null"), changed).collect()
    assert {r["part"]: bytes(r["data"]) for r in kept} == dict(GOOD) | {"a.bin": b"new"}


def test_journal_lines(spark):
    df = spark.createDataFrame([("ok", '{"a":1}\n{"a":2}\n'), ("torn", '{"a":1}\n{"a"'), ("blank", '{"a":1}\n\n{"a":2}\n'), ("bad", 'x\n'), ("empty", "")], "path string, value string")
    got = {}
    for r in read_journal(df).collect():
        got.setdefault(r["path"], []).append((r["seq"], r["truncated"], r["reason"] is not None))
    assert got["ok"] == [(1, False, False), (2, False, False)] and got["torn"] == [(1, True, False)]
    assert got["blank"][0][2] and got["bad"][0][2] and got["empty"] == [(None, False, False)]


def test_upload_stream(spark, tmp_path):
    data = {("u", 1): b"0123456789", ("u", 3): b"abcde"}
    sha = hashlib.sha256(b"0123456789abcde").hexdigest()
    rows = [("u", 1, "a.docx", 0, 10, False, None), ("u", 2, "a.docx", 5, 10, False, None), ("u", 3, "a.docx", 10, 5, True, sha), ("u", 4, "a.docx", 15, 5, False, None), ("v", 1, "b.docx", 3, 1, False, None)]
    rows += [("w", 1, "c.docx", 0, 4, False, None), ("w", 2, "d.docx", 4, 4, True, sha), ("w", 3, "c.docx", 4, 4, True, None), ("w", 4, "c.docx", 4, 97, False, None), ("w", 5, "c.docx", 0, 4, False, None)]
    schema = "upload_id string, arrival long, name string, offset long, size long, final boolean, sha256 string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = accept_chunks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), most=100)
    q = stream.writeStream.format("memory").queryName("uploads").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["upload_id"], r["arrival"]): (r["accepted"], r["received"], r["final"]) for r in spark.table("uploads").collect()}
    assert got == {
        ("u", 1): (True, 10, False), ("u", 2): (False, 10, False), ("u", 3): (True, 15, True), ("u", 4): (False, 15, False), ("v", 1): (False, 0, False),
        ("w", 1): (True, 4, False), ("w", 2): (False, 4, False), ("w", 3): (False, 4, False), ("w", 4): (False, 0, False), ("w", 5): (False, 0, False),
    }
    parts = spark.createDataFrame([(u, n, d) for (u, n), d in data.items()], "upload_id string, arrival long, data binary")
    whole = assembled(spark.table("uploads"), parts).collect()
    assert [(r["upload_id"], bytes(r["content"]), r["chunks"], r["sha256"], r["reason"]) for r in whole] == [("u", b"0123456789abcde", 2, f"sha256:{sha}", None)]


def test_journals_of_operations(spark):
    ops = records.seal([{"op": "text_edit", "author": "A", "at": "t", "mode": "direct", "target": {"part": "p"}, "before": "a", "after": "b"}] * 2)
    line = lambda op: json.dumps(op) + "\n"
    files = {"good": "".join(map(line, ops)), "torn": line(ops[0]) + "{", "odd": line(ops[0]) + line(ops[1] | {"extra": 1}), "kind": line({"op": "fly"}), "none": ""}
    rows = read_operations(spark.createDataFrame(list(files.items()), "path string, value string")).collect()
    by = {k: sorted(((r["n"], r["hash"], r["truncated"], r["reason"] is None) for r in rows if r["key"] == k), key=str) for k in files}
    assert by["good"] == [(1, ops[0]["hash"], False, True), (2, ops[1]["hash"], False, True)] and by["torn"] == [(1, ops[0]["hash"], True, True)]
    assert not any(x[3] for k in ("odd", "kind") for x in by[k]) and by["none"] == [(None, None, False, True)]
    assert next(r["reason"] for r in rows if r["key"] == "odd").startswith("line 2 is no operation")
