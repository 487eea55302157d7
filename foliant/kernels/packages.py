"""Whole packages: operations in order, the gate before sealing, and their rows.

A package is a mapping of part names to bytes; a document with its operations is one task's
work, as both are bounded by the limits of a container.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from hashlib import sha256
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.kernels.canon import is_default_content, normalize
from foliant.kernels.edits import (
    DISCLOSURE, EDITABLE_PART, MIXED, NOTES_PART, TRACKED_PART, By, Ids, delete_paragraph, insert_paragraph, most_id, note_of, reject, replace_at, revision_problems,
)
from foliant.kernels.markup import MarkupError, changed
from foliant.kernels.paragraphs import SLIDE, WORD, Stream
from foliant.kernels.records import canonical
from foliant.kernels.structure import broken_relationships, slide_of
from foliant.operators.digests import EXCLUDED, EXCLUDED_PREFIXES

Package = dict[str, bytes]
Operation = Mapping[str, Any]


def is_excluded(part: str) -> bool:
    return part in EXCLUDED or part.startswith(EXCLUDED_PREFIXES)


def manifest(package: Package, label: str = "canon") -> dict[str, str]:
    return {part: "sha256:" + sha256(normalize(part, data, label)).hexdigest() for part, data in sorted(package.items()) if not is_excluded(part) and not is_default_content(part, data)}


def digest_of_manifest(digests: Mapping[str, str]) -> str:
    return "sha256:" + sha256(canonical(digests).encode()).hexdigest()


def tracked_parts(package: Package) -> list[str]:
    return sorted(p for p in package if TRACKED_PART.match(p))


def new_ids(package: Package) -> Ids:
    return Ids(max((most_id(package[p]) for p in tracked_parts(package)), default=0) + 1)


def _part(package: Package, part: str | None, kind: str, tracked: bool) -> Stream:
    if part is None or part not in package:
        raise MarkupError(f"the package has no part {part!r}")
    if kind == "pptx":
        if tracked:
            raise MarkupError("slides have no revision marks, so nothing there can be tracked")
        if not EDITABLE_PART.match(part):
            raise MarkupError(f"{part} is no slide and no notes page")
        return Stream(package[part], SLIDE)
    if tracked and not TRACKED_PART.match(part):
        raise MarkupError(f"{part} can't hold revisions that a reader would see")
    return Stream(package[part], WORD)


def _record(op: str, by: By, target: dict, note: str | None, **rest) -> dict:
    return {"op": op, "author": by.author, "at": by.at, "mode": by.mode, "target": target, "note": note} | rest


def edit(package: Package, kind: str, request: Operation, by: By) -> dict:
    """Replaces the k-th match of ``old`` (in one paragraph, if it is addressed); returns the operation."""
    part, old, new = request["part"], request["old"], request["new"]
    stream = _part(package, part, kind, by.tracked)
    address = (request.get("para_id"), request.get("para_index"), request.get("para_hash"))
    within = None if address[:2] == (None, None) else [stream.at_address(*address)]
    found, k = stream.matches(old, within), request.get("occurrence") or 1
    if not 1 <= k <= len(found):
        raise MarkupError(f"{old!r} is there {len(found)} time(s), occurrence {k} was asked for")
    para, at = found[k - 1]
    return _replace(package, kind, stream, part, para, at, at + len(old), new, by, request.get("note"))


def _replace(package, kind, stream, part, para, low, high, new, by, note) -> dict:
    before = para.text[low:high]
    changes, mixed = replace_at(stream, para, low, high, new, by)
    target = {"part": part, "para_index": para.index, "para_hash": para.hash, "offset": low}
    target |= {"slide_id": slide_of(package, part), "shape_id": para.shape_id} if kind == "pptx" else {"para_id": para.para_id}
    package[part] = changed(stream.data, changes)
    op = "notes_edit" if kind == "pptx" and NOTES_PART.match(part) else "text_edit"
    return _record(op, by, target, note_of(part, by, note, MIXED if mixed and new else None), before=before, after=new)


def delete(package: Package, kind: str, part: str, by: By, para_id=None, para_index=None, para_hash=None, note=None) -> dict:
    if kind != "docx":
        raise MarkupError(f"paragraphs of a {kind} are not deleted")
    stream = _part(package, part, kind, by.tracked)
    para = stream.at_address(para_id, para_index, para_hash)
    package[part] = changed(stream.data, delete_paragraph(stream, para, by))
    target = {"part": part, "para_id": para.para_id, "para_index": para.index, "para_hash": para.hash}
    return _record("paragraph_delete", by, target, note_of(part, by, note), before=para.text, at_index=para.index)


def insert(package: Package, kind: str, part: str, index: int, text: str, by: By, note=None) -> dict:
    if kind != "docx":
        raise MarkupError(f"paragraphs are not inserted into a {kind}")
    stream = _part(package, part, kind, by.tracked)
    package[part] = changed(stream.data, insert_paragraph(stream, index, text, by))
    return _record("paragraph_insert", by, {"part": part, "para_index": index}, note_of(part, by, note), after=text, at_index=index)


def replay_one(package: Package, kind: str, op: Operation, ids: Ids) -> None:
    """One recorded operation on the state that those before it left; kinds that are not known are refused, never skipped."""
    by, target = By(op["author"], op["at"], op["mode"] == "tracked", ids), op["target"]
    name, part = op["op"], target.get("part")
    address = (target.get("para_id"), target.get("para_index"), target.get("para_hash"))
    if name == "text_edit" or (name == "notes_edit" and kind == "pptx"):
        stream = _part(package, part, kind, by.tracked)
        para = stream.at_address(*(address if kind != "pptx" else (None, *address[1:])))
        low = target.get("offset")
        if low is None or para.text[low : low + len(op["before"])] != op["before"]:
            raise MarkupError(f"{op['before']!r} is not at {low} of paragraph {para.index}")
        _replace(package, kind, stream, part, para, low, low + len(op["before"]), op["after"], by, None)
    elif name == "paragraph_delete":
        delete(package, kind, part, by, *address)
    elif name == "paragraph_insert":
        insert(package, kind, part, op["at_index"], op["after"], by)
    else:
        raise MarkupError(f"operations of the kind {name!r} can't be replayed")


def replay(baseline: Package, kind: str, ops: list[Operation]) -> tuple[Package, list[int]]:
    """The package after all operations, and the revision ids they took."""
    package, ids = dict(baseline), new_ids(baseline)
    for n, op in enumerate(ops, 1):
        try:
            replay_one(package, kind, op, ids)
        except MarkupError as bad:
            raise MarkupError(f"operation {n} ({op.get('op')}): {bad}") from None
    return package, ids.taken


def content(package: Package) -> list[tuple[str, int, str]]:
    """Part, index and text of every paragraph that can be tracked."""
    return [(part, p.index, p.text) for part in tracked_parts(package) for p in Stream(package[part]).paragraphs]


def content_differences(want: list[tuple[str, int, str]], got: list[tuple[str, int, str]]) -> list[str]:
    """By part: another number of paragraphs, else the first that differs."""
    by_part: dict[str, tuple[list, list]] = {}
    for side, rows in enumerate((want, got)):
        for part, index, text in rows:
            by_part.setdefault(part, ([], []))[side].append((index, text))
    out = []
    for part, (a, b) in sorted(by_part.items()):
        if len(a) != len(b):
            out.append(f"{part}: {len(a)} paragraphs expected, {len(b)} found")
        elif a != b:
            place = next(x[0] for x, y in zip(a, b, strict=True) if x != y)
            out.append(f"{part}: paragraph {place} is not restored")
    return out


def owes_disclosure(op: Operation) -> bool:
    """Direct changes of any kind in parts where a reader could expect to see them."""
    part = (op.get("target") or {}).get("part") or ""
    return op.get("mode") == "direct" and bool(TRACKED_PART.match(part) or EDITABLE_PART.match(part))


def notices(ops: list[Operation]) -> list[str]:
    return [f"operation {n} is a direct change of {op['target']['part']} that a reader of the document does not see" for n, op in enumerate(ops, 1) if owes_disclosure(op)]


def not_addressable(ops: list[Operation]) -> list[int]:
    """Direct operations whose place can't be found once tracked inserts before them in the part are left out."""
    pivots: dict[str, int] = {}
    out = []
    for n, op in enumerate(ops, 1):
        target = op.get("target") or {}
        part, at = target.get("part"), op.get("at_index")
        if part is None:
            continue
        if op["mode"] == "tracked" and op["op"] == "paragraph_insert":
            pivots[part] = min(-1 if at is None else at, pivots.get(part, 1 << 62))
        elif op["mode"] == "direct" and part in pivots:
            index = target.get("para_index")
            stays = (-1 if at is None else at) <= pivots[part] if op["op"] == "paragraph_insert" else bool(target.get("para_id")) or (index is not None and index < pivots[part])
            if not stays:
                out.append(n)
    return out


def manifest_differences(want: Package, got: Package, label: str) -> list[str]:
    a, b, out = manifest(want, label), manifest(got, label), []
    for part in sorted({*a, *b}):
        if a.get(part) != b.get(part):
            out.append(f"{part}: " + ("in the result by no recorded operation" if part not in a else "gone from the result by no recorded operation" if part not in b else "differs from the replay of the recorded operations"))
    return out


@dataclass
class Gate:
    """Null (None) is a third value: not looked at."""

    ok: bool
    accountability: bool
    visibility: bool | None
    structural: bool | None
    failures: list[str]
    notices: list[str]


def gate(baseline: Package, result: Package, kind: str, ops: list[Operation], label: str = "canon") -> Gate:
    """Whether recorded operations explain a result, a reader who rejects the tracked ones gets what direct ones
    alone give, and the result is sound.  A replay that fails raises: then there is no verdict."""
    replayed, ids = replay(baseline, kind, ops)
    accountable = digest_of_manifest(manifest(replayed, label)) == digest_of_manifest(manifest(result, label))
    failures = [] if accountable else manifest_differences(replayed, result, label)
    visible = None
    if kind == "docx" and any(op["mode"] == "tracked" for op in ops):
        if lost := not_addressable(ops):
            visible = False
            failures += [f"visibility: operation {n} is direct and has no place of its own without the tracked inserts before it" for n in lost]
        else:
            visible, problems = _visible(baseline, result, kind, [op for op in ops if op["mode"] == "direct"], set(ids))
            failures += problems
    problems = structural_problems(result, kind)
    failures += problems
    structural = not problems if kind == "pptx" or tracked_parts(result) else None
    return Gate(accountable and visible is not False and structural is not False, accountable, visible, structural, failures, notices(ops))


def _visible(baseline: Package, result: Package, kind: str, direct: list[Operation], ids: set[int]) -> tuple[bool, list[str]]:
    try:
        expected, _ = replay(baseline, kind, direct)
    except MarkupError as bad:
        return False, [f"visibility: the direct operations can't be replayed alone ({bad})"]
    rejected, problems = dict(result), []
    for part in tracked_parts(result):
        rejected[part], own = reject(result[part], ids)
        problems += [f"{part}: {p}" for p in own]
    differences = content_differences(content(expected), content(rejected))
    return not problems and not differences, problems + differences


def structural_problems(package: Package, kind: str) -> list[str]:
    out = broken_relationships(package) if kind == "pptx" else []
    for part in tracked_parts(package):
        try:
            out += [f"{part}: {p}" for p in revision_problems(package[part])]
        except MarkupError as bad:
            out.append(f"{part}: {bad}")
    return out


def attest(verdict: Gate, ops: list[Operation], force: bool = False) -> dict:
    """gate, forced, gate_failures and, if it must not be sealed, refused.  A missing disclosure refuses even under force."""
    silent = [n for n, op in enumerate(ops, 1) if owes_disclosure(op) and DISCLOSURE not in (op.get("note") or "")]
    refused = None
    if notices(ops) != verdict.notices:
        refused = "the operations are not those that the gate saw"
    elif silent:
        refused = f"operations {silent} are direct changes that do not say so"
    elif not verdict.ok and not force:
        refused = "; ".join(verdict.failures[:5]) or "the gate failed"
    return {"gate": "passed" if verdict.ok else "failed", "forced": not verdict.ok and force, "gate_failures": [] if verdict.ok else verdict.failures, "refused": refused}


def batch(package: Package, kind: str, requests: list[Operation], by: By) -> tuple[Package, list[dict], list[dict]]:
    """All or nothing: the package after all edits, their operations, and an outcome a request."""
    work, ops, failed = dict(package), [], None
    for n, request in enumerate(requests):
        try:
            ops.append(edit(work, kind, request, by))
        except MarkupError as bad:
            failed = n, str(bad)
            break
    if failed is None:
        return work, ops, [{"applied": True, "reason": None, "para_id": op["target"].get("para_id")} for op in ops]
    reason = lambda n: failed[1] if n == failed[0] else "discarded: a later edit of the batch failed" if n < failed[0] else "not attempted: an earlier edit of the batch failed"
    return package, [], [{"applied": False, "reason": reason(n), "para_id": None} for n in range(len(requests))]


# --- over DataFrames: parts are rows (doc, kind, part, data), operations rows (doc, n, operation as JSON)


def _grouped(frame: pd.DataFrame) -> Package:
    return {p: bytes(d) if d is not None else b"" for p, d in zip(frame["part"], frame["data"], strict=True) if p is not None}


def _logged(log: pd.DataFrame) -> list[Operation]:
    return [json.loads(x) for x in log.sort_values("n")["operation"]]


def _cogroup(left: DataFrame, right: DataFrame, run, ddl: str) -> DataFrame:
    a = left.select(F.col("doc").cast("string").alias("doc"), "kind", "part", F.col("data").cast("binary").alias("data"))
    return a.groupBy("doc").cogroup(right.withColumn("doc", F.col("doc").cast("string")).groupBy("doc")).applyInPandas(run, ddl)


def _rows(rows: Iterator[tuple] | list[tuple], ddl: str) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=[c.split()[0] for c in ddl.split(", ")])


def replayed(parts: DataFrame, ops: DataFrame) -> DataFrame:
    """doc, part, data after each document's operations in order of ``n``; a document whose
    replay fails gives one row with a reason that names the operation, and no parts."""
    ddl = "doc string, part string, data binary, reason string"

    def run(key, own, log):
        try:
            package, _ = replay(_grouped(own), own["kind"].iloc[0] if len(own) else "docx", _logged(log))
        except (MarkupError, KeyError, ValueError) as bad:
            return _rows([(key[0], None, None, str(bad))], ddl)
        return _rows(((key[0], p, d, None) for p, d in package.items()), ddl)

    return _cogroup(parts, ops.select("doc", "n", "operation"), run, ddl)


def applied(parts: DataFrame, requests: DataFrame, author: str, at: str, tracked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Batches of edit requests (doc, n, request as JSON): the parts after them, and an outcome
    a request (doc, n, applied, reason, para_id, operation as JSON)."""
    parts_ddl, outcome_ddl = "doc string, part string, data binary", "doc string, n long, applied boolean, reason string, para_id string, operation string"

    def work(own, log):
        package, kind, log = _grouped(own), own["kind"].iloc[0] if len(own) else "docx", log.sort_values("n")
        asked = [json.loads(x) for x in log["request"]]
        try:
            by = By(author, at, tracked, new_ids(package))
            return log, *batch(package, kind, asked, by)
        except MarkupError as bad:
            return log, package, [], [{"applied": False, "reason": str(bad), "para_id": None} for _ in asked]

    def after(key, own, log):
        _, package, _, _ = work(own, log)
        return _rows(((key[0], p, d) for p, d in package.items()), parts_ddl)

    def outcomes(key, own, log):
        log, _, ops, found = work(own, log)
        done = [canonical(o) for o in ops] or [None] * len(found)
        return _rows(((key[0], n, o["applied"], o["reason"], o["para_id"], d) for n, o, d in zip(log["n"], found, done, strict=True)), outcome_ddl)

    named = requests.select("doc", "n", "request")
    return _cogroup(parts, named, after, parts_ddl), _cogroup(parts, named, outcomes, outcome_ddl)


def gated(baselines: DataFrame, results: DataFrame, ops: DataFrame, force: bool = False, label: str = "canon") -> DataFrame:
    """doc, ok, accountability, visibility, structural, failures, notices, gate, forced, refused, reason (of a
    document without a verdict, as its replay failed)."""
    ddl = "doc string, ok boolean, accountability boolean, visibility boolean, structural boolean, failures array<string>, notices array<string>, gate string, forced boolean, refused string, reason string"
    both = baselines.select("doc", "kind", "part", "data", F.lit(True).alias("base")).unionByName(results.select("doc", "kind", "part", "data", F.lit(False).alias("base")))

    def run(key, own, log):
        kind = own["kind"].iloc[0] if len(own) else "docx"
        try:
            listed = _logged(log)
            verdict = gate(_grouped(own[own["base"]]), _grouped(own[~own["base"]]), kind, listed, label)
        except (MarkupError, KeyError, ValueError) as bad:
            return pd.DataFrame([{"doc": key[0], "reason": str(bad)}]).reindex(columns=[c.split()[0] for c in ddl.split(", ")])
        said = attest(verdict, listed, force)
        return _rows([(key[0], verdict.ok, verdict.accountability, verdict.visibility, verdict.structural, verdict.failures, verdict.notices, said["gate"], said["forced"], said["refused"], None)], ddl)

    left = both.withColumn("doc", F.col("doc").cast("string")).withColumn("data", F.col("data").cast("binary"))
    return left.groupBy("doc").cogroup(ops.select(F.col("doc").cast("string").alias("doc"), "n", "operation").groupBy("doc")).applyInPandas(run, ddl)
