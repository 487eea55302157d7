"""Document containers: guarded ZIP reading and deterministic writing, as DataFrames.

Entries are listed from the central directory before anything is unpacked, so a
container that breaks a limit costs no decompression.  A refusal is a row with a
reason, never a failed task.
"""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import MAIN_PARTS

#: Limits on a container.
MOST_ENTRIES, MOST_ENTRY, MOST_RATIO, MOST_TOTAL = 10_000, 50 << 20, 200, 100 << 20
CONTENT_TYPES = "[Content_Types].xml"
_EPOCH = (1980, 1, 1, 0, 0, 0)


def name_reason(name: str) -> str | None:
    """Why an entry's name is refused."""
    if not name or not name.strip("/"):
        return "empty name"
    if "\\" in name:
        return "backslash"
    if name.startswith("/") or (len(name) > 1 and name[1] == ":" and name[0].isalpha()):
        return "absolute"
    if ".." in name.split("/"):
        return "traversal"
    return None


def name_key(name: str) -> str:
    """What two names that would meet on some file system have in common."""
    return "/".join(s for s in name.split("/") if s not in ("", ".")).casefold()


def entries_reason(infos: list[zipfile.ZipInfo], suffix: str) -> str | None:
    """Why a container is refused, from its directory alone; the first rule that fails."""
    if suffix not in MAIN_PARTS:
        return "unsupported container"
    if len(infos) > MOST_ENTRIES:
        return "too many entries"
    if any(i.file_size > MOST_ENTRY for i in infos):
        return "entry too large"
    if any(i.file_size / max(i.compress_size, 1) > MOST_RATIO for i in infos):
        return "ratio"
    if sum(i.file_size for i in infos) > MOST_TOTAL:
        return "total too large"
    keys, folders = set(), set()
    for i in infos:
        if (reason := name_reason(i.filename)) is not None:
            return reason
        if stat.S_ISLNK(i.external_attr >> 16):
            return "symlink"
        if i.flag_bits & 1:
            return "encrypted"
        key = name_key(i.filename)
        if key in keys:
            return "collision"
        keys.add(key)
        if not i.is_dir():
            folders.update(key.rsplit("/", k)[0] for k in range(1, key.count("/") + 1))
    if folders & {name_key(i.filename) for i in infos if not i.is_dir()}:
        return "collision"
    if MAIN_PARTS[suffix] not in {i.filename for i in infos}:
        return "no main part"
    return None


_PARTS = pa.schema([("doc", pa.string()), ("part", pa.string()), ("data", pa.binary()), ("reason", pa.string())])


def unpack(path: str, content: bytes) -> list[dict]:
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
            if (reason := entries_reason(infos, suffix)) is not None:
                return [{"doc": path, "reason": reason}]
            return [{"doc": path, "part": i.filename, "data": archive.read(i)} for i in sorted(infos, key=lambda i: i.filename) if not i.is_dir()]
    except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, RuntimeError, ValueError):
        return [{"doc": path, "reason": "corrupt"}]
    except zipfile.zlib.error:
        return [{"doc": path, "reason": "corrupt"}]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield pa.RecordBatch.from_pylist(unpack(path, content or b""), _PARTS)


def read_parts(containers: DataFrame) -> DataFrame:
    """doc, part, data of containers (path, content); a refused one gives one row with a reason."""
    return containers.select("path", "content").mapInArrow(_unpack, "doc string, part string, data binary, reason string")


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Containers below a path, with Spark's own reader, and their parts."""
    return read_parts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def pack(parts: list[tuple[str, bytes]]) -> bytes:
    """A container whose bytes hang on its parts alone: content types first, then by name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in sorted(parts, key=lambda p: (p[0] != CONTENT_TYPES, p[0])):
            info = zipfile.ZipInfo(name, _EPOCH)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o600 << 16
            archive.writestr(info, data)
    return out.getvalue()


def write_containers(parts: DataFrame) -> DataFrame:
    """path, content of documents given as rows (doc, part, data).  A document is at
    most MOST_ENTRIES parts and MOST_TOTAL bytes, so its group fits a task."""

    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame({"path": [key[0]], "content": [pack(list(zip(pdf["part"], map(bytes, pdf["data"]), strict=True)))]})

    return parts.where(F.col("part").isNotNull()).select("doc", "part", "data").groupBy("doc").applyInPandas(run, "path string, content binary")


def replace_parts(parts: DataFrame, changed: DataFrame) -> DataFrame:
    """Parts with some replaced or added: never in place, a new set of rows."""
    return parts.select("doc", "part", "data").join(changed.select("doc", "part"), ["doc", "part"], "left_anti").unionByName(changed.select("doc", "part", "data"))
