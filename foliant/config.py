"""Settings from the environment, and what a server of the command surface offers."""

from __future__ import annotations

import os
from dataclasses import dataclass

from foliant.functions.text import MAIN_PARTS

TRANSFER_BYTES, LEAST_TRANSFER = 25 << 20, 1


class FoliantError(Exception):
    """Root of what the command surface raises; operators give reasons in rows instead."""


class PackageError(FoliantError):
    """A container that can't be read."""


class EditRefused(FoliantError):
    """A change that would not be accounted for."""


class VerificationFailed(FoliantError):
    """A document that does not verify."""


def transfer_bytes(environ: dict[str, str] | None = None, name: str = "FOLIANT_TRANSFER_MAX_BYTES") -> int:
    """The cap on bytes in and out; a value that is no positive number is an error, not a default."""
    raw = (os.environ if environ is None else environ).get(name, "").strip()
    if not raw:
        return TRANSFER_BYTES
    if not raw.isdecimal() or int(raw) < LEAST_TRANSFER:
        raise ValueError(f"{name} must be a positive whole number of bytes, not {raw!r}")
    return int(raw)


def read_only(environ: dict[str, str] | None = None, name: str = "FOLIANT_READ_ONLY") -> bool:
    """Only plain words for yes turn writing off."""
    return (os.environ if environ is None else environ).get(name, "").strip().lower() in ("1", "true", "yes", "on")


def roots(environ: dict[str, str] | None = None, name: str = "FOLIANT_ROOTS") -> list[str]:
    """Folders that the command surface may touch; the working folder if none is named."""
    raw = (os.environ if environ is None else environ).get(name, "")
    return [os.path.abspath(p) for p in raw.split(os.pathsep) if p] or [os.getcwd()]


def supported_suffixes() -> list[str]:
    return sorted(MAIN_PARTS)


@dataclass(frozen=True)
class Tool:
    name: str
    effect: str  # reads, writes or session


TOOLS = (
    Tool("server_info", "reads"), Tool("digest", "reads"), Tool("verify", "reads"), Tool("list_receipts", "reads"), Tool("export_document", "reads"), Tool("export_receipt", "writes"),
    Tool("import_document", "writes"), Tool("open_document", "session"), Tool("close_document", "session"), Tool("describe_structure", "session"), Tool("find_text", "session"),
    Tool("preview_edits", "session"), Tool("apply_edits", "session"), Tool("delete_paragraph", "session"), Tool("insert_paragraph", "session"), Tool("commit_document", "session"),
)


def offered(only_reading: bool) -> list[str]:
    """Names of the tools; where nothing may be written, sessions are not offered either."""
    return [t.name for t in TOOLS if not only_reading or t.effect == "reads"]
