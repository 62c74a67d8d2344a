"""Archives and single files that somebody hands in: taken apart below one folder, or refused with a reason.

This is work of one machine before Spark reads the folder; sizes are bounded before anything is unpacked."""

from __future__ import annotations

import hashlib
import io
import re
import stat
import zipfile
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from claimgraph.compiler.corpus import ANALYSED, LANGUAGES

# The most bytes of an archive, of all that it holds, of one member, and the most files.
MAX_ARCHIVE, MAX_TOTAL, MAX_MEMBER, MAX_FILES = 200 << 20, 400 << 20, 32 << 20, 20_000


class Refused(ValueError):
    """An archive or a name that is not taken in at all."""


@dataclass(frozen=True)
class Report:
    path: str
    size: int
    sha256: str
    status: str  # ACCEPTED, UNSUPPORTED or REJECTED
    reason: str
    language: str | None = None


def classify(path: str, body: bytes) -> Report:
    """What will be made of a file: it is analysed, or only recorded."""
    end = PurePosixPath(path).suffix.lower()
    known = end in ANALYSED
    reason = "an analyser exists for this format" if known else f"no analyser exists for {end or 'this file'}; it is recorded without symbols and claims"
    return Report(path, len(body), hashlib.sha256(body).hexdigest(), "ACCEPTED" if known else "UNSUPPORTED", reason, LANGUAGES.get(end))


def destination(folder: Path, name: str) -> Path:
    """Where a member goes below a folder; Refused for what would land elsewhere, also through links that are there."""
    plain = name.replace("\\", "/")
    if plain.startswith("/") or re.match("[A-Za-z]:", plain):
        raise Refused(f"absolute path: {name!r}")
    if ".." in plain.split("/"):
        raise Refused(f"path traversal: {name!r}")
    top = folder.resolve()
    target = (top / plain).resolve()
    if target == top or not target.is_relative_to(top):
        raise Refused(f"member escapes the folder: {name!r}")
    return target


def _place(folder: Path, name: str, body: bytes) -> Report:
    target = destination(folder, name)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(body)
    return classify(name, body)


def unpack(archive: bytes, folder: Path) -> list[Report]:
    """Write the files of a zip archive below a folder, one report for each. Links, members that are too large or say a smaller
    size than they have, and those that would land elsewhere are rejected one by one."""
    if len(archive) > MAX_ARCHIVE:
        raise Refused(f"archive has {len(archive)} bytes, more than {MAX_ARCHIVE}")
    try:
        opened = zipfile.ZipFile(io.BytesIO(archive))
    except zipfile.BadZipFile as e:
        raise Refused(f"not a readable archive: {e}") from None
    reports = []
    with opened:
        members = [m for m in opened.infolist() if not m.is_dir()]
        if len(members) > MAX_FILES:
            raise Refused(f"{len(members)} files, more than {MAX_FILES}")
        if sum(m.file_size for m in members) > MAX_TOTAL:
            raise Refused(f"expands to more than {MAX_TOTAL} bytes")
        folder.mkdir(parents=True, exist_ok=True)
        for m in members:
            try:
                if stat.S_ISLNK(m.external_attr >> 16):
                    raise Refused("links are not extracted")
                if m.file_size > MAX_MEMBER:
                    raise Refused(f"member has more than {MAX_MEMBER} bytes")
                destination(folder, m.filename)
                with opened.open(m) as source:
                    body = source.read(MAX_MEMBER + 1)
                if len(body) > MAX_MEMBER or len(body) > m.file_size:
                    raise Refused("declared size understates the real one")
                reports.append(_place(folder, m.filename, body))
            except (Refused, zipfile.BadZipFile, OSError) as e:
                reports.append(Report(m.filename, m.file_size, "", "REJECTED", str(e)))
    return reports


def take_file(name: str, body: bytes, folder: Path) -> Report:
    """Write one file, by its last name, below a folder."""
    return _place(folder, PurePosixPath(name.replace("\\", "/")).name, body)
