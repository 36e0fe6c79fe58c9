"""A release of a base's data: one zip with a manifest, the same bytes for the same files, and its checksum beside it.

A release is a single file for download, so one process writes it, block by block: no file is held whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

#: What a bundle holds and refuses.
FOLDERS = ("registry", "snapshots", "managed_sources", "reports")
UNFINISHED = (".wal", ".shm", ".tmp")
MANIFEST = "DATA_MANIFEST.json"
BLOCK = 1 << 20


def _entry(name: str, size: int) -> zipfile.ZipInfo:
    """An entry without time, system or mode, so that only names and bytes decide the archive."""
    info = zipfile.ZipInfo(name)
    info.compress_type, info.create_system, info.external_attr, info.file_size = zipfile.ZIP_DEFLATED, 0, 0, size
    return info


def _blocks(path: Path) -> Iterator[bytes]:
    with path.open("rb") as f:
        while block := f.read(BLOCK):
            yield block


def release_files(data: Path, folders: Sequence[str] = FOLDERS) -> list[tuple[str, Path]]:
    """(name in the bundle, file) of all files, by name. A missing folder or an unfinished file is an error."""
    found = []
    for folder in folders:
        if not (data / folder).is_dir():
            raise FileNotFoundError(f"the folder {data / folder} is missing")
        found += [(f"data/{p.relative_to(data).as_posix()}", p) for p in (data / folder).rglob("*") if p.is_file()]
    for name, path in found:
        if path.suffix.lower() in UNFINISHED:
            raise ValueError(f"{name} is a temporary file")
    return sorted(found)


def build_bundle(root: str, output: str, version: str, name: str, folders: Sequence[str] = FOLDERS, left_out: Sequence[str] = ()) -> tuple[str, str]:
    """Paths of ``{name}-{version}.zip`` and its ``.sha256``, both put in place when whole; ``left_out`` is told in the manifest."""
    data = (Path(root) / "data").resolve()
    files = release_files(data, folders)
    out = Path(output).resolve()
    out.mkdir(parents=True, exist_ok=True)
    target = out / f"{name}-{version}.zip"
    staging = out / f".{target.name}.{uuid.uuid4().hex}.tmp"
    listed = []
    try:
        with zipfile.ZipFile(staging, "w") as archive:
            for inside, path in files:
                digest, size = hashlib.sha256(), 0
                with archive.open(_entry(inside, path.stat().st_size), "w") as entry:
                    for block in _blocks(path):
                        digest.update(block)
                        size += len(block)
                        entry.write(block)
                listed.append({"path": inside, "size": size, "sha256": digest.hexdigest()})
            manifest = {
                "format": name, "version": version, "included_roots": [f"data/{f}" for f in folders], "excluded_roots": [f"data/{f}" for f in left_out], "files": listed,
            }
            told = (json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()
            archive.writestr(_entry(f"data/{MANIFEST}", len(told)), told)
        whole = hashlib.sha256()
        for block in _blocks(staging):
            whole.update(block)
        os.replace(staging, target)
    finally:
        staging.unlink(missing_ok=True)
    check = out / f"{target.name}.sha256"
    write_text(check, f"{whole.hexdigest()}  {target.name}\n")
    return str(target), str(check)


def write_text(path: str | Path, text: str) -> None:
    """Put a small file in place whole: written aside, flushed to the disk and renamed. ``reports.write_lines`` writes tables."""
    path = Path(path)
    staging = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
    try:
        with staging.open("w", encoding="utf-8", newline="\n") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staging, path)
    finally:
        staging.unlink(missing_ok=True)


def write_json(path: str | Path, value: object) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")
