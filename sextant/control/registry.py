"""Runs as folders with a manifest each."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

STATUSES = ("passed", "failed", "error")


@dataclass
class Manifest:
    """What a run was given and what it made."""

    run_id: str
    created_at: str
    status: str
    name: str | None = None
    artifacts: dict[str, str] = field(default_factory=dict)
    inputs: dict[str, str] = field(default_factory=dict)
    digests: dict[str, str] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)
    summaries: dict[str, Any] = field(default_factory=dict)
    failures: list[str] = field(default_factory=list)
    schema_version: str = "1"


def slug(value: str | None) -> str:
    """A name as part of a folder's name: at most 48 characters."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "-", (value or "").strip()).strip("-._").lower()[:48]


def reserve(registry: str | Path, name: str | None = None, now: datetime | None = None) -> tuple[str, Path]:
    """A new run's id and folder: the time, the name, and a number if both are taken."""
    base = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ") + (f"-{s}" if (s := slug(name)) else "")
    n = 1
    while True:
        run_id = base if n == 1 else f"{base}-{n}"
        folder = Path(registry) / run_id
        try:
            folder.mkdir(parents=True)
            return run_id, folder
        except FileExistsError:
            n += 1


def write(folder: str | Path, manifest: Manifest) -> None:
    (Path(folder) / "manifest.json").write_text(json.dumps(asdict(manifest), indent=2), encoding="utf-8")


def read(path: str | Path) -> Manifest:
    """A run's manifest; one with unknown or missing fields is a ValueError."""
    file = Path(path) / "manifest.json" if Path(path).is_dir() else Path(path)
    data = json.loads(file.read_text(encoding="utf-8"))
    try:
        made = Manifest(**data)
    except TypeError as e:
        raise ValueError(f"{file}: {e}") from e
    if made.status not in STATUSES:
        raise ValueError(f"{file}: status {made.status!r}")
    return made


def runs(registry: str | Path) -> list[Manifest]:
    """All valid manifests, the newest first."""
    found = []
    for file in sorted(Path(registry).glob("*/manifest.json"), reverse=True):
        try:
            found.append(read(file))
        except ValueError:  # JSON errors are ValueErrors too
            continue
    return found


def digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def commit_of(root: str | Path) -> str | None:
    """The commit that a folder is at, if it is under version control."""
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=2, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None
