"""Carrying out a simulated plan against duplicates, and taking it back: actions of the driver on files, never part of a query."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

ACTIONS = ("trash", "delete", "hard_link")


@dataclass
class Entry:
    target: str
    action: str
    backup: str
    restored: bool = False


@dataclass
class Journal:
    root: str
    executed: int
    entries: list[Entry] = field(default_factory=list)


def _digest(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _checked(path: Path, sha256: str | None) -> None:
    if sha256 and _digest(path) != sha256.lower():
        raise ValueError(f"{path} changed since it was indexed")


def execute(actions: Iterable[dict], root: str, backup: str, action: str = "trash") -> Journal:
    """Carries out actions (path, canonical, sha256, rejection) below root and keeps every file it takes in backup.

    Nothing is done if the simulation rejects any action but those that a rule allows, which are
    left out. Each file is hashed again first; one that changed ends the run. A hard link takes
    the file's place at once or not at all. Files that are gone are left out.
    """
    if action not in ACTIONS:
        raise ValueError(f"no action {action}")
    todo = [a for a in actions if a.get("rejection") != "allowed"]
    blocked = [a["path"] for a in todo if a.get("rejection")]
    if blocked:
        raise PermissionError(f"{len(blocked)} actions are blocked: {blocked[:5]}")
    journal = Journal(root, int(time.time()))
    for a in todo:
        target, kept = Path(root, a["path"]), Path(backup, a["path"])
        if not target.exists():
            continue
        _checked(target, a.get("sha256"))
        kept.parent.mkdir(parents=True, exist_ok=True)
        if action == "trash":
            shutil.move(target, kept)
        else:
            shutil.copy2(target, kept)
            if action == "delete":
                target.unlink()
            else:
                canonical, link = Path(root, a["canonical"]), target.with_name(f".{target.name}.{os.getpid()}.link")
                try:
                    _checked(canonical, a.get("sha256"))
                    os.link(canonical, link)
                    os.replace(link, target)
                except BaseException:
                    link.unlink(missing_ok=True)
                    raise
        journal.entries.append(Entry(a["path"], action, str(kept)))
    return journal


def rollback(journal: Journal) -> int:
    """Puts back what a journal's entries took and were not put back yet; the number of files."""
    n = 0
    for e in journal.entries:
        if not e.restored and os.path.exists(e.backup):
            target = Path(journal.root, e.target)
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.move(e.backup, target)
            e.restored = True
            n += 1
    return n
