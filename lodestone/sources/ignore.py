"""Ignore files: the rules of a folder and those above it, the last that fits decides."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

#: Files that hold rules, later ones over earlier ones.
FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    keeps: bool
    folders: bool
    base: str

    def fits(self, path: str, folder: bool) -> bool:
        if self.folders and not folder or not path.startswith(self.base):
            return False
        return self.pattern.fullmatch(path[len(self.base) :]) is not None


def _expression(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (not i or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out.append("[" + ("^" if glob[i + 1] in "!^" else "") + re.escape(glob[i + 1 + (glob[i + 1] in "!^") : end]).replace(r"\-", "-") + "]")
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def rule(line: str, base: str = "") -> Rule | None:
    """The rule of a line in a folder (base ends with / or is ''), None for blank lines and comments."""
    line = line.rstrip("\n\r")
    line = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[keeps:]
    folders = line.endswith("/")
    body = line.rstrip("/")
    if not body:
        return None
    anchored = "/" in body
    glob = body.lstrip("/") if anchored else "**/" + body
    try:
        return Rule(re.compile(_expression(glob), re.S), keeps, folders, base)
    except re.error:
        return None


def rules_of(folder: str, base: str) -> list[Rule]:
    """The rules that a folder's own ignore files hold."""
    found = []
    for name in FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                found += [r for line in f if (r := rule(line, base))]
        except OSError:
            continue
    return found


def ignored(path: str, folder: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that fits a path, relative to the root, leaves it out."""
    for r in reversed(rules):
        if r.fits(path, folder):
            return not r.keeps
    return False
