"""Settings of naming profiles and registry groups: fields by dotted names, health, files; and where snapshots lie.

All of it is small and belongs to the driver: mappings in, mappings out, nothing is changed in place.
"""

from __future__ import annotations

import copy
import hashlib
import json
import os

from lodestone.operators.frontmatter import parse_yaml
from lodestone.operators.naming import settings_errors

#: Fields of a profile by dotted name, and the kind of their values.
FIELDS = {
    "unicode": "text",
    "case": "text",
    "separator": "text",
    "stemRegex": "text",
    "extensions": "list",
    "prefix.required": "text",
    "whitespace.trim": "flag",
    "flagControlCharacters": "flag",
    "flagTrimWhitespace": "flag",
    "length.stem.min": "whole",
    "length.stem.max": "whole",
    "words.min": "whole",
    "words.max": "whole",
    "similarity.name.threshold": "number",
}
FLAGS = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
#: Kinds of fields of a group.
GROUP_FIELDS = ("string", "number", "boolean", "array", "enum")


def listed(text: str) -> list[str]:
    """Parts between commas, trimmed, without empty ones."""
    return [x.strip() for x in text.split(",") if x.strip()]


def find_field(settings: dict, name: str):
    """A field's value, None where a part of its name is missing."""
    at: object = settings
    for part in name.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return at


def _typed(kind: str, text: str):
    if kind == "list":
        return listed(text)
    if kind == "flag":
        if text.strip().lower() not in FLAGS:
            raise ValueError(f"neither true nor false: {text}")
        return FLAGS[text.strip().lower()]
    return {"text": str, "whole": int, "number": float}[kind](text)


def set_field(settings: dict, name: str, text: str) -> dict:
    """settings with a field set from text; unknown fields and settings that turn out wrong are errors."""
    if name not in FIELDS:
        raise ValueError(f"no field {name}")
    out = copy.deepcopy(settings)
    *path, last = name.split(".")
    at = out
    for part in path:
        at = at.setdefault(part, {})
    at[last] = _typed(FIELDS[name], text)
    if errors := settings_errors(out):
        raise ValueError("; ".join(errors))
    return out


def unset_field(settings: dict, name: str) -> dict:
    """settings without a field, and without mappings that it leaves empty."""
    if name not in FIELDS:
        raise ValueError(f"no field {name}")
    out = copy.deepcopy(settings)
    chain, at = [], out
    *path, last = name.split(".")
    for part in path:
        if not isinstance(at.get(part), dict):
            return out
        chain.append((at, part))
        at = at[part]
    at.pop(last, None)
    for above, part in reversed(chain):
        if not above[part]:
            del above[part]
    return out


def merged(base: dict, over: dict) -> dict:
    """base with over on top, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    """A configuration of profiles from a JSON or YAML file; wrong profiles are errors."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    found = json.loads(text) if path.endswith(".json") else parse_yaml(text)
    _checked(found)
    return found


def save(path: str, config: dict) -> None:
    """Writes a checked configuration as JSON, which is YAML too; the file is replaced at once."""
    _checked(config)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2, ensure_ascii=False, sort_keys=True)
    os.replace(f"{path}.new", path)


def _checked(config: dict) -> None:
    errors = [f"{name}: {e}" for name, p in (config.get("profiles") or {}).items() for e in settings_errors(p or {})]
    if errors:
        raise ValueError("; ".join(errors))


def doctor(path: str) -> list[tuple[str, str]]:
    """(level, finding) about a configuration file; one of level ok if nothing is wrong."""
    if not os.path.exists(path):
        return [("error", "no configuration file")]
    try:
        config = load(path)
    except (ValueError, OSError) as e:
        return [("error", str(e))]
    found = []
    profiles = config.get("profiles") or {}
    if not profiles:
        found.append(("warning", "no profiles"))
    for s in config.get("scopes") or []:
        if isinstance(s, dict) and s.get("profile") not in profiles:
            found.append(("error", f"scope {s.get('path')} names no profile"))
    return found or [("ok", "nothing is wrong")]


def group_field(kind: str, item: str | None = None, values: str | None = None, required: bool = False, description: str = "") -> dict:
    """The schema of a group's field: an enum needs values, an array the kind of its items."""
    if kind not in GROUP_FIELDS:
        raise ValueError(f"no kind {kind}")
    if kind == "enum" and not listed(values or ""):
        raise ValueError("an enum needs values")
    if kind == "array" and not item:
        raise ValueError("an array needs the kind of its items")
    out = {"type": kind, "required": required, "description": description}
    return out | ({"enum": listed(values)} if kind == "enum" else {}) | ({"itemType": item} if kind == "array" else {})


def default_group(group_id: str, name: str, description: str) -> dict:
    """A group with an id and aliases as its own fields and one custom field at most."""
    fields = {"id": group_field("string", required=True, description="Unique id"), "aliases": group_field("array", "string", required=True, description="Other names")}
    return {"groupId": group_id, "groupName": name, "description": description, "baseFieldsSchema": fields, "customFieldAllowed": {"enabled": True, "maxOne": True}, "entries": []}


def moved(groups: list[str], name: str, before: str | None = None, after: str | None = None) -> list[str]:
    """groups with one of them placed before or after another."""
    mark = before or after
    if name not in groups or mark not in groups or (before and after):
        raise ValueError(f"can't place {name}")
    if name == mark:
        return list(groups)
    rest = [g for g in groups if g != name]
    k = rest.index(mark) + (after is not None)
    return [*rest[:k], name, *rest[k:]]


def snapshot_path(state_dir: str, root: str) -> str:
    """Where the snapshot of a root lies unless told otherwise: by 64 bits of the root's name."""
    key = hashlib.blake2b(root.rstrip("/").encode(), digest_size=8).hexdigest()
    return f"{state_dir.rstrip('/')}/snapshots/{key}"
