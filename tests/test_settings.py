"""Settings by dotted names, groups, files."""

import json

import pytest

from lodestone.operators import settings as S


def test_fields():
    s = S.set_field(S.set_field({"case": "lower"}, "length.stem.max", "9"), "extensions", "md, txt,")
    assert s == {"case": "lower", "length": {"stem": {"max": 9}}, "extensions": ["md", "txt"]}
    assert S.find_field(s, "length.stem.max") == 9 and S.find_field(s, "case.x") is None
    assert S.unset_field(s, "length.stem.max") == {"case": "lower", "extensions": ["md", "txt"]} and S.unset_field(s, "words.min") == s
    assert S.set_field({}, "whitespace.trim", "Yes") == {"whitespace": {"trim": True}}
    for name, text in (("case", "odd"), ("nothing", "1"), ("words.min", "x"), ("whitespace.trim", "maybe"), ("similarity.name.threshold", "3")):
        with pytest.raises(ValueError):
            S.set_field({}, name, text)


def test_groups():
    assert S.moved(["a", "b", "c"], "c", before="a") == ["c", "a", "b"] and S.moved(["a", "b", "c"], "a", after="b") == ["b", "a", "c"]
    with pytest.raises(ValueError):
        S.moved(["a"], "a", before="z")
    assert S.group_field("enum", values="x, y")["enum"] == ["x", "y"] and S.group_field("array", "string")["itemType"] == "string"
    for bad in (("enum",), ("array",), ("other",)):
        with pytest.raises(ValueError):
            S.group_field(*bad)
    assert sorted(S.default_group("g", "G", "")["baseFieldsSchema"]) == ["aliases", "id"]


def test_files(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert S.doctor(path) == [("error", "no configuration file")]
    (tmp_path / "c.yaml").write_text("profiles:\n  docs:\n    case: lower\n    extensions:\n    - md\n    words:\n      min: 1\n")
    assert S.load(path) == {"profiles": {"docs": {"case": "lower", "extensions": ["md"], "words": {"min": 1}}}} and S.doctor(path)[0][0] == "ok"
    out = str(tmp_path / "d.json")
    S.save(out, S.load(path) | {"scopes": [{"path": "a", "profile": "none"}]})
    assert S.doctor(out) == [("error", "scope a names no profile")] and json.load(open(out))["profiles"]
    with pytest.raises(ValueError):
        S.save(out, {"profiles": {"x": {"case": "odd"}}})
    assert S.merged({"a": {"b": 1}, "c": 2}, {"a": {"d": 3}, "c": 4}) == {"a": {"b": 1, "d": 3}, "c": 4}
    assert S.snapshot_path("/s", "/r/") == S.snapshot_path("/s/", "/r") != S.snapshot_path("/s", "/q")
