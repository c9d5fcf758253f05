"""Licenses inside longer documents."""

import random

import pytest

from lodestone.llm import license_texts, licenses

MIT = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
PARTS = [MIT[: MIT.index("The above")], MIT[MIT.index("The above") : MIT.index("THE SOFTWARE IS")], MIT[MIT.index("THE SOFTWARE IS") :]]
OTHER = " ".join(f"word{i}" for i in range(100))


def found(text):
    return {(n, text[a:b]) for _, _, n, a, b in licenses.Scanner().matches(text)}


@pytest.mark.parametrize("between", ["\n\n", "\n"])
def test_license_of_several_paragraphs_in_a_document(between):
    text = between.join([OTHER, *(p.strip() for p in PARTS), OTHER])
    assert found(text) == {("MIT", between.join(p.strip() for p in PARTS).rstrip("."))}


def test_sentence_in_a_longer_line():
    text = "This module is Licensed under the Apache License, Version 2.0. See NOTICE for details."
    assert found(text) == {("Apache-2.0", "Licensed under the Apache License, Version 2.0")}
    text = "İstanbul " * 30 + text
    assert found(text) == {("Apache-2.0", "Licensed under the Apache License, Version 2.0")}


@pytest.mark.parametrize(("name", "full"), [("Apache-2.0", license_texts.APACHE_2_0), ("GPL-3.0", license_texts.GPL_3_0), ("MPL-2.0", license_texts.MPL_2_0), ("CC0-1.0", license_texts.CC0_1_0)])
def test_full_texts(name, full):
    got = found(f"{OTHER}\n\n{full}\n\n{OTHER}")
    assert any(n == name and len(t) > 0.9 * len(full.strip()) for n, t in got)


def test_windows_by_brute_force():
    rnd = random.Random(7)
    templates = [("A", "a b c d e f"), ("B", "c d a b")]
    s = licenses.Scanner(templates)
    for _ in range(400):
        ws = [rnd.choice("abcdefx") for _ in range(rnd.randint(2, 25))]
        text = " ".join(ws)
        got = {n for _, _, n, _, _ in s.matches(text)}
        want = set()
        for n, t in templates:
            g = licenses.bigrams(t.split())
            most = len(t.split()) / s.least + 1
            if any(licenses.dice(licenses.bigrams(ws[i:j]), g) >= s.threshold for i in range(len(ws)) for j in range(i + 2, len(ws) + 1) if j - i <= most):
                want.add(n)
        assert want <= got
