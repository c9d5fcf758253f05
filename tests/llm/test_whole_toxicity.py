"""A word and the family of its beginning are two entries."""

import pytest

from lodestone.llm import toxicity


@pytest.mark.parametrize("entries", [("abcd", "abcd*"), ("abcd*", "abcd")])
def test_word_and_family(entries):
    weights = dict(zip(entries, (3.0, 2.0), strict=True))
    m = toxicity.Matcher(toxicity.Lexicon(weights, (), (1.0, 0.1, -0.5)))
    assert [w for _, _, w in m.matches("an abcdish thing")] == [weights["abcd*"]]
    assert [w for _, _, w in m.matches("an abcd thing")] == [max(weights.values())]
