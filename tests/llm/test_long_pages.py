"""Templates of long pages are made as those of short ones."""

import random
from difflib import SequenceMatcher

from codeloom.llm import wrappers


def test_matches_equal_those_of_a_plain_matcher():
    rng = random.Random(7)
    for n, m, kinds in ((400, 300, 3), (700, 90, 20), (300, 500, 60), (250, 250, 1)):
        a, b = ([str(rng.randrange(kinds)) for _ in range(k)] for k in (n, m))
        b[20:60] = a[100:140]
        assert wrappers.Matcher(a, b).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def page(number: int, parts: int) -> str:
    rng = random.Random(1)
    body = []
    for i in range(parts):
        tag = rng.choice(["p", "h2", "blockquote", "pre", "h3", "ul"])
        if i % 97 != number:  # each page has a shape of its own
            body.append(f"<{tag}>word {number} {i}</{tag}>")
    return f"<html><body><article>{''.join(body)}<section><b>the same everywhere</b></section></article></body></html>"


def test_constant_texts_of_long_pages_go():
    for parts in (100, 1500):
        shapes = {}
        for number in range(3):
            nodes = wrappers.fold(wrappers.stream(page(number, parts)))
            shapes[wrappers.shape_key(nodes)] = (nodes, [number])
        assert len(shapes) == 3 and (parts == 100 or all(len(n) > 3000 for n, _ in shapes.values()))
        rules = wrappers.templates(shapes)
        assert len(rules) == 3 and all(len(drop) == 1 for _, drop, _ in rules.values())
        label, drop, keep = next(iter(rules.values()))
        assert "the same" not in wrappers.extract(page(1, parts), label, frozenset(drop), frozenset(keep))
