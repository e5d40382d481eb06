"""Edits near the ends of a leak, and leaks of a small set of passages."""

import random

import pytest

from tidemill.llm.leakage import PassageSet, is_leak, scan

random.seed(7)
WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("ban", "dor", "fel", "gim") for c in ("st", "nd", "rk", "lt", "x")]
PASSAGES = [(n, " ".join(random.choice(WORDS) for _ in range(80))) for n in range(40)]


def mail(words):
    return "Subject: x\n\nunrelated opening here " + " ".join(words) + " and so it closes\n"


def found(words, items):
    held = PassageSet(items)
    return {i for f in scan([mail(words)], held) if is_leak(f) for i in held.items[f.passage]}


@pytest.mark.parametrize("length, places", [(20, [3]), (20, [18]), (20, [3, 18]), (20, [2, 3]), (21, [3, 19]), (22, [3, 20]), (23, [3, 21])])
def test_edits_near_the_ends(length, places):
    words = PASSAGES[5][1].split()[30 : 30 + length]
    for p in places:
        words[p - 1] = "changed"
    assert found(words, PASSAGES) == {5}


def test_shorter_snippets_are_none():
    assert found(PASSAGES[5][1].split()[30:46], PASSAGES) == set()


@pytest.mark.parametrize("length", [20, 40, 60])
def test_one_short_item(length):
    text = " ".join(f"word{k}" for k in range(length))
    assert found(text.split()[:20], [(1, text)]) == {1}


def test_items_that_are_nearly_alike():
    items = [(k, " ".join([*(f"word{x}" for x in range(30)), f"own{k}"])) for k in range(50)]
    assert found([f"word{x}" for x in range(25)], items) == {k for k, _ in items}
