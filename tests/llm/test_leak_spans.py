"""Every leaked stretch of a document is reported and cut."""

import random

from tidemill.llm.leakage import PassageSet, _cut_words, is_leak, scan

random.seed(11)
WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("ban", "dor", "fel", "gim") for c in ("st", "nd", "rk", "lt", "x")]
PASSAGES = [(n, " ".join(random.choice(WORDS) for _ in range(120))) for n in range(40)]
HELD = PassageSet(PASSAGES)
P = PASSAGES[5][1].split()
GAP = [f"between{k}" for k in range(40)]


def leaks(text):
    return [f for f in scan([text], HELD) if is_leak(f)]


def clean(text):
    return _cut_words(text, [(f.part, f.begin, f.end) for f in leaks(text)])


def mail(*stretches):
    return "Subject: x\n\n" + " ".join(w for s in stretches for w in s) + "\n"


def test_copies_are_all_cut():
    text = mail(["before"], P[10:40], GAP, P[10:40], ["after"])
    assert len(leaks(text)) == 2
    assert clean(text).split() == ["before", *GAP, "after"]


def test_two_stretches_on_one_diagonal():
    text = mail(P[:30], GAP, P[70:100])
    assert len(leaks(text)) == 2
    assert clean(text).split() == GAP


def test_a_copy_in_each_of_two_parts():
    body = " ".join(P[10:40])
    text = f'MIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/plain\n\n{body} one\n--b\nContent-Type: text/html\n\n<p>{body} two</p>\n--b--\n'
    assert sorted(f.part for f in leaks(text)) == [0, 1]
    assert clean(text).split() == ["one", "two"]


def test_clean_stretch_that_runs_on_into_an_edited_one():
    tail = [w if k % 4 else f"other{k}" for k, w in enumerate(P[20:60])]
    assert leaks(mail(P[:20], tail))


def test_longer_edited_copy_does_not_hide_a_clean_one():
    edited = [w if k % 4 else f"other{k}" for k, w in enumerate(P[:80])]
    assert leaks(mail(edited, GAP, P[90:112]))


def test_overlapping_spans_are_merged():
    assert _cut_words("\na b c d e f g", [(0, 1, 4), (0, 3, 6)]).split() == ["a", "g"]
