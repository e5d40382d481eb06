"""Leaked passages: recall on planted ones, blocks, parameters and odd inputs."""

import base64
import quopri
import random

import pytest

from tidemill.llm import leakage as lk

random.seed(23)
SYLLABLES = [a + b for a in "bcdfglmnprstv" for b in "aeiou"]
WORDS = sorted({"".join(random.choice(SYLLABLES) for _ in range(random.choice([1, 2, 2, 3]))) for _ in range(1500)})
WEIGHTS = [1 / (k + 3) for k in range(len(WORDS))]
random.shuffle(WORDS)


def prose(rnd, n):
    return rnd.choices(WORDS, WEIGHTS, k=n)


PASSAGES = [(100 + k, " ".join(prose(random.Random(k), 130))) for k in range(60)]
#: Two items share a passage.
PASSAGES.append((900, PASSAGES[0][1]))


def edited(rnd, words):
    """About one word in ten changed, dropped or added."""
    out = []
    for w in words:
        x = rnd.random()
        if x < 0.03:
            continue
        out.append(f"other{rnd.randrange(99)}" if x < 0.07 else w)
        if x > 0.97:
            out.append("added")
    return out


def dressed(rnd, words):
    """The same words in another case, with other line breaks, punctuation and encoding."""
    text = ""
    for k, w in enumerate(words):
        text += (w.upper() if rnd.random() < 0.1 else w.capitalize() if rnd.random() < 0.1 else w) + rnd.choice([" ", " ", " ", ", ", "\n", ". ", "\n> "])
    way = rnd.randrange(4)
    if way == 0:
        return "Subject: x\n\n" + text
    if way == 1:
        return "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(text.encode()).decode()
    if way == 2:
        return "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\r\n\r\n" + quopri.encodestring(text.encode()).decode()
    return "Content-Type: text/html\n\n<html><p>" + text.replace("\n", "<br>").replace(". ", ".</p><p>") + "</p></html>"


def corpus(n=400):
    rnd, docs, truth = random.Random(77), [], set()
    for d in range(n):
        body = prose(rnd, rnd.randrange(30, 300))
        if d % 2 == 0:
            item, text = rnd.choice(PASSAGES[:60])
            words = text.split()
            size = rnd.choice([20, 25, 40, 80, 130])
            at = rnd.randrange(len(words) - size + 1)
            cut = words[at : at + size]
            spot = rnd.randrange(len(body))
            body[spot:spot] = cut if size < 30 else edited(rnd, cut)
            truth |= {(d, item)} | ({(d, 900)} if item == 100 else set())
        elif d % 4 == 1:
            words = rnd.choice(PASSAGES)[1].split()
            at = rnd.randrange(len(words) - 14)
            body += words[at : at + 14]  # too short
        docs.append((d, dressed(rnd, body)))
    return docs, truth


DOCS, TRUTH = corpus()


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.select("doc_id", "item_id").distinct().collect()}


def run(spark, docs, items, **more):
    return lk.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, passage string"), **more)


def test_recall_and_precision(spark):
    found = pairs(run(spark, DOCS, PASSAGES))
    assert len(found & TRUTH) >= 0.97 * len(TRUTH)
    assert len(found - TRUTH) <= 0.01 * len(TRUTH)


def test_the_support_filter_loses_nothing():
    """What the filter of probes before alignment drops, against the same without it."""
    held, free = lk.PassageSet(PASSAGES), lk.PassageSet(PASSAGES)
    free.needed[:] = 0
    texts = [t for _, t in DOCS]
    with_it = {(f.row, f.passage) for f in lk.scan(texts, held) if lk.is_leak(f)}
    without = {(f.row, f.passage) for f in lk.scan(texts, free) if lk.is_leak(f)}
    assert with_it <= without and len(without - with_it) <= 0.01 * len(without)


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    whole = sorted(map(tuple, run(spark, DOCS, PASSAGES).collect()))
    monkeypatch.setattr(lk, "BLOCK_ITEMS", 40)
    assert sorted(map(tuple, run(spark, DOCS, PASSAGES).collect())) == whole
    monkeypatch.setattr(lk, "BLOCK_ITEMS", 4096)
    monkeypatch.setattr(lk, "BLOCK_CHARS", 30_000)
    assert sorted(map(tuple, run(spark, DOCS, PASSAGES).collect())) == whole


def test_documents_are_decoded_once_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK_ITEMS", 40)
    plan = run(spark, DOCS, PASSAGES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and plan.count("LogicalRDD") == plan.count("MapInArrow")


def test_a_block_beyond_its_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK_CHARS", 100)
    with pytest.raises(ValueError):
        run(spark, DOCS[:2], PASSAGES[:3])


def test_long_passages_go_in_segments(spark, monkeypatch):
    monkeypatch.setattr(lk, "SEGMENT", 60)
    monkeypatch.setattr(lk, "OVERLAP", 25)
    text = PASSAGES[3][1]
    words = text.split()
    docs = [(k, " ".join(words[k : k + 25])) for k in range(0, 105, 5)]
    found = pairs(lk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, passage string")))
    assert found == {(k, 1) for k, _ in docs}


@pytest.mark.parametrize("least, hit", [(20, False), (14, True)])
def test_least_words_is_a_parameter(spark, least, hit):
    words = PASSAGES[7][1].split()[20:34]
    assert bool(run(spark, [(1, "Subject: a\n\n" + " ".join(words))], PASSAGES, least=least).collect()) == hit


def test_nulls_empties_repeats_and_clashing_names(spark):
    leak = "Subject: a\n\n" + " ".join(PASSAGES[9][1].split()[:40])
    docs = spark.createDataFrame([(1, leak), (1, leak), (2, None), (3, ""), (None, leak), (4, "Subject: only")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'x' AS part", "1 AS passage", "2 AS item_id", "'w' AS words")
    items = spark.createDataFrame([(*PASSAGES[9], 5), (*PASSAGES[9], 5), (None, PASSAGES[9][1], 1), (7, None, 1), (8, "", 1), (9, "three short words", 1)], "item_id long, passage string, doc_id int")
    got = lk.leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 109), (1, 109)]
    assert lk.leaks(docs.limit(0), items).collect() == [] == lk.leaks(docs, items.limit(0)).collect()


def test_removal_of_documents_and_spans(spark):
    words = PASSAGES[9][1].split()
    docs = spark.createDataFrame([(1, "Subject: a\n\nbefore " + " ".join(words[:40]) + " after"), (2, "Subject: b\n\nnothing here"), (None, "x")], "doc_id long, text string")
    found = lk.leaks(docs, spark.createDataFrame([PASSAGES[9]], "item_id long, passage string"))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in lk.without_leaked_documents(docs, found).collect()) == [(False, 2), (True, None)]
    assert [(r["doc_id"], r["clean"].split()) for r in lk.without_leaked_spans(docs, found).collect()] == [(1, ["before", "after"])]


def test_a_very_long_text(spark):
    rnd = random.Random(5005)
    body = prose(rnd, 300_000)
    body[200_000:200_000] = PASSAGES[11][1].split()[10:50]
    assert pairs(run(spark, [(1, "Subject: a\n\n" + " ".join(body))], PASSAGES)) == {(1, 111)}
