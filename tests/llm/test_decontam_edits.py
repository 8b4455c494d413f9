"""Items with an edited word are found, other texts aren't, and shards don't change scores."""

import random

import numpy as np
import pytest

from quakeframe.llm import decontam

WORDS = [f"w{k}" for k in range(400)]
COLUMNS = "item_id long, text string"


def item_texts(rng):
    """30 words in one sentence; 40 words in several, the last of which has six; the same with one of one word."""
    w = [rng.sample(WORDS, 40) for _ in range(3)]
    return [" ".join(w[0][:30]), f"{' '.join(w[1][:20])}. {' '.join(w[1][20:34])}? {' '.join(w[1][34:])}.", f"{' '.join(w[2][:39])}? {w[2][39]}."]


@pytest.mark.parametrize("edit", ["replaced", "left out", "put in"])
def test_one_edited_word(spark, edit):
    rng = random.Random(7)
    items = item_texts(rng)
    docs, want = [], set()
    for i, text in enumerate(items):
        words = text.split(" ")
        for k in range(len(words)):
            w = {"replaced": [*words[:k], "edited", *words[k + 1 :]], "left out": words[:k] + words[k + 1 :], "put in": [*words[:k], "edited", *words[k:]]}[edit]
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(["some prose", *rng.choices(WORDS, k=50), *w, *rng.choices(WORDS, k=50)])))
    clean = [(10_000 + k, " ".join(rng.choices(WORDS, k=200))) for k in range(100)]
    # all the words of an item, but in another order; and half of an item
    clean += [(20_000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in enumerate(items)]
    clean += [(30_000 + i, t[: len(t) // 2]) for i, t in enumerate(items)]
    got = decontam.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), COLUMNS))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_other_documents_are_left_alone(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = bench.collect()
    want = {(d.doc_id, i.item_id) for d in docs.select("doc_id", "text").collect() for i in items if i.text in (d.text or "")}
    assert want and {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want


def test_fewest_edits():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 12))

        def distance(x, y):
            d = np.add.outer(np.arange(len(x) + 1), np.arange(len(y) + 1))
            for i in range(1, len(x) + 1):
                for j in range(1, len(y) + 1):
                    d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            return d[-1, -1]

        assert decontam.fewest_edits(a, b) == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def test_shards_have_the_whole_benchmarks_numbers(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    index = decontam.Index([(r.item_id, r.text) for r in bench.collect()], 5)
    whole = {i: dict(zip(index.terms[np.searchsorted(index.begin, np.flatnonzero(index.item == k), "right") - 1].tolist(), index.impact[index.item == k], strict=True)) for k, i in enumerate(index.ids)}
    one = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2_000)
    parts = [x for shared in decontam.passes(bench, 5) for x in decontam.built(shared)]
    assert len(parts) > 1 and sum(len(x.ids) for x in parts) == len(index.ids)
    for x in parts:
        for k, i in enumerate(x.ids):
            at = np.flatnonzero(x.item == k)
            got = dict(zip(x.terms[np.searchsorted(x.begin, at, "right") - 1].tolist(), x.impact[at], strict=True))
            assert got.keys() == whole[i].keys() and all(abs(got[t] - whole[i][t]) < 1e-12 for t in got)
    assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.contaminated(docs, bench).collect()) == one


def test_other_items_do_not_change_what_is_found(spark):
    """Question and answer far apart aren't the item, also if a longer item makes long passages."""
    question, answer = "What colour does the ninth moon of the farthest planet have at noon in winter? ", "It is as green as old copper under rain."
    filler = " ".join(f"filler{k}" for k in range(3000))
    docs = spark.createDataFrame([(1, question + filler + " " + answer), (2, filler + " " + question + answer), (3, filler)], "doc_id long, text string")
    items = [(7, question + answer)]
    longer = [*items, (8, " ".join(f"long{k}" for k in range(4000)) + ". The end of it.")]
    found = [sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(x, "item_id long, text string")).collect()) for x in (items, longer)]
    assert found == [[(2, 7)], [(2, 7)]]
    whole = spark.createDataFrame([(4, filler + " " + longer[1][1] + " " + filler)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(whole, spark.createDataFrame(longer, "item_id long, text string")).collect()] == [(4, 8)]
