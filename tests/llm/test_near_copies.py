"""Near copies with null or repeated ids: one row of each group stays."""

import numpy as np

from quakeframe.llm import jaccard, stages

LONG = " ".join(f"w{k}" for k in range(60))
OTHER = " ".join(f"v{k}" for k in range(60))


def near(text, k):
    """``text`` with its last word changed."""
    return f"{text.rsplit(' ', 1)[0]} x{k}"


def test_one_row_of_a_group_stays(spark):
    rows = [
        (5, LONG), (5, near(OTHER, 1)), (3, OTHER), (5, near(LONG, 1)),  # id 5 names a component, and copies those of ids 3 and 5
        (None, near(LONG, 2)), (None, LONG),  # copies without an id of a row that has one
        (None, "only here " + LONG[::-1]), (None, "only here " + LONG[::-1]), (None, near("only here " + LONG[::-1], 1)),
        (8, ""), (9, None), (9, None), (None, None), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = stages.near_copies(spark, docs, "")
    kept = [(r.doc_id, r.text) for r in got.collect()]
    words = [(d, t) for d, t in kept if t]
    assert sorted((d for d, _ in words), key=str) == [3, 5, None]
    assert (3, OTHER) in words and any(d == 5 and t.startswith("w0 ") for d, t in words) and any(d is None and t.startswith("only here") for d, t in words)
    assert sorted(((d, t) for d, t in kept if not t), key=str) == sorted([(8, ""), (9, None), (None, None), (None, "")], key=str)
    assert got.columns == docs.columns


def test_signatures_are_packed_and_long_buckets_leave_in_pieces(spark, monkeypatch):
    """Texts of 400 words have some 120 signatures each, and were as many rows of a shuffle. Sixty sets that differ in one word share most of them, three times ``chunk`` and more."""
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(400)]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(300)] + [" ".join([*base[:-1], f"x{k}"]) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:5])], "doc_id long, text string").repartition(2).persist()
    sets = list(jaccard.shingle_sets([t.encode() for t in texts], 5))
    want = {}
    for node, s in zip(jaccard.nodes_of(sets), sets, strict=True):
        for sig in jaccard.signatures(s, 80, 100).view(np.int64):
            want.setdefault(int(sig), set()).add(int(node))
    n = sum(map(len, want.values()))
    want = {k: v for k, v in want.items() if len(v) > 1}
    assert max(map(len, want.values())) == 60 and n > 30_000
    for packed in (jaccard.PACKED, 50):
        monkeypatch.setattr(jaccard, "PACKED", packed)
        rows = jaccard._rows(docs, 5, 80, 100)
        if packed > 50:
            assert rows.count() <= 2 * (1 << jaccard.HEAP_BITS) + docs.count() < n / 2
        got, whole = {}, {}
        for r in jaccard._buckets(rows.repartition(3, "heap").sortWithinPartitions("heap"), 20).where("kind = 1").collect():
            got.setdefault(r.bucket, []).extend(r.members)
            assert r.bucket not in whole or not (whole[r.bucket] or r.whole)
            whole[r.bucket] = r.whole
        assert {k: set(v) for k, v in got.items() if len(set(v)) > 1} == want
        assert all(whole[k] == (len(v) <= 20) for k, v in want.items())
    assert len({c.component_id for c in jaccard.jaccard_components(docs, 5, 80, 100, 20).collect()}) == 301
