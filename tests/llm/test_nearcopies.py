import random

import corpus_pipeline
import numpy as np
import pytest

from siltworks.llm import nearcopies


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_near(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 200]))]
        out.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5, 8):
            words = list(base)
            for k in rng.sample(range(len(words)), edits):
                words[k] = f"x{rng.randrange(5000)}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return out + ["", "one two", "One  two", None]


def test_shingles_and_similarity():
    for a, b in [("a b c d e f", "a b c d e f"), ("a b c d e f g h i", "a b c d e f g h j"), ("a b", "A  b"), ("a b", "a c")]:
        got = nearcopies.similar(nearcopies.shingles(a.encode()), nearcopies.shingles(b.encode()))
        assert got == brute_near(brute_shingles(a), brute_shingles(b))
    assert len(nearcopies.shingles(None)) == 0 and len(np.unique(nearcopies.FACTORS)) == len(nearcopies.FACTORS)


@pytest.mark.parametrize("tile", [nearcopies.TILE, 2])
def test_no_two_similar_texts_stay(spark, texts, tile):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in nearcopies.one_of_each(docs, tile=tile).collect()}
    sets = [brute_shingles(t) for t in texts]
    linked = {n: {m for m in range(len(sets)) if m != n and brute_near(sets[n], sets[m])} for n in range(len(sets))}
    assert not any(linked[n] & kept for n in kept)
    assert len(kept) < len(texts) - 40
    for n in range(len(sets)):  # what goes is linked to a smaller id that stays, what stays has none smaller in its group
        group, waiting = {n}, [n]
        while waiting:
            new = linked[waiting.pop()] - group
            group |= new
            waiting += new
        assert group & kept and (len(group) > 1 or n in kept) and min(group) in kept
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0


def test_pipeline_stage_leaves_no_near_copies(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = corpus_pipeline.without_near_copies(spark, docs, at).select("doc_id", "text").collect()
    sets = {r.doc_id: brute_shingles(r.text) for r in rows}
    holders = {}
    for n, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(n)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    assert not [p for p in pairs if brute_near(sets[p[0]], sets[p[1]])]
