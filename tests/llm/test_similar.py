"""The pipeline's near-duplicate stage against brute force over shingle sets."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from commitlake.llm import similar

WORDS = [f"w{i}" for i in range(3000)]


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_kept(rows):
    """The smallest doc_id of each component, null ids last."""
    sets, label = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or (x and sets[j] and len(x & sets[j]) / len(x | sets[j]) >= 0.8):
                label[root(i)] = root(j)
    parts = {}
    for i, (doc, _) in enumerate(rows):
        parts.setdefault(root(i), []).append(doc)
    return sorted(min(p, key=lambda d: (d is None, d or 0)) or -1 for p in parts.values())


def changed(rng, words, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in words)


def sample():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, "one two three")]
    for _ in range(25):
        words = rng.choices(WORDS, k=rng.randrange(100, 400))
        rows += [(len(rows) + 1, changed(rng, words, share)) for share in (0, 0.005, 0.01, 0.02, 0.05)]
    family = rng.choices(WORDS, k=300)
    rows += [(1000 + i, changed(rng, family, 0.015)) for i in range(40)]
    return rows


@pytest.mark.parametrize("pair_list", [0, 4, 48])
def test_similar_dedup(spark, pair_list):
    rows = sample()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, label string")
    out = similar.similar_dedup(df, pair_list=pair_list)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == brute_kept(rows)


def test_stage_drops_near_copies(spark):
    """Copies of similarity >= 0.8 differ in more than three SimHash bits more often than not."""
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, df, "")
    assert sorted(r["doc_id"] for r in out.collect()) == brute_kept(rows)
    assert similar.similar_dedup(df.limit(0)).count() == 0
