"""Near copies of the pipeline's stage against brute force."""

import numpy as np
import pytest

from graincart.llm import jaccard, pipeline, simhash


def planted():
    """(doc_id, text): originals, copies with one to four words changed, and texts that share a long passage only."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    common = [str(w) for w in rng.choice(words, 60)]
    for _ in range(25):
        base = [str(w) for w in rng.choice(words, int(rng.integers(3, 200)))]
        texts += [base, common + base]
        for _ in range(4):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(1, 5))):
                copy[at] = str(rng.choice(words))
            texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def shingles(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def smallest_of_groups(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if 5 * len(x & y) >= 4 * len(x | y):
                first, second = sorted((root(a), root(b)))
                parent[second] = first
    return {root(k) for k in range(len(rows))}


@pytest.mark.parametrize("block", [1024, 3])
def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = planted()
    want = smallest_of_groups(rows)
    assert len(want) < len(rows) - 20
    kept = pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_stage_links_by_simhash(spark):
    """Repeats count in fingerprints only: these differ in no bit, but share few of their distinct shingles."""
    tails = [" ".join(f"{side}{i}" for i in range(30)) for side in "xy"]
    rows = [(3, "so it goes " * 200 + tails[0]), (5, "so it goes " * 200 + tails[1]), (7, tails[0]), (8, tails[1] + " end")]
    assert 5 * len(shingles(rows[0][1]) & shingles(rows[1][1])) < len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert len(set(simhash.fingerprints_of([t for _, t in rows[:2]]).tolist())) == 1
    kept = pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
