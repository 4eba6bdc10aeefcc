"""The near-duplicate stage of the pipeline against all pairs by brute force."""

import os
import random
import sys

import pytest
from data import SCHEMA, documents

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from ecolattice.llm import near_copies

SIMPLE = "doc_id long, text string"


def sets(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """The smallest id that pairs of similarity 0.8 or more lead to, for each id."""
    data = [(i, sets(t)) for i, t in rows]
    parent = {i: i for i, _ in data}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(data):
        for j, b in data[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in data}


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    shared = " ".join(rnd.choice(words) for _ in range(30))
    texts = ["", " ", "one two", "one two"]
    for n in (20, 60, 200, 500):
        for _ in range(8):
            base = [rnd.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.02, 0.04, 0.1):
                copy = list(base)
                for k in rnd.sample(range(n), max(1, int(n * share))):
                    copy[k] = rnd.choice(words)
                texts.append(" ".join(copy))
            texts.append(shared + " " + " ".join(rnd.choice(words) for _ in range(n)))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("frequent", [5, 2])
def test_stage_finds_every_similar_pair(spark, monkeypatch, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    rows = corpus()
    want = brute(rows)
    assert len(rows) - len(set(want.values())) > 20
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SIMPLE), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_awkward_rows(spark):
    seen = {}
    rows = [r for r in documents() if r[0] is not None and seen.setdefault(r[0], r) is r]
    want = brute([(r[0], r[1]) for r in rows])
    null = (None, rows[0][1], *rows[0][2:])
    kept = near_copies.keep_one(spark.createDataFrame([*rows, null, null], SCHEMA)).collect()
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == set(want.values())
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simhash_balls_come_first_and_files_go(spark, monkeypatch):
    rows, seen = corpus(), []
    links, verified = near_copies.simhash.links, near_copies._verified
    monkeypatch.setattr(near_copies.simhash, "links", lambda fps, **o: seen.append("balls") or links(fps, **o))
    monkeypatch.setattr(near_copies, "_verified", lambda *a: seen.append("verified") or verified(*a))
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    want = brute(rows)
    found = near_copies.near_copies(spark.createDataFrame(rows, SIMPLE)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want and seen[:2] == ["balls", "verified"]
    left = {f.split("-")[0] for f in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before}
    assert not left & {"prefixes", "shared", "shingles"}


def test_long_texts_that_share_a_shingle_only_are_never_held_against_each_other(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    shared = "five words that all share"
    bases = [[rnd.choice(words) for _ in range(1500)] for _ in range(12)]
    rows = list(enumerate(" ".join([shared, *b]) for b in bases))
    for share in (0.005, 0.015):
        for b in bases:
            copy = list(b)
            for k in rnd.sample(range(len(b)), int(len(b) * share)):
                copy[k] = rnd.choice(words)
            rows.append((len(rows), " ".join([shared, *copy])))
    held = []
    similar = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, *a: held.append(pairs.count()) or similar(pairs, *a))
    found = near_copies.near_copies(spark.createDataFrame(rows, SIMPLE)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows)
    # Twelve groups of three have 36 pairs; all 630 pairs share a shingle.
    assert sum(held) <= 36
    a, b = near_copies.shingles(rows[0][1]), near_copies.shingles(rows[1][1])
    exact = len(set(a.tolist()) ^ set(b.tolist()))
    assert (len(a) + len(b)) / 9 < near_copies._wide_differ(near_copies._wide(a), near_copies._wide(b)) <= exact
    longer = near_copies.shingles(rows[0][1] + " " + rows[1][1])
    assert near_copies._wide_differ(near_copies._wide(a), near_copies._wide(longer)) <= len(set(a.tolist()) ^ set(longer.tolist()))
