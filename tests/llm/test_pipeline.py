"""The pipeline end to end: every stage's rows against plain Python on what the stage before kept."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from data import repeats
from test_near_copies import brute

from ecolattice.llm import quality_classifier, quality_rules

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    rows, labels = [], []
    for i in range(500):
        bad = rnd.random() < 0.3
        text = " ".join(rnd.choice(words) + ("***" if bad and rnd.random() < 0.8 else "") for _ in range(rnd.randint(60, 150)))
        if not bad and rnd.random() < 0.2:
            text = text[:100] + " " + passage + " " + text[100:]
        elif not bad and rnd.random() < 0.2 and rows and rows[-1][1]:
            text = rows[-1][1] + " fin"
        rows.append((i, text, "aa", "s", len(text)))
        labels.append((i, int(not bad), 0))
    return [*rows, (900, None, None, None, None), (901, "", "aa", "s", 0), (902, "short", "aa", "s", 5), (None, rows[3][1], "aa", "s", 1)], labels


def test_stages_one_by_one(spark, tmp_path):
    rows, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append([tuple(r) for r in now.collect()])
        assert k == 4 or now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    table = lambda r: spark.createDataFrame(r, SCHEMA)
    good = {r["doc_id"] for r in quality_classifier.score(table(rows), known).where("predicted = 1").collect()}
    assert {r[0] for r in kept[0]} - {None} == good - {None} and set(kept[0]) <= set(rows)
    passed = {r["doc_id"] for r in quality_rules.apply_rules(table(kept[0]), known).where("kept").collect()}
    assert Counter(kept[1]) == Counter(r for r in kept[0] if r[0] in passed)
    of = brute([(r[0], r[1]) for r in kept[1] if r[0] is not None])
    assert Counter(kept[2]) == Counter(r for r in kept[1] if r[0] is None or of[r[0]] == r[0]) and len(kept[2]) < len(kept[1])
    cut = repeats(kept[2], 50, lambda t: (t or "").encode())
    want = Counter((r[0], r[1] if r[0] is None else bytes(c for c, g in zip(*cut[(r[0], r[1])]) if not g).decode("utf-8", "ignore"), *r[2:]) for r in kept[2])
    assert Counter(kept[3]) == want and any(len(a[1]) < len(b[1]) for a, b in zip(sorted(kept[3], key=str), sorted(kept[2], key=str)))
    from ecolattice.llm.queries import vocabulary

    library, pieces = tokenizers.Tokenizer.from_file(vocabulary()), Counter()
    for r in kept[3]:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            pieces[(r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + 2048])))] += 1
    assert Counter(r[:5] for r in kept[4]) == pieces
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in whole) == pieces
    digest = lambda part: hashlib.sha256(repr(sorted(map(str, part))).encode()).hexdigest()
    assert digest(r[:5] for r in whole) == digest(r[:5] for r in kept[4])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
