"""Operators on documents against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from data import SCHEMA, documents, repeats

from ecolattice.llm import bpe, packing, simhash, substring_dedup, suffix_dedup

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, empty):
    library = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        raw = b"".join(struct.pack("<I", i) for i in ids)
        want[(r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(docs, PATH).collect())) == want
    encoded = bpe.encode(docs, PATH)
    assert Counter((r[0], tuple(r[1])) for r in encoded.collect()) == Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    decoded = Counter(map(tuple, bpe.decode(encoded, PATH).collect()))
    assert decoded == Counter((r[0], library.decode(library.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in ROWS)
    assert bpe.digests(empty, PATH).count() == 0


def test_bpe_every_character():
    library, own = tokenizers.Tokenizer.from_file(PATH), bpe.PairIndexBPE(PATH)
    texts = [f"a{chr(c)}1{chr(c)}{chr(c).upper()} {chr(c)}" for c in range(0x2100) if not 0xD800 <= c < 0xE000] + ["aaaaaaa aaa aaaaa", "İΣς ΑΣ", "日本語 한국어 😀😀"]
    for (k, ids, _), t in zip(own.encode_all(iter(enumerate(texts))), texts, strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(docs, empty):
    library = tokenizers.Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs, PATH).collect()
    want = Counter()
    for r in ROWS:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(r[0], k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack_documents(empty, PATH).count() == 0


def test_packing_finds_a_perfect_packing(spark):
    sizes = [1024, 700, 324, 1500, 500, 48, 2000, 40, 8] * 40
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    assert packing.pack(items, 2048, group=100).select("sequence_id").distinct().count() <= sum(sizes) // 2048 + 2


def test_genetic_steps():
    import random

    lengths = [random.Random(k).randint(1, 60) for k in range(200)]
    one, two = packing.best_fit(lengths, 100), packing.best_fit(lengths, 100, list(range(200)))
    child = packing.crossover(one, two, lengths, 100, random.Random(1))
    assert sorted(i for b in child for i in b) == list(range(200))
    assert all(sum(lengths[i] for i in b) <= 100 for b in child)
    people = packing.evolve(lengths, 100, 1, [two], 4, 5)
    assert packing.fitness(people[0], lengths, 100) >= packing.fitness(two, lengths, 100)


def fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, empty, spark):
    fps = [(r[0], fingerprint(r[1])) for r in ROWS]
    parent = {i: i for i, _ in fps if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, f) for i, f in fps if i is not None]
    for a, f in known:
        for b, g in known:
            if (f ^ g).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    # An id that occurs twice links through the classes of both of its texts only if they are linked.
    got = simhash.near_duplicates(docs).collect()
    of = {f: root(i) for i, f in known}
    twice = {i for i, n in Counter(i for i, _ in known).items() if n > 1}
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{f:016x}") for i, f in fps)
    for r in got:
        f = int(r["fingerprint"], 16)
        if f in of and r["doc_id"] not in twice and not any(root(t) == of[f] for t in twice):
            assert r["component_id"] == of[f]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs).where("doc_id is not null").select("doc_id").distinct().collect()
    assert {r[0] for r in kept} <= {i for i, _ in known} and len(kept) >= len(set(of.values())) - len(twice)


def test_simhash_links_of_two_bits(spark):
    base = 0x0123456789ABCDEF
    fps = [(0, base), (1, base ^ 3), (2, base ^ 3 ^ 12), (3, base ^ (1 << 63) ^ 1), (9, base ^ 0xFF00)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "rep long, fp long"))
    from ecolattice.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0}


def test_components_chain(spark):
    from ecolattice.llm.components import connected_components

    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 99), (98, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 98: 98, 99: 98, 100: 98}


def test_suffix_dedup(docs, empty):
    want = repeats(ROWS, 50, lambda t: (t or "").encode())
    for r in suffix_dedup.remove_repeats(docs).collect():
        assert any(k[0] == r["doc_id"] and len(s) == r["n_bytes"] and bytes(c for c, g in zip(s, gone) if not g) == bytes(r["kept"]) for k, (s, gone) in want.items()), r["doc_id"]
    assert suffix_dedup.remove_repeats(docs).count() == len(ROWS)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)


def test_suffix_dedup_small_window_and_blocks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    want = repeats(ROWS, 20, lambda t: (t or "").encode())
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, 20, 4).collect())
    texts = Counter((r[0], r[1]) for r in ROWS)
    assert got == Counter({k: v for k, v in Counter(x for (i, t), n in texts.items() for x in [(i, len(want[(i, t)][0]), bytes(c for c, g in zip(*want[(i, t)]) if not g))] * n).items()})


def test_substring_dedup(docs, empty):
    want = repeats(ROWS, 13, lambda t: (t or "").encode().split())
    texts = Counter((r[0], r[1]) for r in ROWS)
    expected = Counter()
    for (i, t), n in texts.items():
        s, gone = want[(i, t)]
        expected[(i, len(s), b" ".join(w for w, g in zip(s, gone) if not g).decode())] += n
    got = substring_dedup.remove_repeats(docs)
    assert Counter((r["doc_id"], r["n_words"], r["kept"]) for r in got.collect()) == expected
    assert all(s["end"] - s["begin"] >= 13 for r in got.collect() for s in r["spans"])
    assert substring_dedup.remove_repeats(empty).count() == 0


def thue_morse(n, a, b):
    text = a
    for _ in range(n):
        text += text.translate(str.maketrans(a + b, b + a))
    return text


def test_words_of_equal_code_are_told_apart(spark):
    # The polynomial code of these two words of 1,024 characters is the same in 64 bits.
    one, two = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    words = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, two])), (3, " ".join([*words, two, "end"])), (4, " ".join([*words, one]))]
    got = {r["doc_id"]: sum(s["end"] - s["begin"] for s in r["spans"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13, 4: 13}
    long = [(1, one * 3 + "x"), (2, two * 3 + "x"), (3, two * 3 + "x")]
    want = repeats(long, 50, lambda t: t.encode())
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(long, "doc_id long, text string")).collect():
        assert bytes(r["kept"]) == bytes(c for c, g in zip(*want[(r["doc_id"], long[r["doc_id"] - 1][1])]) if not g)


def test_equal_pieces():
    import numpy as np

    from ecolattice.llm.anchors import first_equal

    data = np.frombuffer(b"abcabdabcabdxabc", np.uint8)
    begin, size = np.array([0, 3, 6, 9, 12, 13, 0]), np.array([3, 3, 3, 3, 1, 3, 0])
    assert first_equal(np.zeros(7, np.int64), data, begin, size).tolist() == [0, 1, 0, 1, 4, 0, 6]


def gone_spans(gone):
    edges = [a != b for a, b in zip([False, *gone], [*gone, False])]
    return sum(edges) // 2


def test_registered_dedup_queries(spark, tmp_path):
    """op3 and op7 as registered: every column, against all windows by brute force."""
    from ecolattice.llm import queries

    seen = set()
    rows = [r for r in ROWS if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = set()
    for (i, _), (s, gone) in repeats(rows, 50, lambda t: (t or "").encode()).items():
        want.add((i, len(s), sum(gone), gone_spans(gone), sha(bytes(c for c, g in zip(s, gone) if not g))))
    assert {tuple(r) for r in queries.op3_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want
    want = set()
    for (i, _), (s, gone) in repeats(rows, 13, lambda t: (t or "").encode().split()).items():
        want.add((i, len(s), sum(gone), sha(b" ".join(w for w, g in zip(s, gone) if not g))))
    assert {tuple(r) for r in queries.op7_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == want


def test_passage_in_all_documents(spark, monkeypatch):
    """A line that repeats in every document, in chunks of few documents: equal runs travel once, and all but the first go."""
    from ecolattice.llm import anchors

    monkeypatch.setattr(anchors, "CHUNK", 4000)
    line = "the very same line of words stands here again and again for all to read it once more"
    rows = [(i, "\n".join([f"head {i} {i * 7}"] + [line] * (i % 5 + 1) + [f"tail {i * 11}"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for mod, window, split in ((suffix_dedup, 50, lambda t: t.encode()), (substring_dedup, 13, lambda t: t.encode().split())):
        want = repeats(rows, window, split)
        for r in mod.remove_repeats(frame).collect():
            _, gone = want[(r["doc_id"], rows[r["doc_id"]][1])]
            assert sum(s["end"] - s["begin"] for s in r["spans"]) == sum(gone) and len(r["spans"]) == gone_spans(gone)


def test_without_repeats_cuts_the_text(docs):
    seen = set()
    rows = [r for r in ROWS if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    want = repeats(rows, 50, lambda t: (t or "").encode())
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs.sparkSession.createDataFrame([*rows, (None, rows[5][1], *rows[5][2:])], SCHEMA)).collect()}
    for r in rows:
        s, gone = want[(r[0], r[1])]
        kept = None if r[1] is None else bytes(c for c, g in zip(s, gone) if not g).decode("utf-8", "ignore")
        assert tuple(got[r[0]]) == (r[0], kept, *r[2:])
    assert got[None]["text"] == rows[5][1]


def test_long_text_in_segments(spark, monkeypatch):
    from ecolattice.llm import anchors

    monkeypatch.setattr(anchors, "CHUNK", 700)
    rows = [r for r in ROWS if r[0] is not None]
    data = suffix_dedup.ByteSymbols().segments(("ab" * 900).encode(), 50, 700)
    assert [(b, len(p)) for b, p in data] == [(0, 749), (700, 749), (1400, 400)]
    words = ("w1 w2 w3 " * 300).encode()
    parts = list(substring_dedup.WordSymbols().segments(words, 13, 700))
    assert parts[0][0] == 0 and all(words.split()[b : b + len(p.split())] == p.split() for b, p in parts)
    assert rows
