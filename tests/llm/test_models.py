"""Classifiers, rules and nearest neighbours against held-out labels or brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from data import SCHEMA, documents

from ecolattice.llm import language_id, nn_descent, quality_classifier, quality_rules, url_filter

ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def prose(spark):
    """Good and bad texts in two made-up languages, with labels."""
    rnd = random.Random(1)
    tongues = {"aa": "abcdefg", "zz": "tuvwxyz"}
    rows, labels = [], []
    for i in range(1500):
        lang = rnd.choice(list(tongues))
        words = ["".join(rnd.choice(tongues[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(60, 120))]
        bad = rnd.random() < 0.3
        text = " ".join(w + "###" if bad and rnd.random() < 0.8 else w for w in words)
        rows.append((i, text, lang))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), dict((i, q) for i, q, _ in labels), {r[0]: r[2] for r in rows}


def test_quality_classifier(prose, docs, spark):
    texts, labels, quality, _ = prose
    got = quality_classifier.score(texts, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert 300 < len(held) < 700 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) / len(held) > 0.97
    assert quality_classifier.keep_good(texts, labels).count() == sum(r["predicted"] for r in got)
    odd = quality_classifier.score(docs, labels.where("false")).collect()
    assert len(odd) == len(ROWS) and {r["score"] for r in odd} == {0.5}
    assert quality_classifier.score(docs.where("false"), labels).count() == 0


def test_compiled_rules_agree_with_numpy(prose):
    texts, labels, _, _ = prose
    stats = quality_classifier.statistics(texts)
    model = quality_classifier.train(stats, labels)
    rows = stats.withColumn("p", model.column()).toPandas()
    assert np.allclose(rows["p"], model.predict(rows[list(quality_classifier.STATISTICS)].to_numpy(float)))


def base(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    tri = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_quality_rules(docs, prose):
    texts, labels, quality, _ = prose
    got = quality_rules.apply_rules(docs, labels).collect()
    want = Counter()
    for r in ROWS:
        b = base(r[1])
        want[(r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    rows = quality_rules.apply_rules(texts, labels, risk=0.05).collect()
    good = [r for r in rows if quality[r["doc_id"]] and not r["base_failed"]]
    bad = [r for r in rows if not quality[r["doc_id"]]]
    assert sum(not r["kept"] for r in good) <= 0.05 * len(good) and sum(not r["kept"] for r in bad) > 0.9 * len(bad)
    assert quality_rules.apply_rules(docs.where("false"), labels).count() == 0
    assert quality_rules.apply_rules(docs, labels.where("false")).count() == len(ROWS)


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(0, 300, 0.01), (3, 300, 0.01), (10, 2000, 0.01), (0, 0, 0.05), (50, 40000, 0.01)]
    for k, n, p in cases:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def against_sql(docs, frame, folder):
    duckdb = pytest.importorskip("duckdb")
    docs.write.parquet(str(folder / "d"))
    frame.write.parquet(str(folder / "l"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/d/*.parquet'")
    con.execute(f"create view labels as select * from '{folder}/l/*.parquet'")
    assert Counter(con.execute(quality_rules.oracle()).fetchall()) == Counter(map(tuple, quality_rules.apply_rules(docs, frame).collect()))


def test_rules_against_their_sql(spark, docs, tmp_path):
    labels = [(r[0], (r[0] * 7) % 2, 0) for r in ROWS if r[0] is not None][:90]
    against_sql(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path)


def counted(rnd, n, bad_share):
    """Counts and labels of a stratum whose good documents have a few symbols and repeats by chance."""
    rows, labels = [], []
    for i in range(n):
        bad = rnd.random() < bad_share
        symbols = rnd.randint(30, 200) if bad and rnd.random() < 0.7 else rnd.choice([0] * 60 + [20])
        repeats = rnd.randint(30, 49) if bad and rnd.random() < 0.5 else rnd.choice([0] * 60 + [12])
        rows.append((i, "aa", 100, 500, symbols, 0, repeats, False))
        labels.append((i, int(not bad)))
    return rows, labels


COUNTS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def test_risk_holds_for_all_rules_together(spark):
    """Cutoffs from many small holdouts, each judged on the true share of good documents that its setting rejects."""
    risk, delta, trials = 0.03, 0.2, 40
    rows, labels = [], []
    for t in range(trials):
        r, y = counted(random.Random(t), 900, 0.25)
        rows += [(1000 * t + i, f"s{t}", *x) for i, _, *x in r]
        labels += [(1000 * t + i, q) for i, q in y]
    frame, known = spark.createDataFrame(rows, COUNTS).cache(), spark.createDataFrame(labels, "doc_id long, quality int").cache()
    # Each trial on its own would be a calibration at delta; together they share it, so fewer violations still are due.
    cutoffs = {r["stratum"]: r for r in quality_rules.calibrate(frame, known, risk=risk, delta=delta * trials).collect()}
    assert len(cutoffs) > trials // 2
    worse = 0
    for c in cutoffs.values():
        symbols = 1 / 61 if c["symbols"] is not None and c["symbols"] < 20 else 0
        repeats = 1 / 61 if c["repeats"] is not None and c["repeats"] < 12 else 0
        worse += 1 - (1 - symbols) * (1 - repeats) > risk
    assert worse <= delta * trials


def test_rules_with_settings_against_their_sql(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(4000):
        bad = rnd.random() < 0.3
        text = " ".join(rnd.choice(words) for _ in range(60))
        if bad and rnd.random() < 0.7:
            text = " ".join("#" + w for w in text.split())
        if bad and rnd.random() < 0.5:
            text += " " + " ".join(text.split()[:20])
        rows.append((i, text, rnd.choice(["aa", "bb"])))
        labels.append((i, int(not bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    cut = quality_rules.calibrate(quality_rules.saved(quality_rules.base_counts(docs)), known).collect()
    assert {r["stratum"] for r in cut} == {"aa", "bb"} and any(sum(x is not None for x in r) >= 3 for r in cut)
    against_sql(docs, known, tmp_path)


def test_stages_judge_row_by_row(prose, spark):
    """Rows with a null or repeated id go or stay by their own text; all columns stay."""
    texts, labels, quality, _ = prose
    rows = [(*r, f"x{k}", k) for k, r in enumerate(map(tuple, texts.collect()))]
    good, bad = next(r for r in rows if quality[r[0]]), next(r for r in rows if not quality[r[0]])
    odd = [(None, good[1], "aa", "o", 1), (None, bad[1], "aa", "o", 2), (good[0], bad[1], "aa", "o", 3), (bad[0], good[1], "aa", "o", 4), (7, None, None, "o", 5)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, t string, n_words long")
    kept = quality_classifier.keep_good(frame, labels)
    assert kept.columns == frame.columns
    assert {r["n_words"] for r in kept.where("t = 'o'").collect()} - {5} == {1, 4}
    passed = quality_rules.keep_passing(frame, labels)
    assert passed.columns == frame.columns and {r["n_words"] for r in passed.where("t = 'o' and n_words < 5").collect()} >= {1, 4}
    assert passed.where("text is null").count() == 0
    want = Counter((r["doc_id"], r["kept"]) for r in quality_rules.apply_rules(frame, labels).collect())
    assert Counter(r["doc_id"] for r in passed.collect()) == Counter({i: n for (i, k), n in want.items() if k})
    for stage in (quality_classifier.keep_good, quality_rules.keep_passing):
        assert stage(frame.where("false"), labels).count() == 0 and stage(frame, labels.where("false")).columns == frame.columns


def test_classifier_statistics(docs):
    """The statistics recomputed in plain Python."""
    import unicodedata

    def stats(text):
        t = text or ""
        n, words, lines = max(1, len(t)), [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n")
        share = lambda chars: sum(c in chars for c in t)
        spaces, w = share(" \t\n\x0b\x0c\r"), max(1, len(words))
        stops = len(re.findall(r"[.!?](?=[\x20\x09-\x0D]|$(?![\s\S]))", t))
        return (len(t), len(words), (len(t) - spaces) / w, sum(unicodedata.category(c) == "Lu" for c in t) / n, share("0123456789") / n, share("#*$%&|<>_=~^{}[]\\") / n, share("!?") / n, share(".,;:") / n, spaces / n, len(t) / len(lines), len(set(words)) / w, len(set(lines)) / len(lines), stops / w)

    got = sorted(((r[0] is None, r[0] or 0, *[round(float(x), 9) for x in r[1:]]) for r in quality_classifier.statistics(docs).select("doc_id", *quality_classifier.STATISTICS).collect()))
    assert got == sorted((r[0] is None, r[0] or 0, *[round(float(x), 9) for x in stats(r[1])]) for r in ROWS)


def test_urls(spark):
    urls = ["https://Spam.NET/x", "http://a.example.net/en/1", "http://example.com/de/2?q", "https://blog.org/fr/", "no url", None, "x://", "http://net", "https://evilnet/x", "a://b?c#d", "HTTP://EXAMPLE.com:80/DE/", "http://é.É/p#?", "", "http://a.net/en/"]
    rnd = random.Random(2)
    urls += [f"http://h{k}.{rnd.choice(['net', 'org', 'com'])}/{rnd.choice(['fr', 'en'])}/{k}" for k in range(300)]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(None, urls[0], None, None)], "page_id long, url string, host string, path string")

    def split(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return "".join(c.lower() if c.isascii() else c for c in host), path

    for r in url_filter.judge(pages).collect():
        u = None if r["page_id"] is None else urls[r["page_id"]]
        u = urls[0] if r["page_id"] is None else u
        host, path = split(u)
        fits = [(len(h + p), kind, h + p) for kind, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        if fits:
            assert (r["rule"], r["verdict"]) == (max(fits)[2], max(fits)[1])
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.where("false")).count() == 0


def test_language(prose, docs):
    texts, _, _, lang = prose
    got = language_id.identify(texts).collect()
    held = [r for r in got if r["held_out"]]
    assert 200 < len(held) < 400 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    odd = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    blank = {r[0] for r in ROWS if r[1] is None or not re.search(r"[^\W\d_]", r[1])}
    assert all((p == "und") == (s == 0) for _, p, s in odd) and {i for i, p, _ in odd if p == "und"} == blank
    assert language_id.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.drop("lang")).collect()} == {"und"}


def test_gradients():
    rnd = np.random.default_rng(0)
    net = language_id.ByteCNN.fresh(["a", "b", "c"])
    for p in net.parameters():
        p += rnd.normal(0, 0.1, p.shape).astype(np.float32)
    x, y = rnd.integers(1, 255, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, eps = p[at], 1e-2
        p[at] = keep + eps
        up = net.gradients(x, y)[0]
        p[at] = keep - eps
        down = net.gradients(x, y)[0]
        p[at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.15, abs=1e-3)


def test_nearest_neighbours(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] + [1.0] * 7, 0), (1060, [None] + [1.0] * 7, 0), (1080, [float("inf")] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (20, rows[20][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got: dict = {}
    for r in nn_descent.neighbours(vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        order = sorted((k for k in range(400) if k != q), key=lambda k: (-s[k], k))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(sc == pytest.approx(s[v], rel=1e-12) for _, v, sc in found)
        assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
        hits += len(set(order) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.99
    few = nn_descent.neighbours(vectors.where("vec_id < 5 and vec_id is not null")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, k) for k in range(1, 5)]
    assert nn_descent.neighbours(vectors.where("false")).count() == 0
    assert nn_descent.neighbours(vectors.where("vec_id = 0")).count() == 0
