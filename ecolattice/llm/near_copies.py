"""Near-duplicate documents: word shingles with a Jaccard similarity of 0.8 or more, all of them.

The near-duplicate stage's form of simhash.py. A SimHash of 64 bits tells such
pairs apart from others only by a radius that no ball of variants can cover (at
0.8 about ten bits differ), so candidates come from a prefix filter, which
misses none: with every document's shingles in one common order, two sets of
that similarity share one of their first n - ceil(0.8 n) + 1 shingles. Shingles
that a sample finds frequent come last in the order; that saves candidates and
never loses any. A fingerprint of 256 bits, each the parity of the shingles
that fall on it, differs in no more bits than the sets in shingles; so pairs
whose fingerprints differ in too many bits are left out without loss. Large
sets have a second one with a bit for each shingle at least, since 256 bits
tell nothing there. What is left is held against each other by the exact sets;
texts travel compressed, and first one pair of each set only: most others are
of one component then.

Most near copies differ little, so SimHash with ball hashing (simhash.py) comes
first: sets whose 64-bit fingerprints differ in two bits at most are held
against each other, and the similar ones are of one component. What is left
goes through the prefix filter. Sets that share a shingle first meet one of
them, round by round another one, and are of one component if they are
similar. A pair within a component is never looked at again. Only when that no
longer joins much, the pairs between components are listed, those whose
fingerprints allow it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .common import Rounds, broadcast_if, id_text, release, saved, small_batches, word_blocks
from .components import connected_components

#: Words of a shingle; the least similarity is ALIKE[0] / ALIKE[1].
WIDTH, ALIKE = 5, (4, 5)
#: Documents of the sample that settles the order, how often a shingle is in it to come late, and shingles known to be frequent.
SAMPLE, FREQUENT, KNOWN = 5_000, 4, 200_000
#: Sets up to which their sizes and fingerprints (48 bytes each) are broadcast.
SMALL = 300_000
#: Columns of a set's fingerprint, and pairs for each row under which pairs are listed without another round.
BITS, FEW = ("b0", "b1", "b2", "b3"), 2
#: Shingles of a set by which a pair is known to be listed elsewhere, and sets up to this size that need no second fingerprint.
LEAST, NARROW = 8, 256


def shingles(text: str | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The sorted different hashes of a text's word shingles; a shorter text is one shingle, one without a word none."""
    from xxhash import xxh64_intdigest

    parts, tail, short = [], [], []
    for block in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + block
        tail = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            short = words
            continue
        grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
        parts.append(np.unique(np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, len(words) - width + 1)))
    if parts:
        return np.unique(np.concatenate(parts))
    return np.array([xxh64_intdigest(b" ".join(short), seed)] if short else [], np.uint64)


def _name(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), 1)).astype(np.int64)) if len(hashes) else 0


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four integers: whether an odd number of the hashes ends in each of 256 ways."""
    return np.packbits((np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _wide(hashes: np.ndarray) -> bytes | None:
    """The parities of a set over NARROW shingles in as many ways as the next power of two; None of others."""
    n = len(hashes)
    if n <= NARROW:
        return None
    bits = 1 << (n - 1).bit_length()
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _wide_differ(x: bytes, y: bytes) -> int:
    """In how many bits two such fingerprints differ, by the shorter one's ways (halves of the longer one are folded)."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _least(n, whole):
    """ceil(n * similarity), by the integer division `whole`."""
    return whole(n * ALIKE[0] + ALIKE[1] - 1, ALIKE[1])


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, times) of the shingles that are frequent in a sample of the documents."""

    def run(batches):
        for b in batches:
            for text in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], ["s"])

    share = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    rows = some.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(KNOWN).toPandas()
    names = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], rows["count"].to_numpy(np.int64)[order]


def _prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, node (name of the shingle set), n (its size), prefix (the shingles that the filter needs), BITS and wide (its fingerprints) and fp (its SimHash) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def run(batches):
        names, times = shared.value
        for b in batches:
            nodes, sizes, prefixes, bits, fps, wides = [], [], [], [], [], []
            for text in b.column(1):
                h = shingles(text.as_py())
                n = len(h)
                rank = np.zeros(n, np.int64)
                if len(names) and n:
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    rank = np.where(names[at] == h, times[at], 0)
                nodes.append(_name(h))
                sizes.append(n)
                bits.append(_sketch(h))
                fps.append(simhash.majority(simhash.ones(h), n))
                wides.append(_wide(h))
                prefixes.append(h[np.lexsort((h, rank))][: n - _least(n, int.__floordiv__) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), *[pa.array([b[k] for b in bits], pa.int64()) for k in range(4)], pa.array(fps, pa.int64()), pa.array(wides, pa.binary())], ["doc_id", "node", "n", "prefix", *BITS, "fp", "wide"])

    return docs.mapInArrow(run, "doc_id long, node long, n long, prefix array<long>, " + ", ".join(f"{b} long" for b in (*BITS, "fp")) + ", wide binary")


def _alike(u: str, v: str) -> Column:
    """Whether sizes and fingerprints (columns of the structs u and v) allow the similarity."""
    a, b = ALIKE
    differ = sum((F.bit_count(F.col(f"{u}.{k}").bitwiseXOR(F.col(f"{v}.{k}"))) for k in BITS), F.lit(0))
    n, m = F.col(f"{u}.n"), F.col(f"{v}.n")
    return (F.least(n, m) * b >= F.greatest(n, m) * a) & (differ * (a + b) <= (n + m) * (b - a))


def _allowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and fingerprints allow the similarity."""
    mark = broadcast_if(sets.select("node", F.struct("n", *BITS).alias("mark")), SMALL)
    of = lambda end, name: mark.select(F.col("node").alias(end), F.col("mark").alias(name))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").where(_alike("a", "b")).select("u", "v")


def _balls(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets with one SimHash, or with SimHashes in one ball of ball hashing; they join what all such pairs join."""
    reps = sets.groupBy("fp").agg(F.min("node").alias("rep"))
    same = sets.select("node", "fp").join(reps, "fp").where("rep < node").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    return simhash.links(reps).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(same)


def _sharp(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose second fingerprints, where both have one, allow the similarity."""
    mark = sets.where("wide is not null").select("node", F.struct("n", "wide").alias("mark"))
    of = lambda end, name: mark.select(F.col("node").alias(end), F.col("mark").alias(name))

    def check(batches):
        a, b = ALIKE
        for batch in batches:
            n, m, x, y = ([v.as_py() for v in column] for column in batch.columns[2:])
            keep = [p is None or q is None or _wide_differ(p, q) * (a + b) <= (i + j) * (b - a) for i, j, p, q in zip(n, m, x, y)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(of("u", "a"), "u", "left").join(of("v", "b"), "v", "left")
    return both.select("u", "v", "a.n", F.col("b.n").alias("m"), "a.wide", F.col("b.wide").alias("other")).mapInArrow(check, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose shingle sets are similar indeed, except some that the others join anyway."""
    pairs = saved(_sharp(pairs, sets).distinct())
    release(docs.sparkSession)
    one = saved(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    links = _similar(one, docs, reps)
    classes = broadcast_if(saved(connected_components(links)), 1_000_000)
    of = lambda end, name: classes.select(F.col("node").alias(end), F.col("component").alias(name))
    rest = pairs.join(one, ["u", "v"], "left_anti").join(of("u", "c"), "u", "left").join(of("v", "d"), "v", "left")
    rest = saved(rest.where(F.coalesce("c", "u") != F.coalesce("d", "v")).select("u", "v"))
    return links if rest.isEmpty() else links.unionByName(_similar(rest, docs, reps))


def _similar(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The (checkpointed) pairs (u, v) whose shingle sets are similar indeed."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    # Ids are eight bytes each; up to a million of them are broadcast, so the texts stay where they are.
    ids = broadcast_if(saved(ends.join(reps, "node").select(F.col("rep").alias("doc_id")).distinct()), 1_000_000)

    def texts(batches):
        for b in batches:
            found = [t.as_py() or "" for t in b.column(1)]
            packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([_name(shingles(t)) for t in found], pa.int64()), pa.array(packed, pa.binary())], ["node", "z"])

    def check(batches):
        held: dict[int, np.ndarray] = {}

        def hashes(node, z):
            if node not in held:
                if len(held) >= 16:
                    held.clear()
                held[node] = shingles(zlib.decompress(z.as_buffer()).decode("utf-8", "surrogatepass"))
            return held[node]

        for b in batches:
            keep = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                h, g = hashes(u, x), hashes(v, y)
                both = len(np.intersect1d(h, g, assume_unique=True))
                keep.append(both * ALIKE[1] >= (len(h) + len(g) - both) * ALIKE[0])
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    release(docs.sparkSession)
    files = Rounds(docs.sparkSession, "shingles")
    known = files(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(texts, "node long, z binary"))
    both = pairs.join(known.select(F.col("node").alias("u"), F.col("z").alias("zu")), "u").join(known.select(F.col("node").alias("v"), F.col("z").alias("zv")), "v")
    found = saved(both.select("u", "v", "zu", "zv").mapInArrow(check, "u long, v long").distinct())
    files.drop()
    release(docs.sparkSession)
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id that similar pairs lead to) of every row with an id.

    Texts without a word are copies of each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = id_text(docs, id_col, text_col).where("doc_id is not null")
    # Files, unlike checkpoints, are packed and read by column, and those of a round go with the next.
    files, kept, marks, here = Rounds(spark, "prefixes"), Rounds(spark, "shared"), Rounds(spark, "sets"), Window.partitionBy("s")
    whole = files(_prefixes(docs))
    each = saved(whole.select("doc_id", "node"))
    reps = each.groupBy("node").agg(F.min("doc_id").alias("rep"))
    sets = marks(whole.select("node", "n", *BITS, "fp", "wide", F.slice(F.sort_array("prefix"), 1, LEAST).alias("least")).dropDuplicates(["node"]))
    release(spark)
    shared = whole.select("node", "prefix").dropDuplicates(["node"]).select("node", F.explode("prefix").alias("s"))
    met = kept(shared.withColumn("low", F.min("node").over(here)).withColumn("high", F.max("node").over(here)).where("low < high").select("s", "node"))
    files.drop()
    release(spark)
    links = _verified(_allowed(_balls(sets), sets).distinct(), sets, docs, reps)
    turn, before = 0, None
    while True:
        # Rows are a shingle and a set; sizes and fingerprints join the pairs only. Up to a million classes (16 bytes each) are broadcast.
        classes = broadcast_if(saved(connected_components(links)), 1_000_000)
        met = met.join(classes, "node", "left").select("s", "node", F.coalesce("component", "node").alias("c"))
        # Only shingles that different components share go on.
        met = kept(met.withColumn("low", F.min("c").over(here)).withColumn("high", F.max("c").over(here)).where("low < high").select("s", "node", "c"))
        release(spark)
        groups = met.groupBy("s").count().agg(F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("count")).alias("pairs")).first()
        if not groups["rows"]:
            break
        if groups["pairs"] <= FEW * groups["rows"]:
            other = met.select("s", F.col("node").alias("v"), F.col("c").alias("d"))
            pairs = met.withColumnRenamed("node", "u").join(other, "s").where("u < v and c <> d").select("u", "v")
            links = links.unionByName(_verified(_allowed(pairs.distinct(), sets), sets, docs, reps))
            break
        if before is not None and groups["rows"] > 0.7 * before:
            # A pair is listed at the least shingle that both have among their LEAST least ones; at all they share only if there is none.
            own = met.join(sets.select("node", F.struct("node", "n", *BITS).alias("u"), "least"), "node").select("s", "u", "c", "least")
            left, right = own, own.select("s", F.col("u").alias("v"), F.col("c").alias("d"), F.col("least").alias("other"))
            once = F.coalesce(F.array_min(F.array_intersect("least", "other")) >= F.col("s"), F.lit(True))
            pairs = left.join(right, "s").where((F.col("u.node") < F.col("v.node")) & (F.col("c") != F.col("d")) & _alike("u", "v") & once)
            links = links.unionByName(_verified(pairs.select(F.col("u.node").alias("u"), F.col("v.node").alias("v")).distinct(), sets, docs, reps))
            break
        # One set of each shingle, settled by a hash, meets all others there, and leaves.
        order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("v"), F.col("c").alias("d"))
        chosen = met.withColumn("one", F.min(order).over(here))
        pairs = chosen.where("c <> one.d").select(F.least("node", "one.v").alias("u"), F.greatest("node", "one.v").alias("v")).distinct()
        links = links.unionByName(_verified(_allowed(pairs, sets), sets, docs, reps))
        met = chosen.where("node <> one.v").select("s", "node")
        before, turn = groups["rows"], turn + 1
    kept.drop()
    marks.drop()
    of = each.select("doc_id", "node").join(connected_components(links), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "component").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose doc_id names their component; null ids stay, and all rows that repeat a doc_id that stays."""
    gone = broadcast_if(saved(near_copies(docs, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()), 1_000_000)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
