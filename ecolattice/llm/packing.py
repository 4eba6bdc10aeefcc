"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are cut into pieces of at most `capacity` tokens. Whole-capacity
pieces are sequences of their own. The others are dealt to groups of bounded
size; for every group several islands, each a task's work, evolve packings: a
crossover injects whole well-filled bins of one parent into the other, removes
the duplicates together with the bins they lay in, and best-fits the documents
that this displaced. Elites migrate between a group's islands through a
shuffle. What the winners leave in poorly filled bins meets the leftovers of
other groups in further rounds.

A group never holds more than a few thousand (id, length) pairs, so memory is
bounded, and no text or token leaves the task that encoded it.
"""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import loaded, rows_of
from .common import id_text, saved, small_batches

CAPACITY = 2048
#: Pieces in a group (average), islands for each group, individuals on an island, epochs (a migration ends each).
GROUP, ISLANDS, POPULATION, EPOCHS = 3000, 2, 4, 2
#: Generations without a better packing after which an island's epoch ends; there may be any number before.
GENERATIONS = 10


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and uid of every piece; a document is its ids and then `end_id`.

    Null and empty texts are the end id alone. uid numbers the pieces (any distinct numbers).
    """
    small_batches(docs.sparkSession)

    def run(batches):
        out = []
        for key, ids, _ in loaded(path).encode_all(rows_of(batches)):
            data = np.append(ids, end_id).astype("<u4")
            for k, start in enumerate(range(0, len(data), capacity)):
                part = data[start : start + capacity]
                out.append((key, k, start, len(part), zlib.crc32(part.tobytes())))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=names).pipe(batch)
                out.clear()
        if out:
            yield pd.DataFrame(out, columns=names).pipe(batch)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def batch(rows: pd.DataFrame) -> pa.RecordBatch:
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        return pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)

    found = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return found.withColumn("uid", F.monotonically_increasing_id())


class _Fit:
    """Open bins by free space: the fullest bin that takes a piece is found by bisection over the spaces in use."""

    def __init__(self, capacity: int, bins: list[list[int]], size: dict[int, int] | list[int]):
        self.bins, self.capacity, self.at, self.free = bins, capacity, {}, []
        for k, b in enumerate(bins):
            self._add(capacity - sum(size[i] for i in b), k)

    def _add(self, free: int, k: int) -> None:
        if free:
            if free not in self.at:
                bisect.insort(self.free, free)
                self.at[free] = []
            self.at[free].append(k)

    def put(self, i: int, length: int) -> None:
        spot = bisect.bisect_left(self.free, length)
        if spot == len(self.free):
            self.bins.append([i])
            self._add(self.capacity - length, len(self.bins) - 1)
            return
        free = self.free[spot]
        ks = self.at[free]
        k = ks.pop()
        if not ks:
            del self.at[free], self.free[spot]
        self.bins[k].append(i)
        self._add(free - length, k)


def best_fit(lengths: list[int], capacity: int, order: list[int] | None = None, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Best-fit packing of items (decreasing unless an order is given) on top of given bins."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i]) if order is None else order
    fit = _Fit(capacity, [list(b) for b in bins or []], lengths)
    for i in order:
        fit.put(i, lengths[i])
    return fit.bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple:
    """Fewer bins first; then the mean square of fill, which rewards full bins beside nearly empty ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rnd: random.Random) -> list[list[int]]:
    """Whole well-filled bins of `b` go into `a`; bins of `a` with duplicates go, and their other items are best-fitted."""
    fill = [sum(lengths[i] for i in x) for x in b]
    good = [k for k in range(len(b)) if fill[k] >= 0.97 * capacity]
    donors = rnd.sample(good, max(1, int(len(good) * rnd.uniform(0.1, 0.5)))) if good else []
    injected = [b[k] for k in donors]
    inside = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in inside]
    # The worst-filled bins are opened too, so that what is displaced has something to combine with.
    kept.sort(key=lambda x: -sum(lengths[i] for i in x))
    for x in kept[len(kept) - max(1, len(kept) // 50) :]:
        displaced += x
    kept = kept[: len(kept) - max(1, len(kept) // 50)]
    # Orders that differ a little keep children of the same parents from being the same.
    noise = rnd.choice((0.0, 0.02, 0.1))
    displaced.sort(key=lambda i: -lengths[i] * rnd.uniform(1 - noise, 1))
    return best_fit(lengths, capacity, displaced, injected + kept)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]], population: int, generations: int) -> list[list[list[int]]]:
    """The island's population, best first; starts from the elites that came in.

    It evolves until its best packing has as few bins as the lengths' sum allows,
    or none of the last `generations` generations bettered it.
    """
    rnd = random.Random(seed)
    bound = -(-sum(lengths) // capacity)
    people = [[list(b) for b in e] for e in elites]
    if not people:
        people.append(best_fit(lengths, capacity))
    people.sort(key=lambda p: fitness(p, lengths, capacity), reverse=True)
    if len(people[0]) <= bound:
        return people
    while len(people) < population:
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * rnd.uniform(0.8, 1.0))
        people.append(best_fit(lengths, capacity, order))
    best, idle = None, 0
    while True:
        people.sort(key=lambda p: fitness(p, lengths, capacity), reverse=True)
        now = fitness(people[0], lengths, capacity)
        best, idle = (now, 0) if best is None or now > best else (best, idle + 1)
        if len(people[0]) <= bound or idle >= generations:
            break
        a, b = rnd.sample(people[: max(2, population // 2)], 2)
        people[-1] = crossover(a, b, lengths, capacity, rnd)
        people[-2] = crossover(people[0], rnd.choice(people[1:]), lengths, capacity, rnd) if len(people) > 2 else people[-2]
    return people


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _unlabel(labels: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        out.setdefault(k, []).append(i)
    return list(out.values())


def _round(items: DataFrame, group: str, capacity: int, salt: int) -> DataFrame:
    """uid, length, grp and bin after the epochs of one round; items: uid, length and the column `group`."""
    schema = "grp long, island int, uids array<long>, lengths array<int>, elites array<array<int>>"
    gathered = items.groupBy(F.expr(group).alias("grp")).agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items"))
    state = gathered.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.uid").alias("uids"), F.col("items.length").cast("array<int>").alias("lengths"), F.lit(None).cast("array<array<int>>").alias("elites"))

    def step(epoch):
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    lengths = row["lengths"]
                    found = evolve(lengths, capacity, hash((row["grp"], row["island"], epoch, salt)), [_unlabel(e) for e in row["elites"] or []], POPULATION, GENERATIONS)
                    row["elites"] = [_labels(p, len(lengths)) for p in found[:2]]
                    yield pa.RecordBatch.from_pylist([row], schema=arrow)

        return run

    arrow = pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("elites", pa.list_(pa.list_(pa.int32())))])
    for epoch in range(EPOCHS):
        state = state.repartition("grp", "island").mapInArrow(step(epoch), schema)
        # Migration: every island of the group gets the best of each of them.
        all_elites = state.groupBy("grp").agg(F.first("uids").alias("uids"), F.first("lengths").alias("lengths"), F.flatten(F.collect_list("elites")).alias("elites"))
        state = all_elites.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "uids", "lengths", "elites")

    def winner(batches):
        for b in batches:
            for row in b.to_pylist():
                lengths = row["lengths"]
                best = max((_unlabel(e) for e in row["elites"]), key=lambda p: fitness(p, lengths, capacity))
                yield pa.RecordBatch.from_arrays([pa.array(row["uids"], pa.int64()), pa.array(lengths, pa.int64()), pa.array([row["grp"]] * len(lengths), pa.int64()), pa.array(_labels(best, len(lengths)), pa.int64())], ["uid", "length", "grp", "bin"])

    return all_elites.mapInArrow(winner, "uid long, length long, grp long, bin long")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """uid, sequence_id and offset of every item (uid, length) with 1 <= length <= capacity; few sequences, no gaps.

    Rounds: all items in groups of about `group`, then what lies in bins under
    97 % filled, in groups again, until one group holds it or a round no longer
    lessens it. No items give no rows.
    """
    # Bins are numbered by round (9 bits), group (36) and place in the group (18); whole ones by their piece, below zero.
    full = items.where(F.col("length") == capacity).select("uid", "length", (-1 - F.col("uid")).alias("bin"))
    rest = items.where(F.col("length") < capacity).select("uid", "length")
    packed, turn, before = full, 0, None
    while True:
        n = rest.count()
        if not n:
            break
        groups = max(1, round(n / group))
        last = groups == 1 or (before is not None and n > 0.9 * before)
        if groups >= 1 << 36 or turn >= 1 << 9:
            raise ValueError("too many groups or rounds to number the sequences")
        made = saved(_round(rest, f"pmod(xxhash64(uid, {turn}L), {groups}L)", capacity, turn))
        place = F.when(F.col("bin") < 1 << 18, F.col("bin")).otherwise(F.raise_error(F.lit("too many sequences in a group")))
        named = made.withColumn("bin", F.lit(turn << 54) + F.shiftleft("grp", 18) + place)
        if last:
            packed = packed.unionByName(named.select("uid", "length", "bin"))
            break
        fill = named.groupBy("bin").agg(F.sum("length").alias("fill"))
        whole = fill.where(F.col("fill") >= 0.97 * capacity).select("bin")
        settled = named.join(whole, "bin", "left_semi").select("uid", "length", "bin")
        packed = packed.unionByName(settled)
        rest = saved(named.join(whole, "bin", "left_anti").select("uid", "length"))
        before, turn = n, turn + 1
    place = "sum(length) over (partition by bin order by length desc, uid rows between unbounded preceding and current row) - length"
    return packed.select("uid", F.col("bin").alias("sequence_id"), F.expr(place).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with the sequence and the offset it got.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows are packed as often as they occur, a null doc_id is kept,
    texts that are null or empty are a single end id; other columns of the
    input are ignored.
    """
    found = saved(pieces(docs, path, capacity, id_col=id_col, text_col=text_col))
    placed = pack(found.select("uid", "length"), capacity)
    return found.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
