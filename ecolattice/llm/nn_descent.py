"""Approximate nearest neighbours by NN-descent and greedy graph search, for the largest inner product.

Equal vectors are one node. A first graph comes from random-hyperplane blocks
of bounded size. Then, round by round, every node introduces its neighbours
and its reverse neighbours to each other (a join of neighbours of neighbours);
who is nearer than what a node knows becomes its neighbour. Queries walk the
graph greedily: from their node they keep a beam of the nearest nodes seen and
expand the best ones not yet expanded until none is left.

Vectors travel as 8-bit codes while the graph is built, and stay where they
are during the search: a query's vector is sent once to each partition that
holds candidates of it. Final scores are inner products of the original
vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Rounds, release, saved

#: Neighbours a node keeps, reverse neighbours it hears, and introductions of each neighbour in a round.
NEIGHBOURS, REVERSE, INTRODUCED = 40, 40, 10
#: Hyperplane tables of the first graph, vectors of a block on average and at most.
TABLES, BLOCK, BLOCK_MAX = 6, 150, 300
#: Introductions that a task gathers by node before it hands them on (12 bytes each).
INTRODUCTIONS = 4_000_000
#: Nodes of a partition in the search.
PART_NODES = 5000
#: The share of changed neighbours under which NN-descent ends.
STILL = 0.02
#: Nodes in a query's beam, of which so many are expanded in a step; the walk ends when no query has one left.
BEAM, EXPANDED = 160, 64
#: Rounds and steps after which something must be wrong: an error, never an end.
MOST_ROUNDS, MOST_STEPS = 200, 2000


#: One neighbour in a packed list.
NEAR = np.dtype([("id", "<i8"), ("score", "<f4")])


def pack(ids: np.ndarray, scores: np.ndarray) -> bytes:
    out = np.empty(len(ids), NEAR)
    out["id"], out["score"] = ids, scores
    return out.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, NEAR)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of a binary column in a row, offset of each value)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lists_of(records: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of packed lists, from all records in a row and how many each list has."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * records.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(records.tobytes())])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def _best(node: np.ndarray, near: np.ndarray, old: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's k best different neighbours, best first, ties to the smaller id; old if any row of the pair was."""
    order = np.lexsort((-near["score"], near["id"], node))
    node, near, old = node[order], near[order], old[order]
    first = np.concatenate([[True], (node[1:] != node[:-1]) | (near["id"][1:] != near["id"][:-1])])
    old = np.logical_or.reduceat(old, np.flatnonzero(first))
    node, near = node[first], near[first]
    own = near["id"] != node
    node, near, old = node[own], near[own], old[own]
    order = np.lexsort((near["id"], -near["score"], node))
    node, near, old = node[order], near[order], old[order]
    at, sizes = _groups(node)
    keep = np.arange(len(node)) - np.repeat(at, sizes) < k
    return node[keep], near[keep], old[keep]


def by_key(batches, column: int):
    """Record batches of a sorted stream, cut so that rows of one key (an integer column) are never apart."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        keys = b.column(column).to_numpy()
        if held and keys[-1] == held[-1].column(column)[0].as_py():
            held.append(b)
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or held:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0] if held or cut else b
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of vectors that take part: not null or zero, all components finite, of the most frequent length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["n"] if size else 0))


def _blob(v: str = "v", kind: str = "float32"):
    """mapInArrow function: the array column as bytes of a number type, other columns as they are."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(v)
            flat = b.column(at).flatten().to_numpy(zero_copy_only=False)
            n = len(b)
            data = flat.reshape(n, -1).astype(kind) if n else np.zeros((0, 0))
            yield b.set_column(at, v, pa.array([r.tobytes() for r in data], pa.binary()))

    return run


def nodes_of(rows: DataFrame, most: int) -> DataFrame:
    """node, members (up to `most` smallest ids) and x (float64 bytes) of each different vector; node is the smallest id.

    The window keeps `most` rows of a vector before it shuffles, so equal vectors never gather in one task.
    """
    data = rows.mapInArrow(_blob("v", "float64"), "vec_id long, v binary")
    first = Window.partitionBy("v").orderBy("vec_id")
    few = data.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.element_at("members", 1).alias("node"), "members", F.col("v").alias("x"))


def first_graph(nodes: DataFrame, k: int, tables: int = TABLES, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(node, near): candidates from hyperplane blocks; near is a packed list."""
    n = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / block)))))

    def codes(batches):
        planes = None
        for b in batches:
            if not len(b):
                continue
            x = np.stack([np.frombuffer(v, np.float64) for v in b.column(1).to_pylist()])
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
            signs = (x @ planes > 0).reshape(len(x), tables, bits)
            code = signs @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(x), tables), np.int64)
            small = [v.tobytes() for v in x.astype(np.float32)]
            for t in range(tables if bits else 1):
                yield pa.RecordBatch.from_arrays([pa.array(code[:, t] * tables + t), b.column(0), pa.array(small, pa.binary())], ["code", "node", "x"])

    coded = nodes.select("node", "x").mapInArrow(codes, "code long, node long, x binary")
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / BLOCK_MAX).cast("long").alias("parts"))
    dealt = coded.join(sizes, "code").select("code", F.pmod(F.xxhash64("node", "code"), F.col("parts")).alias("part"), "node", "x")

    def join(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        x = np.stack([np.frombuffer(v, np.float32) for v in table.column("x").to_pylist()])
        few = min(k, len(ids) - 1)
        blobs = []
        for a in range(0, len(ids) if few > 0 else 0, 512):
            s = x[a : a + 512] @ x.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            top = np.argpartition(-s, few - 1, axis=1)[:, :few]
            blobs += [pack(ids[t], s[i, t]) for i, t in enumerate(top)]
        return pa.table({"node": pa.array(ids[: len(blobs)], pa.int64()), "near": pa.array(blobs, pa.binary())})

    return dealt.groupBy("code", "part").applyInArrow(join, "node long, near binary")


def merge(candidates: DataFrame, k: int) -> DataFrame:
    """(node, near, changed) with the k best of all lists of a node; changed counts those that no row marked old had.

    candidates: node, near, old. Lists are merged batch by batch as they stream in.
    """

    def run(batches):
        held = None
        for b in batches:
            if not len(b):
                continue
            data, offsets = _flat(b.column(1))
            near = data.view(NEAR)
            counts = np.diff(offsets) // NEAR.itemsize
            node = np.repeat(b.column(0).to_numpy(), counts)
            old = np.repeat(b.column(2).to_numpy(zero_copy_only=False), counts)
            if held is not None:
                node, near, old = np.concatenate([held[0], node]), np.concatenate([held[1], near]), np.concatenate([held[2], old])
            if not len(node):
                continue
            node, near, old = _best(node, near, old, k)
            # The last node may go on in the next batch.
            last = len(node) if not len(node) else int(np.searchsorted(node, node[-1]))
            held = node[last:], near[last:], old[last:]
            if last:
                yield made(node[:last], near[:last], old[:last])
        if held is not None and len(held[0]):
            yield made(*held)

    def made(node, near, old):
        first, counts = _groups(node)
        return pa.RecordBatch.from_arrays([pa.array(node[first]), _lists_of(near, counts), pa.array(np.add.reduceat(~old, first).astype(np.int32))], ["node", "near", "changed"])

    return candidates.select("node", "near", "old").repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, near binary, changed int")


def _edges(graph: DataFrame) -> DataFrame:
    """(src, dst, score) of all neighbours."""

    def run(batches):
        for b in batches:
            data, offsets = _flat(b.column(1))
            near = data.view(NEAR)
            src = np.repeat(b.column(0).to_numpy(), np.diff(offsets) // NEAR.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(np.ascontiguousarray(near["id"])), pa.array(np.ascontiguousarray(near["score"]))], ["src", "dst", "score"])

    return graph.select("node", "near").mapInArrow(run, "src long, dst long, score float")


def _circle(graph: DataFrame, reverse: int) -> DataFrame:
    """(owner, member): a node's neighbours, and up to `reverse` of those that have it as one.

    Which ones is settled by a hash; the window drops the others before it shuffles.
    """
    edges = _edges(graph)
    pick = Window.partitionBy("dst").orderBy(F.xxhash64("src", "dst"))
    back = edges.select("src", "dst").withColumn("r", F.row_number().over(pick)).where(F.col("r") <= reverse)
    return edges.select(F.col("src").alias("owner"), F.col("dst").alias("member")).unionByName(back.select(F.col("dst").alias("owner"), F.col("src").alias("member")))


def descend(graph: DataFrame, codes: DataFrame, k: int, reverse: int, introduced: int) -> DataFrame:
    """One round: the graph with the neighbours' neighbours that are nearer. codes: member, x (8-bit code and its scale)."""
    worst = graph.select(F.col("node").alias("member"), F.col("near"))

    def bounds(batches):
        for b in batches:
            low = [float(unpack(x)["score"].min()) if len(x) >= NEAR.itemsize * k else -np.inf for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.float32())], ["member", "worst"])

    known = codes.join(worst.mapInArrow(bounds, "member long, worst float"), "member", "left")
    circle = _circle(graph, reverse).join(known, "member")

    def introduce(batches):
        out: list[tuple] = []
        size = 0

        def flush():
            node, near = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            out.clear()
            order = np.argsort(node, kind="stable")
            node, near = node[order], near[order]
            first, counts = _groups(node)
            return pa.RecordBatch.from_arrays([pa.array(node[first]), _lists_of(near, counts)], ["node", "near"])

        for b in by_key(batches, 0):
            member = b.column(1).to_numpy()
            data, offsets = _flat(b.column(2))
            code = data.reshape(len(b), int(offsets[1]))
            x = code[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(code[:, :4]).view(np.float32)
            low = np.nan_to_num(b.column(3).to_numpy(zero_copy_only=False), nan=-np.inf).astype(np.float32)
            for at, n in zip(*_groups(b.column(0).to_numpy())):
                ids, one = np.unique(member[at : at + n], return_index=True)
                if len(ids) < 2:
                    continue
                v = x[at + one]
                s = v @ v.T
                np.fill_diagonal(s, -np.inf)
                few = min(introduced, len(ids) - 1)
                top = np.argpartition(s, len(ids) - few, axis=1)[:, -few:]
                got = np.take_along_axis(s, top, 1)
                i, j = np.nonzero(got > low[at + one][:, None])
                if len(i):
                    near = np.empty(len(i), NEAR)
                    near["id"], near["score"] = ids[top[i, j]], got[i, j]
                    out.append((ids[i], near))
                    size += len(i)
            if size > INTRODUCTIONS:
                yield flush()
                size = 0
        if out:
            yield flush()

    met = circle.select("owner", "member", "x", "worst").repartition("owner").sortWithinPartitions("owner").mapInArrow(introduce, "node long, near binary")
    return merge(met.withColumn("old", F.lit(False)).unionByName(graph.select("node", "near").withColumn("old", F.lit(True))), k)


def _coded(batches):
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = np.frombuffer(v, np.float64)
            scale = np.float32(np.abs(x).max() / 127)
            out.append(scale.tobytes() + np.rint(x / scale).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["member", "x"])


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, reverse: int = REVERSE, introduced: int = INTRODUCED, seed: int = 1) -> DataFrame:
    """(node, near): the neighbour graph over nodes (node, x), descended until fewer than STILL of the neighbours change; written to the shared folder."""
    kept = Rounds(nodes.sparkSession, "graph")
    graph = kept(merge(first_graph(nodes, k, seed=seed).withColumn("old", F.lit(False)), k))
    codes = saved(nodes.select("node", "x").mapInArrow(_coded, "member long, x binary"))
    for _ in range(MOST_ROUNDS):
        graph = kept(descend(graph, codes, k, reverse, introduced))
        release(nodes.sparkSession)
        share = graph.agg(F.sum("changed") / F.sum(F.length("near") / NEAR.itemsize)).first()[0]
        if share is None or share < STILL:
            return graph.select("node", "near")
    raise RuntimeError(f"neighbours still change after {MOST_ROUNDS} rounds")


def _lists(circle: DataFrame) -> DataFrame:
    """(node, ids): the circle of each node as bytes of 64-bit ids."""

    def run(batches):
        for b in by_key(batches, 0):
            pairs = np.unique(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]), axis=0)
            first, counts = _groups(pairs[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), _lists_of(np.ascontiguousarray(pairs[:, 1]), counts)], ["node", "ids"])

    return circle.repartition("owner").sortWithinPartitions("owner").mapInArrow(run, "node long, ids binary")


def _together(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """Both frames' rows of each `part`, handed to work(left table, right table)."""
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(work, schema)


def _by_id(table: pa.Table, column: str, key: str = "node") -> dict:
    return dict(zip(table.column(key).to_pylist(), table.column(column).to_pylist()))


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, expanded: int = EXPANDED, reverse: int = REVERSE) -> DataFrame:
    """(query_id, node, score): the best nodes found for queries (query_id, node), at least k classes of equal vectors if there are.

    Scores are exact doubles. Nodes, requests and beams meet in partitions by
    a hash of the node or of the query.
    """
    parts = max(8, nodes.count() // PART_NODES + 1)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    vectors = saved(nodes.select(part("node").alias("part"), "node", "x"))
    adjacency = saved(_lists(_circle(graph, reverse)).select(part("node").alias("part"), "node", "ids"))

    # A query starts with its own node in the beam, not yet expanded. Beam: ids, scores, flags.
    def begin(batches):
        for b in batches:
            x = [np.frombuffer(v, np.float64) for v in b.column(2).to_pylist()]
            blob = [np.array([n], np.int64).tobytes() + np.array([v @ v], np.float32).tobytes() + b"\0" for n, v in zip(b.column(1).to_pylist(), x)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(blob, pa.binary())], ["query_id", "x", "beam"])

    started = queries.join(nodes.select("node", "x"), "node").select("query_id", "node", "x").mapInArrow(begin, "query_id long, x binary, beam binary")
    kept = Rounds(nodes.sparkSession, "beams")
    state = kept(started.select(part("query_id").alias("part"), "query_id", "x", "beam", F.lit(1).alias("open")))

    def opened(beam_: bytes):
        n = len(beam_) // 13
        ids, scores, flags = np.frombuffer(beam_, np.int64, n), np.frombuffer(beam_, np.float32, n, 8 * n), np.frombuffer(beam_, np.uint8, n, 12 * n)
        return ids, scores, flags

    def frontier(batches):
        for b in batches:
            qs, vs = [], []
            for q, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, _, flags = opened(blob)
                new = ids[flags == 0][:expanded]
                qs += [q] * len(new)
                vs += new.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(vs, pa.int64())], ["query_id", "node"])

    def look_up(asked: pa.Table, lists: pa.Table) -> pa.Table:
        ids = _by_id(lists, "ids")
        found: dict[int, list[bytes]] = {}
        for q, v in zip(asked.column("query_id").to_pylist(), asked.column("node").to_pylist()):
            found.setdefault(q, []).append(ids.get(v, b""))
        return pa.table({"query_id": pa.array(list(found), pa.int64()), "ids": pa.array([b"".join(x) for x in found.values()], pa.binary())})

    def ask(beams: pa.Table, lists: pa.Table) -> pa.Table:
        got: dict[int, list[bytes]] = {}
        for q, i in zip(lists.column("query_id").to_pylist(), lists.column("ids").to_pylist()):
            got.setdefault(q, []).append(i)
        qs, xs, ids = [], [], []
        for q, x, blob in zip(*(beams.column(c).to_pylist() for c in ("query_id", "x", "beam"))):
            if q in got:
                new = np.setdiff1d(np.frombuffer(b"".join(got[q]), np.int64), opened(blob)[0])
                if len(new):
                    qs.append(q)
                    xs.append(x)
                    ids.append(new)
        return pa.table({"query_id": pa.array(qs, pa.int64()), "x": pa.array(xs, pa.binary()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    def score(asked: pa.Table, own: pa.Table) -> pa.Table:
        names = own.column("node").to_numpy()
        order = np.argsort(names)
        names = names[order]
        x = np.stack([np.frombuffer(v, np.float64) for v in own.column("x").to_pylist()])[order] if len(names) else None
        by: dict[int, list] = {}
        for q, v, i in zip(*(asked.column(c).to_pylist() for c in ("query_id", "x", "ids"))):
            by.setdefault(q, [v, []])[1] += i
        out = []
        for _, (v, i) in by.items():
            i = np.array(i, np.int64)
            out.append(pack(i, x[np.searchsorted(names, i)] @ np.frombuffer(v, np.float64)))
        return pa.table({"query_id": pa.array(list(by), pa.int64()), "near": pa.array(out, pa.binary())})

    def update(beams: pa.Table, scored: pa.Table) -> pa.Table:
        got: dict[int, list[bytes]] = {}
        for q, b in zip(scored.column("query_id").to_pylist(), scored.column("near").to_pylist()):
            got.setdefault(q, []).append(b)
        out, left = [], []
        for q, blob in zip(beams.column("query_id").to_pylist(), beams.column("beam").to_pylist()):
            ids, scores, flags = opened(blob)
            flags = flags.copy()
            flags[np.flatnonzero(flags == 0)[:expanded]] = 1
            more = unpack(b"".join(got.get(q, [])))
            ids, scores = np.concatenate([ids, more["id"]]), np.concatenate([scores, more["score"]])
            flags = np.concatenate([flags, np.zeros(len(ids) - len(flags), np.uint8)])
            order = np.lexsort((ids, -scores))[:beam]
            out.append(ids[order].tobytes() + scores[order].tobytes() + flags[order].tobytes())
            left.append(int((flags[order] == 0).sum()))
        return pa.table({"part": beams.column("part"), "query_id": beams.column("query_id"), "x": beams.column("x"), "beam": pa.array(out, pa.binary()), "open": pa.array(left, pa.int32())})

    for _ in range(MOST_STEPS):
        asked = state.where("open > 0").select("query_id", "beam").mapInArrow(frontier, "query_id long, node long").select(part("node").alias("part"), "query_id", "node")
        lists = _together(asked, adjacency, look_up, "query_id long, ids binary").select(part("query_id").alias("part"), "query_id", "ids")
        wanted = _together(state, lists, ask, "query_id long, x binary, ids array<long>")
        requests = wanted.select("query_id", "x", F.explode("ids").alias("id")).groupBy(part("id").alias("part"), "query_id").agg(F.first("x").alias("x"), F.collect_list("id").alias("ids"))
        scored = _together(requests, vectors, score, "query_id long, near binary").select(part("query_id").alias("part"), "query_id", "near")
        state = kept(_together(state, scored, update, "part int, query_id long, x binary, beam binary, open int"))
        release(nodes.sparkSession)
        if state.where("open > 0").isEmpty():
            break
    else:
        raise RuntimeError(f"queries still have nodes to expand after {MOST_STEPS} steps")

    # The best of each beam, scored once more from the original vectors in double precision.
    def best(batches):
        for b in batches:
            for q, x, blob in zip(*(b.column(c).to_pylist() for c in range(3))):
                ids = opened(blob)[0][: 2 * k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int64()), pa.array([x] * len(ids), pa.binary()), pa.array(ids, pa.int64())], ["query_id", "q", "node"])

    def exact(batches):
        for b in batches:
            s = [float(np.frombuffer(q, np.float64) @ np.frombuffer(x, np.float64)) for q, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64())], ["query_id", "node", "score"])

    last = state.select("query_id", "x", "beam").mapInArrow(best, "query_id long, q binary, node long")
    return last.join(vectors.select("node", "x"), "node").select("query_id", "q", "node", "x").mapInArrow(exact, "query_id long, node long, score double")


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row whose id is divisible by `every`.

    Nearest is the largest inner product, ties to the smaller id. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do
    those of another length than most, nor null ids; equal vectors and
    repeated rows are one node whose members (repeated ids once) all count;
    with fewer candidates than k all found are returned. Empty tables give
    empty results; other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    nodes = saved(nodes_of(rows, k + 1))
    graph = build_graph(nodes.select("node", "x"))
    # A query's node is that of its vector; only the smallest k + 1 ids of a vector are listed, so it is found by the vector.
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(_blob("v", "float64"), "vec_id long, v binary").distinct()
    queries = asked.join(nodes.select("node", F.col("x").alias("v")), "v").select(F.col("vec_id").alias("query_id"), "node")
    queries = queries.groupBy("query_id").agg(F.min("node").alias("node"))
    found = search(nodes.select("node", "x"), graph, queries, k)
    each = found.join(nodes.select("node", "members"), "node").select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
