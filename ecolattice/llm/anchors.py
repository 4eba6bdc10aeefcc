"""Winnowed anchors: how equal windows of different documents meet without shuffling every window.

A window of `window` symbols (bytes, or words) chooses the least of its
`gram`-symbol hashes as its anchor, leftmost if tied; the choice depends on the
window's content alone, so equal windows choose equal anchors. Consecutive
windows that chose the same occurrence form a run. Runs are dealt to buckets
by their anchor's hash, together with the symbols they span, so all copies of
a window meet in one bucket.

Runs travel in blobs: one compressed block for each bucket and chunk of
documents, in which equal runs are one string with many occurrences. So a
passage that very many documents hold costs a bucket its occurrences' numbers,
not its text. Buckets are sized by the input, not by a limit on rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LET_GO, concat_ranges, partitions_for, release, saved, small_batches

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Bytes of text that one chunk of documents holds (a longer document is cut into overlapping segments).
CHUNK = 2_500_000
#: Symbols that are hashed at a time.
SLICE = 1 << 16
#: Shuffle partitions at most. Buckets, which bound a task's memory, grow with the input beyond it.
PARTITIONS = 50_000
#: zstd level of what is shuffled.
LEVEL = 3
_POSITION = 24


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of all runs of `gram` symbols, composed from powers of two."""
    out, have, power = None, 0, _BASE
    block, size = codes, 1
    left = gram
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                if out is None:
                    out, have = block, size
                else:
                    n = min(len(out) - size, len(block))
                    n = max(0, min(n, len(codes) - have - size + 1))
                    out = block[: n] * _power(have) + out[size : size + n]
                    have += size
            left >>= 1
            if not left:
                return out[: max(0, len(codes) - gram + 1)]
            n = max(0, len(block) - size)
            block = block[:n] * _power(size) + block[size : size + n]
            size *= 2


def _power(n: int) -> np.uint64:
    return _U(pow(int(_BASE), n, 1 << 64))


def least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive keys."""
    block, size = keys, 1
    while size * 2 <= width:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    if size < width:
        block = np.minimum(block[: len(block) - (width - size)], block[width - size :])
    return block


def runs(codes, n: int, starts: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first position, windows, anchor's offset, anchor's hash) of every run.

    codes(a, b) gives the codes of the symbols from a to b of n; documents are
    stretches of them. Worked off in slices, so the arrays stay small.
    """
    valid = np.zeros(n + 1, np.int8)
    many = np.maximum(lengths - window + 1, 0)
    some = many > 0
    valid[starts[some]] += 1
    valid[starts[some] + many[some]] -= 1
    np.cumsum(valid, out=valid)
    found, seen, last = [], 0, -1
    for a in range(0, n - window + 1, SLICE):
        b = min(a + SLICE, n - window + 1)
        v = np.flatnonzero(valid[a:b])
        if not len(v):
            continue
        hashes = mix(gram_hashes(codes(a, b + window - 1), gram))
        keys = (hashes >> _U(_POSITION) << _U(_POSITION)) | np.arange(len(hashes), dtype=np.uint64)
        own = (least_in(keys, window - gram + 1)[v] & _U((1 << _POSITION) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[own[0] + a != last], own[1:] != own[:-1]]))
        found.append((v[first] + a, first + seen, own[first] - v[first], hashes[own[first]]))
        seen, last = seen + len(v), own[-1] + a
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    begin, at, anchor, h = (np.concatenate(x) for x in zip(*found))
    return begin, np.diff(np.append(at, seen)), anchor, h


def span_hashes(codes, n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of the symbols from begin to end, whatever lies around them; codes as for `runs`."""
    power = np.full(min(SLICE, n) or 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    for a in range(0, n, SLICE):
        b = min(a + SLICE, n)
        np.cumsum(codes(a, b) * (power[: b - a] * _power(a)), out=sums[a + 1 : b + 1])
        sums[a + 1 : b + 1] += sums[a]
    out, inverse, left = sums[end] - sums[begin], pow(int(_BASE), -1, 1 << 64), begin.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] *= _U(inverse)
        inverse, left = inverse * inverse % (1 << 64), left >> 1
    return mix(out)


def first_equal(key: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each piece data[begin : begin + size] the number of the first piece that is equal to it (or of itself).

    key holds any integers that equal pieces share. What it groups is compared
    byte by byte with the group's first piece; those that differ are grouped anew.
    """
    rep = np.arange(len(key))
    left = rep.copy()
    while len(left):
        order = np.argsort(key[left], kind="stable")
        sorted_ = key[left[order]]
        fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        head = np.empty(len(left), np.int64)
        head[order] = left[order[fresh]][np.cumsum(fresh) - 1]
        equal = size[left] == size[head]
        again = np.flatnonzero(equal & (head != left) & (size[left] > 0))
        total, k = np.cumsum(size[left[again]]), 0
        while k < len(again):
            e = max(k + 1, int(np.searchsorted(total, total[k] + (1 << 20))))
            rows = again[k:e]
            own = size[left[rows]]
            same = data[concat_ranges(begin[left[rows]], own)] == data[concat_ranges(begin[head[rows]], own)]
            equal[rows] = np.logical_and.reduceat(same, np.cumsum(own) - own)
            k = e
        rep[left[equal]] = head[equal]
        left = left[~equal]
    return rep


class Blob:
    """Runs as compressed bytes: the different strings that they read, once each, and where these occur.

    Strings and occurrences stay in text order: places are stored as
    differences, and what a document repeats lies close together.
    """

    @staticmethod
    def write(ids, tags, doc, start, first, count, anchor, size, h, content) -> bytes:
        """Occurrences: doc (number in ids and tags), start, first (number of the first occurrence of the same string).

        The strings, of which first is the own number, have count, anchor, size, h and content.
        """
        import zstandard

        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        docs = doc[fresh]
        step = np.where(fresh, start, np.diff(start, prepend=0))
        own = first == np.arange(len(first))
        known = (np.cumsum(own) - 1)[first[~own]]
        head = np.array([len(doc), len(docs), len(count), h is not None], np.int64)
        columns = [np.diff(ids[docs], prepend=0).astype(np.int64), tags[docs].astype(np.int32), fresh.astype(np.uint8), step.astype(np.int64), own.astype(np.uint8), known.astype(np.int32), count.astype(np.int32), anchor.astype(np.int32), size.astype(np.int32)]
        if h is not None:
            columns.append(h.astype(np.uint32))
        # Bytes of equal weight lie together, so the high ones, mostly zero, cost nothing.
        planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
        return zstandard.ZstdCompressor(level=LEVEL).compress(head.tobytes() + b"".join(planes) + content.tobytes())

    @staticmethod
    def read(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
        """(strings, occurrences, contents) of several blobs.

        Strings: count, anchor, size (and h, if kept), in the order of their
        contents; one that several blobs hold is there several times.
        Occurrences: doc, tag, start and string (a number).
        """
        import zstandard

        strings: dict[str, list] = {}
        places: dict[str, list] = {}
        contents, tool, before = [], zstandard.ZstdDecompressor(), 0
        for blob in blobs:
            raw = np.frombuffer(tool.decompress(blob), np.uint8)
            n, docs, m, hashed = raw[:32].view(np.int64).tolist()
            at = 32

            def take(many, kind):
                nonlocal at
                width = np.dtype(kind).itemsize
                plane = raw[at : at + many * width].reshape(width, many)
                at += many * width
                return np.ascontiguousarray(plane.T).reshape(-1).view(kind)

            ids, tags, fresh = np.cumsum(take(docs, np.int64)), take(docs, np.int32), take(n, np.uint8).astype(bool)
            which = np.cumsum(fresh) - 1
            step = take(n, np.int64)
            total = np.cumsum(step)
            first = np.flatnonzero(fresh)
            start = total - np.repeat(total[first] - step[first], np.diff(np.append(first, n)))
            own = take(n, np.uint8).astype(bool)
            string = np.cumsum(own) - 1
            string[~own] = take(n - m, np.int32)
            for k, v in {"doc": ids[which], "tag": tags[which], "start": start, "string": (string + before).astype(np.int32)}.items():
                places.setdefault(k, []).append(v)
            for k in ("count", "anchor", "size"):
                strings.setdefault(k, []).append(take(m, np.int32))
            if hashed:
                strings.setdefault("h", []).append(take(m, np.uint32))
            contents.append(raw[at:])
            before += m
        return {k: np.concatenate(v) for k, v in strings.items()}, {k: np.concatenate(v) for k, v in places.items()}, np.concatenate(contents)


def owners(places: dict[str, np.ndarray], strings: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest doc) of each string's occurrences."""
    low, high = np.full(strings, np.iinfo(np.int64).max), np.full(strings, np.iinfo(np.int64).min)
    np.minimum.at(low, places["string"], places["doc"])
    np.maximum.at(high, places["string"], places["doc"])
    return low, high


def keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """doc_id, text and tag, a hash of the text that tells apart rows which repeat a doc_id; and more columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.hash(text).alias("tag"), *more)


def dealt(docs: DataFrame, symbols, window: int, gram: int) -> DataFrame:
    """(bucket, blob) of all runs of the keyed documents.

    symbols(texts) gives (codes and their number as for `runs`, document starts
    and lengths, functions from symbols to the bytes that they begin at and end
    before, and these bytes). Rows with a null doc_id take no part.
    """
    small_batches(docs.sparkSession)
    buckets = partitions_for(docs, symbols.bucket_mb)

    def emit(ids, tags, bases, texts):
        codes, n, starts, lengths, begins, ends, buffer = symbols(texts)
        begin, count, anchor, h = runs(codes, n, starts, lengths, window, gram)
        if not len(begin):
            return None
        # Documents without symbols share their start with the next one, which searchsorted passes over rightly.
        doc = np.searchsorted(starts, begin, side="right") - 1
        bucket = (mix(h + _BASE) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin, count, anchor, h, doc, bucket = (a[order] for a in (begin, count, anchor, h, doc, bucket))
        end = begin + count + window - 1
        low, high = begins(begin), ends(end - 1)
        size, start = high - low, begin - starts[doc] + bases[doc]
        # Equal runs of a bucket travel once. Their hash has the bucket in it, so they meet within it only.
        first = first_equal(mix(span_hashes(codes, n, begin, end) + bucket.astype(np.uint64)), buffer, low, size)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        blobs = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
            s = np.flatnonzero(first[a:b] == np.arange(a, b)) + a
            blobs.append(Blob.write(ids, tags, doc[a:b], start[a:b], first[a:b] - a, count[s], anchor[s], size[s], h[s] if symbols.keep_hash else None, buffer[concat_ranges(low[s], size[s])]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]):
        waiting: list[tuple] = []
        size = 0

        def out():
            return emit(np.array([w[0] for w in waiting], np.int64), np.array([w[1] for w in waiting], np.int32), np.array([w[2] for w in waiting], np.int64), [w[3] for w in waiting])

        for b in batches:
            texts = b.column(1)
            for k, (i, tag) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if i is None:
                    continue
                data = texts[k].as_py().encode("utf-8", "surrogatepass")
                for base, part in symbols.segments(data, window, CHUNK):
                    waiting.append((i, tag, base, part))
                    size += len(part)
                    if size >= CHUNK:
                        if (made := out()) is not None:
                            yield made
                        waiting, size = [], 0
        if waiting and (made := out()) is not None:
            yield made

    # A partition for each bucket, as far as Spark can shuffle so many; where a partition has several, they are judged one by one.
    return docs.select("doc_id", "text", "tag").mapInArrow(run, "bucket int, blob binary").repartitionById(min(buckets, PARTITIONS), F.col("bucket"))


def shared_by_documents(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row, whether its group (any integers) has two documents or more; a row has documents from low to high."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, bool)
    many = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
    out = np.empty(len(g), bool)
    out[order] = np.repeat(many, np.diff(np.append(first, len(g))))
    return out


def covered(flags: np.ndarray, count: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, end) of the maximal stretches of flagged windows; flags are those of all runs' windows in a row."""
    if not len(flags):
        z = np.zeros(0, np.int64)
        return z, z, z
    run = np.repeat(np.arange(len(count)), count)
    place = np.repeat(start, count) + concat_ranges(np.zeros(len(count), np.int64), count)
    before = np.concatenate([[False], flags[:-1] & (run[1:] == run[:-1])])
    after = np.concatenate([flags[1:] & (run[1:] == run[:-1]), [False]])
    a, b = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    return run[a], place[a], place[b] + window


#: A span is one number: its begin times 2**20, plus its length (of one run, so under 2**20).
_SPAN = 20


def repeated(places: dict[str, np.ndarray], owner: np.ndarray, length: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, begin, end) of what goes from each occurrence of the strings.

    Every window of a string occurs in its owner, so all of it goes from any
    other document. From the owner go the stretches found: (string, begin,
    end), in the order of the strings.
    """
    string, doc, start = places["string"], places["doc"], places["start"]
    other = np.flatnonzero(doc > owner[string])
    which, begin, end = found
    offsets = np.searchsorted(which, np.arange(len(owner) + 1))
    mine = np.flatnonzero((doc == owner[string]) & (np.diff(offsets) > 0)[string])
    many = np.diff(offsets)[string[mine]]
    piece = concat_ranges(offsets[string[mine]], many)
    base = np.repeat(start[mine], many)
    return np.concatenate([other, np.repeat(mine, many)]), np.concatenate([start[other], base + begin[piece]]), np.concatenate([start[other] + length[string[other]], base + end[piece]])


def spans(blobs: DataFrame, judge) -> DataFrame:
    """(doc_id, tag, span) of covered stretches, as judge(strings, occurrences, contents) finds them bucket by bucket: (occurrences, begins, ends)."""

    def run(table: pa.Table) -> pa.Table:
        strings, places, content = Blob.read(table.column("blob").to_pylist())
        which, begin, end = judge(strings, places, content)
        return pa.table({"doc_id": pa.array(places["doc"][which], pa.int64()), "tag": pa.array(places["tag"][which], pa.int32()), "span": pa.array((begin << _SPAN) + end - begin, pa.int64())})

    return blobs.groupBy("bucket").applyInArrow(run, "doc_id long, tag int, span long")


def with_spans(docs: DataFrame, blobs: DataFrame, judge, cut, schema: str, rest: str | None = None) -> DataFrame:
    """What cut(doc_id, text's bytes, merged spans of the blobs) gives for every keyed document; texts are shuffled compressed.

    A document's spans are at most as many as its own windows, so its group is
    bounded by its length. Spans are checkpointed first: the runs' shuffle,
    which is the largest, goes before the texts are shuffled. (Nobody may hold
    the frame of spans that was computed, or Spark keeps its shuffle.) A column
    named by `rest` travels along and is added to the result.
    """
    found = saved(spans(blobs, judge))
    release(docs.sparkSession, LET_GO)
    small_batches(docs.sparkSession)
    names = [f.strip().split(" ")[0] for f in _fields(schema)]
    more = [rest] if rest else []
    extra = f", {rest} {docs.schema[rest].dataType.simpleString()}" if rest else ""

    def shrink(batches):
        import zstandard

        for b in batches:
            tool = zstandard.ZstdCompressor(level=LEVEL)
            z = [tool.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), *b.columns[2:]], ["doc_id", "z", "tag", *more])

    def apply(batches):
        import zstandard

        for b in batches:
            tool, rows = zstandard.ZstdDecompressor(), []
            for i, z, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                packed = np.zeros(0, np.int64) if not s.is_valid else s.values.to_numpy(zero_copy_only=False)
                begin = packed >> _SPAN
                rows.append(cut(i, tool.decompress(z.as_py()), merged(np.column_stack([begin, begin + (packed & ((1 << _SPAN) - 1))]))))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), cut.types)] if rows else [pa.array([], t) for t in cut.types]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[3:]], [*names, *more])

    small = docs.select("doc_id", "text", "tag", *more).mapInArrow(shrink, "doc_id long, z binary, tag int" + extra)
    lists = found.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))
    return small.join(lists, ["doc_id", "tag"], "left").select("doc_id", "z", "spans", *more).mapInArrow(apply, schema + extra)


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def merged(pairs: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans that cover the same places; touching spans become one."""
    if not len(pairs):
        return pairs.astype(np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].astype(np.int64)
    reach = np.maximum.accumulate(pairs[:, 1])
    fresh = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.column_stack([pairs[fresh, 0], np.append(reach[fresh[1:] - 1], reach[-1])])
