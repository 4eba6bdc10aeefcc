"""Suffix-array dedup of byte strings that documents share.

The corpus is cut into sub-collections by winnowed anchors (see anchors.py):
short strings such that all copies of a 50-byte window lie in one
sub-collection. Each sub-collection is sorted by column-wise construction: in
every round each string inserts its next symbol, from its end to its start,
and the collection's Burrows-Wheeler transform (BWT) and longest common
prefixes (LCP) are rewritten in one sequential pass over their files. Runs of
LCP >= the window length are classes of equal windows; a window is a repeat if
its class has a window of a document with a smaller id.

The files are read and written in blocks from start to end only. They are
scratch of one task, kept in memory while small and otherwise unlinked files,
so nothing outlives the task and a lost executor only means a retry.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BYTE_CODES, covered, dealt, first_equal, keyed, mix, owners, repeated, shared_by_documents, span_hashes, with_spans
from .common import concat_ranges

WINDOW, GRAM = 50, 8
#: Entries of a file block; a file up to SPOOL bytes stays in memory.
BLOCK, SPOOL = 1 << 20, 32 << 20


class ByteSymbols:
    """Bytes of texts as symbols. Anchors' hashes are not sent, as they follow from the contents."""

    keep_hash = False
    #: MB of input for each bucket.
    bucket_mb = 4

    def __call__(self, texts: list[bytes]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        return lambda a, b: BYTE_CODES[buffer[a:b]], len(buffer), np.cumsum(lengths) - lengths, lengths, lambda k: k, lambda k: k + 1, buffer

    def segments(self, data: bytes, window: int, size: int):
        for k in range(0, max(1, len(data) - window + 1), size):
            yield k, data[k : k + size + window - 1]


class SequentialFile:
    """A file of bytes that is written from start to end, then read from start to end."""

    def __init__(self):
        self.file, self.n = tempfile.SpooledTemporaryFile(SPOOL), 0

    def write(self, part: np.ndarray) -> None:
        self.file.write(part.tobytes())
        self.n += len(part)

    def rewind(self) -> SequentialFile:
        self.file.seek(0)
        return self

    def read(self, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read(n), np.uint8)

    def close(self) -> None:
        self.file.close()


class CollectionBWT:
    """BWT and LCP of a collection of strings, grown by one symbol of each string in every round.

    Every string ends in an end mark. After round j the files describe all
    suffixes of up to j symbols before the mark, in order; the bare marks come
    first. Marks may be ordered by what follows them in the text, with the
    common prefixes of that (`tails`), which then counts as if it stood there.
    The symbol 0 marks a string's newest suffix. An entry with symbol c stands
    for a suffix s; the suffix cs has the rank: marks, then entries with a
    smaller symbol, then earlier entries with c. LCP(cs, its predecessor that
    begins with c) is 1 plus the least LCP between the two entries.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, tails: tuple[np.ndarray, np.ndarray] | None = None):
        self.flat, self.ends, self.lengths = flat, offsets[1:], np.diff(offsets)
        self.d = len(self.lengths)
        self.bwt, self.lcp = SequentialFile(), SequentialFile()
        self.marks, common = tails if tails is not None else (np.arange(self.d), np.zeros(self.d, np.uint8))
        for k in range(0, self.d, BLOCK):
            self.bwt.write(np.zeros(min(BLOCK, self.d - k), np.uint8))
            self.lcp.write(common[k : k + BLOCK])
        self.place = self.marks.copy()
        for j in range(int(self.lengths.max(initial=0))):
            self._round(j)

    def _round(self, j: int) -> None:
        who = np.flatnonzero(self.lengths > j)
        order = np.argsort(self.place[who], kind="stable")
        who = who[order]
        at, symbol = self.place[who], self.flat[self.ends[who] - 1 - j] + np.uint8(1)
        rank, before, after = self._scan(at, symbol)
        counts = self._counts
        base = np.concatenate([[0], np.cumsum(counts[1:])])[:-1] + self.d
        new = base[symbol.astype(np.int64) - 1] + rank
        self.place[who] = new
        o = np.argsort(new, kind="stable")
        self._merge(new[o], before[o], after[o])

    def _scan(self, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Writes the symbols at their places and gives each one's rank among its symbol, its LCP and its successor's.

        An LCP is 0 where there is no such neighbour.
        """
        counts, since = np.zeros(256, np.int64), np.full(256, 255, np.uint8)
        pending = np.full(256, -1, np.int64)
        rank, before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
        self.bwt.rewind(), self.lcp.rewind()
        out, total = SequentialFile(), self.bwt.n
        for k in range(0, total, BLOCK):
            b, low = self.bwt.read(BLOCK).copy(), self.lcp.read(BLOCK)
            i, e = np.searchsorted(at, [k, k + len(b)])
            local = at[i:e] - k
            b[local] = symbol[i:e]
            out.write(b)
            own = np.bincount(b, minlength=256)
            order = np.argsort(b, kind="stable")
            heads = np.concatenate([[0], np.cumsum(own)[:-1]])
            spot = np.empty(len(b), np.int64)
            spot[order] = np.arange(len(b))
            r = spot[local]
            c = symbol[i:e].astype(np.int64)
            rank[i:e] = counts[c] + r - heads[c]
            # Least LCP back to the previous entry of the same symbol, here or (by `since`) in an earlier block.
            start = np.minimum.accumulate(low) if k else low
            has = r > heads[c]
            before[i:e][has] = 1 + _least(low, order[r[has] - 1] + 1, local[has] + 1)
            first = ~has & (counts[c] > 0)
            before[i:e][first] = 1 + np.minimum(since[c[first]], start[local[first]])
            more = r + 1 < heads[c] + own[c]
            after[i:e][more] = 1 + _least(low, local[more] + 1, order[np.where(more, r + 1, 0)[more]] + 1)
            # The successor of an earlier block's last entry may be this block's first.
            due = np.flatnonzero((pending >= 0) & (own > 0))
            after[pending[due]] = 1 + np.minimum(since[due], start[order[heads[due]]])
            pending[due] = -1
            last = ~more
            pending[c[last]] = np.arange(i, e)[last]
            counts += own
            if k + BLOCK >= total:
                break
            newer = np.flatnonzero(own > 0)
            stay = own == 0
            since[stay] = np.minimum(since[stay], start[-1])
            tail = np.append(np.minimum.accumulate(low[::-1])[::-1], np.uint8(255))
            since[newer] = tail[order[heads[newer] + own[newer] - 1] + 1]
            # If the last entry of a symbol is not a new one, nothing waits for its successor.
            ended = np.zeros(256, bool)
            ended[c[last]] = True
            pending[newer[~ended[newer]]] = -1
        self.bwt.close()
        self.bwt, self._counts = out, counts
        return rank, before, after

    def _merge(self, new: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """Inserts new entries at their (ascending) places, and corrects the LCP of what follows each."""
        self.bwt.rewind(), self.lcp.rewind()
        bwt, lcp = SequentialFile(), SequentialFile()
        total = self.bwt.n + len(new)
        fix = after > 0
        follow, value = new[fix] + 1, after[fix]
        for k in range(0, total, BLOCK):
            n = min(BLOCK, total - k)
            i, e = np.searchsorted(new, [k, k + n])
            old = np.ones(n, bool)
            old[new[i:e] - k] = False
            b, low = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
            b[old], low[old] = self.bwt.read(n - (e - i)), self.lcp.read(n - (e - i))
            low[new[i:e] - k] = before[i:e]
            f, g = np.searchsorted(follow, [k, k + n])
            low[follow[f:g] - k] = value[f:g]
            bwt.write(b)
            lcp.write(low)
        self.bwt.close(), self.lcp.close()
        self.bwt, self.lcp = bwt, lcp

    def classes(self, least: int, fewest: np.ndarray) -> np.ndarray:
        """Classes of each string's suffixes, longest first, down to the one of fewest[string] symbols before the mark.

        Neighbours whose LCP is at least `least` have one class. Found by walking
        the ranks: the suffix of j + 1 symbols follows from that of j.
        """
        total = self.bwt.n
        kind = np.int32 if total < 1 << 31 else np.int64
        classes, step = np.empty(total, kind), np.empty(total, kind)
        self.bwt.rewind()
        counts = np.zeros(256, np.int64)
        for _ in range(0, total, BLOCK):
            counts += np.bincount(self.bwt.read(BLOCK), minlength=256)
        base = np.concatenate([[0, 0], np.cumsum(counts[1:])[:-1]]) + self.d
        self.bwt.rewind(), self.lcp.rewind()
        seen, name = np.zeros(256, np.int64), 0
        for k in range(0, total, BLOCK):
            b, low = self.bwt.read(BLOCK), self.lcp.read(BLOCK)
            own = np.bincount(b, minlength=256)
            order = np.argsort(b, kind="stable")
            heads = np.concatenate([[0], np.cumsum(own)[:-1]])
            c = b[order].astype(np.int64)
            step[k + order] = base[c] + seen[c] + np.arange(len(b)) - heads[c]
            seen += own
            names = name + np.cumsum(low < least)
            classes[k : k + len(b)] = names
            name = int(names[-1])
        many = self.lengths - fewest + 1
        ends = np.cumsum(many)
        out = np.empty(int(ends[-1]) if len(ends) else 0, kind)
        at = self.marks.copy()
        for j in range(int(self.lengths.max(initial=0)) + 1):
            use = (self.lengths >= j) & (fewest <= j)
            out[(ends - many)[use] + self.lengths[use] - j] = classes[at[use]]
            on = self.lengths > j
            at[on] = step[at[on]]
        return out

    def close(self) -> None:
        self.bwt.close(), self.lcp.close()


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a:b]) of every pair a < b."""
    if not len(a):
        return np.zeros(0, np.uint8)
    order = np.argsort(-a, kind="stable")
    pairs = np.empty(2 * len(a), np.int64)
    pairs[::2], pairs[1::2] = a[order], b[order]
    # From the right to the left, each even step reduces a..b and each odd one a single entry.
    padded = np.append(values, np.uint8(255))
    out = np.empty(len(a), np.uint8)
    out[order] = np.minimum.reduceat(padded, pairs)[::2]
    return out


def _part_hash(content: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(begin), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + BYTE_CODES[content[begin + k]]
    return h


def candidates(strings: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, content: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Strings that may share a window with another document; their documents go from low to high.

    A window has at least half of its other bytes on one side of the anchor, so
    two documents that share one also share the anchor with that much to its
    left or to its right.
    """
    side = (window - gram + 1) // 2
    anchor, size = strings["anchor"].astype(np.int64), strings["size"].astype(np.int64)
    alive = np.flatnonzero(shared_by_documents(_part_hash(content, offsets[:-1] + anchor, gram), low, high))
    low, high, anchor, size, begin = low[alive], high[alive], anchor[alive], size[alive], offsets[alive]
    use = np.zeros(len(alive), bool)
    for has, left in ((anchor >= side, anchor - side), (size - anchor - gram >= side, anchor)):
        some = np.flatnonzero(has)
        use[some] |= shared_by_documents(mix(_part_hash(content, begin[some] + left[some], side + gram)), low[some], high[some])
    return alive[use]


def sorted_tails(content: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each piece of content, LCP of each rank with the one before); pieces have under 255 bytes, shorter ones come first."""
    width = int(length.max(initial=0))
    padded = np.zeros((len(begin), width + 1), np.uint8)
    for k in range(width):
        some = length > k
        padded[some, k] = content[begin[some] + k]
    padded[:, width] = length + 1
    order = np.argsort(padded.view(f"S{width + 1}").ravel(), kind="stable")
    rank = np.empty(len(begin), np.int64)
    rank[order] = np.arange(len(begin))
    common = np.zeros(len(begin), np.uint8)
    if len(begin) > 1:
        one, two = padded[order[1:], :width], padded[order[:-1], :width]
        differ = one != two
        first = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(first, np.minimum(length[order[1:]], length[order[:-1]]))
    return rank, common


def judge_bytes(window: int = WINDOW, gram: int = GRAM):
    """The judge of a bucket's runs: stretches of windows that start in a smaller document too.

    Equal windows have their anchor at the same place. So a run's string is
    what precedes its anchor; its end mark is ordered by the bytes from the
    anchor on, and what the transform classifies are whole windows.
    """

    def judge(strings: dict[str, np.ndarray], places: dict[str, np.ndarray], content: np.ndarray):
        size = strings["size"].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        low, high = owners(places, len(size))
        use = candidates(strings, low, high, content, offsets, window, gram)
        empty = np.zeros(0, np.int64)
        if not len(use):
            return empty, empty, empty
        # Equal strings of several blobs are one, owned by the smallest of their documents.
        content = content[concat_ranges(offsets[use], size[use])]
        size, low, anchor, count = size[use], low[use], strings["anchor"][use].astype(np.int64), strings["count"][use].astype(np.int64)
        ends = np.cumsum(size)
        begin = ends - size
        first = first_equal(span_hashes(lambda a, b: BYTE_CODES[content[a:b]], len(content), begin, ends), content, begin, size)
        one, string = np.unique(first, return_inverse=True)
        owner = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(owner, string, low)
        begin, size, anchor, many = begin[one], size[one], anchor[one], count[one]
        bounds = np.concatenate([[0], np.cumsum(anchor)])
        tails = sorted_tails(content, begin + anchor, np.minimum(size - anchor, window))
        built = CollectionBWT(content[concat_ranges(begin, anchor)], bounds, tails)
        cls = built.classes(window, anchor - many + 1)
        built.close()
        least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, np.repeat(owner, many))
        found = covered(least[cls] < np.repeat(owner, many), many, np.zeros(len(one), np.int64), window)
        # Occurrences of the strings that take part, by the string's new number.
        number = np.full(len(strings["size"]), -1)
        number[use] = string
        inside = np.flatnonzero(number[places["string"]] >= 0)
        own = {"string": number[places["string"][inside]], "doc": places["doc"][inside], "start": places["start"][inside]}
        which, a, b = repeated(own, owner, size, found)
        return inside[which], a, b

    return judge


class _Cut:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))

    def __call__(self, doc_id, data: bytes, found: np.ndarray):
        kept, at = [], 0
        for a, b in found.tolist():
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        return doc_id, len(data), b"".join(kept), [{"begin": a, "end": b} for a, b in found.tolist()]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (the maximal removed runs) of every row.

    A byte goes if a `window`-byte string that covers it also starts in a
    document with a smaller doc_id. Null texts are empty; texts shorter than
    the window, rows with a null doc_id and empty tables lose nothing; rows
    that repeat a doc_id are not earlier than one another; other columns are
    ignored.
    """
    own = keyed(docs, id_col, text_col)
    return with_spans(own, dealt(own, ByteSymbols(), window, gram), judge_bytes(window, gram), _Cut(), "doc_id long, n_bytes long, kept binary, spans array<struct<begin: long, end: long>>")


class _CutText:
    types = (pa.string(),)

    def __call__(self, doc_id, data: bytes, found: np.ndarray):
        return (_Cut()(doc_id, data, found)[2].decode("utf-8", "ignore"),)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of `docs` with repeated bytes cut out of `text`; characters that a cut leaves incomplete go too.

    A null text stays null. Rows with a null doc_id stay as they are. The other
    columns travel beside the text, which is shuffled once.
    """
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(docs["text"].isNull().alias("_null"), *[docs[c].alias(f"c{k}") for k, c in enumerate(others)]).alias("_rest")
    own = keyed(docs, "doc_id", "text", rest)
    cut = with_spans(own, dealt(own, ByteSymbols(), window, gram), judge_bytes(window, gram), _CutText(), "_text string", "_rest")
    text = F.when(~F.col("_rest._null"), F.col("_text")).alias("text")
    return cut.select(*[text if c == "text" else F.col(f"_rest.c{others.index(c)}").alias(c) for c in docs.columns])
