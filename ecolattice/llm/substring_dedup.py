"""Substring dedup by seed and extend over words.

Every 13-word window chooses a winnowed anchor of three words (see
anchors.py). Documents are joined on anchors; each shared anchor is a seed
that is extended to the left and to the right, word by word: occurrences stay
together as long as their words agree. A window is a repeat if an occurrence
in a document with a smaller id agrees with it as far as the window reaches on
both sides, which is compared word by word. Overlapping repeats are merged into maximal ones, so none is
shorter than the window.

Extension works on classes of agreeing strings, never on pairs, so a passage
that very many documents hold is extended once for every chunk of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import _BASE, BYTE_CODES, covered, dealt, first_equal, keyed, mix, owners, repeated, shared_by_documents, with_spans
from .common import concat_ranges

WINDOW, GRAM = 13, 3
#: Bytes of text whose words are coded at a time.
SLICE = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_codes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit code, begin, end) of every white-space separated word of a byte buffer."""
    inside = ~_IS_SPACE[buffer]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    size = end - begin
    base = np.full(int(size.max()), _BASE, np.uint64)
    base[0] = 1
    powers = np.multiply.accumulate(base)
    codes = np.empty(len(begin), np.uint64)
    # Slices of about a megabyte (or one word) keep the index arrays small.
    total = np.cumsum(size)
    k = 0
    while k < len(begin):
        e = max(k + 1, int(np.searchsorted(total, total[k] + SLICE)))
        own = size[k:e]
        at = concat_ranges(begin[k:e], own)
        terms = BYTE_CODES[buffer[at]] * powers[at - np.repeat(begin[k:e], own)]
        codes[k:e] = np.add.reduceat(terms, np.cumsum(own) - own)
        k = e
    return mix(codes + size.astype(np.uint64)), begin, end


def _rows_of(content: np.ndarray, offsets: np.ndarray, size: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contents of the used rows, each followed by a space, and where each begins."""
    ends = np.cumsum(size[use] + 1)
    begin = ends - size[use] - 1
    text = np.full(int(ends[-1]), 0x20, np.uint8)
    step = max(1, int(SLICE / max(1.0, size[use].mean())))
    for k in range(0, len(use), step):
        rows = use[k : k + step]
        text[concat_ranges(begin[k : k + step], size[rows])] = content[concat_ranges(offsets[rows], size[rows])]
    return text, begin


class WordSymbols:
    """Words of texts as symbols. A part of the anchors' hashes is sent along, to find seeds before words are looked at."""

    keep_hash = True
    #: MB of input for each bucket.
    bucket_mb = 2

    def __call__(self, texts: list[bytes]):
        buffer = np.frombuffer(b"\n".join(texts), np.uint8)
        codes, begin, end = word_codes(buffer)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        edges = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
        return lambda a, b: codes[a:b], len(codes), edges[:-1], np.diff(edges), begin.__getitem__, end.__getitem__, buffer

    def segments(self, data: bytes, window: int, size: int):
        """A long text in parts that overlap by window - 1 words; each with the number of its first word."""
        if len(data) <= size:
            yield 0, data
            return
        _, begin, end = word_codes(np.frombuffer(data, np.uint8))
        at = 0
        while at < len(begin):
            to = max(int(np.searchsorted(begin, begin[at] + size)), at + 1)
            last = min(to + window - 1, len(begin)) - 1
            yield at, data[begin[at] : end[last]]
            at = to


def word_names(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, begin) of every word of a text; names (numbers) are equal if the words are, byte by byte."""
    codes, begin, end = word_codes(text)
    return first_equal(codes, text, begin, end - begin).astype(np.uint64), begin


def classes_of(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The number of the first row that equals each row of a matrix; key holds integers that equal rows share."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(-1)
    width = rows.shape[1] * rows.itemsize
    return first_equal(key, flat, np.arange(len(rows)) * width, np.full(len(rows), width))


def judge_words(window: int = WINDOW, gram: int = GRAM):
    """The judge of a bucket's runs: stretches of windows that start in a smaller document too."""

    def judge(strings: dict[str, np.ndarray], places: dict[str, np.ndarray], content: np.ndarray):
        size = strings["size"].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        owner, last = owners(places, len(size))
        # Seeds: anchors that two documents share.
        use = np.flatnonzero(shared_by_documents(strings["h"], owner, last))
        empty = np.zeros(0, np.int64)
        if not len(use):
            return empty, empty, empty
        text, own = _rows_of(content, offsets, size, use)
        names, begin = word_names(text)
        del text
        first = np.searchsorted(begin, own)
        del begin
        low, high = owner[use], last[use]
        anchor, count = strings["anchor"][use].astype(np.int64), strings["count"][use].astype(np.int64)
        spare = window - gram
        left = np.minimum(anchor, spare)
        right = np.minimum(count - 1 + window - gram - anchor, spare)
        # Extension: what k words to the left (right) of the anchor read, as one code per k.
        seed = np.zeros(len(use), np.uint64)
        for k in range(gram):
            seed = mix(seed * _BASE + names[first + anchor + k])
        lefts, rights = [seed], [seed]
        for k in range(1, spare + 1):
            a = names[np.maximum(first + anchor - k, 0)]
            b = names[np.minimum(first + anchor + gram - 1 + k, len(names) - 1)]
            lefts.append(mix(lefts[-1] * _BASE + a))
            rights.append(mix(rights[-1] * _BASE + b))
        at = np.cumsum(count) - count
        flags = np.zeros(int(count.sum()), bool)
        # Occurrences that agree with no other document half the way on either side cannot share a window.
        half = (spare + 1) // 2
        alive = np.zeros(len(use), bool)
        for has, code in ((left >= half, lefts[half]), (right >= half, rights[half])):
            some = np.flatnonzero(has)
            alive[some] |= shared_by_documents(code[some], low[some], high[some])
        for k in range(spare + 1):
            rows = np.flatnonzero(alive & (left >= k) & (right >= spare - k) & (anchor - k < count))
            if not len(rows):
                continue
            key = mix(lefts[k][rows] * _BASE + rights[spare - k][rows])
            some = np.flatnonzero(shared_by_documents(key, low[rows], high[rows]))
            rows, key = rows[some], key[some]
            # What meets by its code is compared word by word.
            same = classes_of(key, names[(first[rows] + anchor[rows] - k)[:, None] + np.arange(window)].astype(np.uint32)) if len(rows) else rows
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, same, low[rows])
            flags[(at[rows] + anchor[rows] - k)[least[same] < low[rows]]] = True
        run, a, b = covered(flags, count, np.zeros(len(use), np.int64), window)
        length = strings["count"].astype(np.int64) + window - 1
        return repeated(places, owner, length, (use[run], a, b))

    return judge


class _Cut:
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))

    def __call__(self, doc_id, data: bytes, found: np.ndarray):
        words, kept, at = data.split(), [], 0
        for a, b in found.tolist():
            kept += words[at:a]
            at = b
        kept += words[at:]
        return doc_id, len(words), b" ".join(kept).decode("utf-8", "surrogatepass"), [{"begin": a, "end": b} for a, b in found.tolist()]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, kept (the remaining words, joined by one space) and spans (the maximal repeats, in words) of every row.

    A word goes if a window of `window` words that covers it also starts in a
    document with a smaller doc_id. Null texts have no words; texts shorter
    than the window, rows with a null doc_id and empty tables lose nothing;
    rows that repeat a doc_id are not earlier than one another; other columns
    are ignored.
    """
    own = keyed(docs, id_col, text_col)
    return with_spans(own, dealt(own, WordSymbols(), window, gram), judge_words(window, gram), _Cut(), "doc_id long, n_words long, kept string, spans array<struct<begin: long, end: long>>")
