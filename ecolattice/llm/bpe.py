"""BPE encoding and decoding over a pair occurrence index.

All distinct pieces (pre-tokenized words) that a partition holds are laid out
in one symbol array. An index maps every mergeable pair to all its positions;
active ranks are applied in ascending order, each to all its positions at
once, and only the lists of pairs that a merge creates are updated. A
document's ids are then gathered from its pieces.

Merge ranks only grow along a merge's descendants (checked when a vocabulary
is loaded), so applying ranks partition-wide in ascending order gives exactly
the merges that a word-by-word encoder makes.

Defined results: null and empty texts have no ids and decode to the empty
string; repeated rows each give a row; a null doc_id is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, ragged_take, small_batches

#: Characters of text, and distinct words, that one index covers at most (bounds a worker's memory).
CHUNK_CHARS, CHUNK_WORDS = 32_000_000, 700_000

# The piece pattern for text below U+0250, where Python's classes agree with the
# vocabulary's \p{L} and \p{N} once superscripts and fractions are set apart.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
_BEYOND = re.compile("[\x1c-\x1f]|[^\x00-ɏ]")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\x09-\x0d\x20\x85\xa0  -     　]+")


class _Numbers(dict):
    """Numbers keys in order of first appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairIndexBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self._normalize, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self._specials, key=len, reverse=True))) + ")") if self._specials else None
        self._chars = _byte_chars()
        self._inner = np.full(256, -1, np.int64)
        self._last = np.full(256, -1, np.int64)
        for c, b in self._chars.items():
            self._inner[b], self._last[b] = vocab.get(c, -1), vocab.get(c + end, -1)
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self._specials.items()}
        self._n = max(self.token) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._left = np.array([vocab[a] for a, _ in merges], np.int64)
        self._right = np.array([vocab[b] for _, b in merges], np.int64)
        self._new = np.array([vocab[a + b] for a, b in merges], np.int64)
        ranks = np.arange(len(merges))
        made = np.full(self._n, -1, np.int64)
        np.maximum.at(made, self._new, ranks)
        if (made[self._left] >= ranks).any() or (made[self._right] >= ranks).any():
            raise ValueError("a merge precedes the merge that makes its part")
        self._table()

    def _table(self) -> None:
        """Open addressing from pair keys to ranks, so that look-ups are array operations."""
        self._bits = max(4, int(np.ceil(np.log2(len(self._left) * 8 + 1))))
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._ranks = np.full(1 << self._bits, -1, np.int64)
        keys = self._left * self._n + self._right
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            s = slot[left]
            free = self._keys[s] == -1
            first = np.unique(s[free], return_index=True)[1]
            took = left[free][first]
            self._keys[slot[took]], self._ranks[slot[took]] = keys[took], took
            left = left[~np.isin(left, took)]
            slot[left] = (slot[left] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of every pair, -1 where there is none."""
        keys = a * self._n + b
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._ranks[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self._bits) - 1)
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def pieces(self, word: str) -> list[bytes | str]:
        """The pieces of a word without white space: UTF-8 bytes, or a special token's own string."""
        if "<|" in word and self._special and self._special.search(word):
            out: list[bytes | str] = []
            for part in self._special.split(word):
                out += [part] if part in self._specials else self.pieces(part) if part else []
            return out
        if not _BEYOND.search(word):
            if not word.isascii():
                word = unicodedata.normalize("NFC", word)
            return [p.encode() for p in _LATIN.findall(word.lower())]
        chars = self._chars
        return [bytes(chars[c] for c in p) for p, _ in self._split(self._normalize(word))]

    def words(self, text: str) -> list[str]:
        """The text's words; white space is what the vocabulary's normalizer takes for it."""
        if _SEPARATORS.search(text):
            return [w for w in _WHITE.split(text) if w]
        return text.split()

    def encode_pieces(self, pieces: list[bytes | str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, concatenated, and the offset of each."""
        special = np.array([self._specials.get(p, -1) if isinstance(p, str) else -1 for p in pieces], np.int64)
        raw = [b"\0" if isinstance(p, str) else p for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sym = self._inner[data]
        sym[ends - 1] = self._last[data[ends - 1]]
        if (special >= 0).any():
            sym[starts[special >= 0]] = special[special >= 0]
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[starts] = -1
        self._merge(sym, nxt, prv)
        alive = sym >= 0
        before = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive].astype(np.uint32), np.concatenate([before[starts], before[-1:]])

    def _merge(self, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> None:
        at = np.flatnonzero(nxt >= 0)
        rank = self._rank(sym[at], sym[nxt[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        index: dict[int, list[np.ndarray]] = {}
        self._put(index, at, rank)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b, new = self._left[r], self._right[r], self._new[r]
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            q = nxt[p]
            # A list may hold positions that a lower rank has used meanwhile.
            good = (sym[p] == a) & (q >= 0)
            good &= sym[np.where(q >= 0, q, 0)] == b
            p, q = p[good], q[good]
            if a == b and len(p) > 1:
                # Overlaps: of a run of touching pairs every other one merges, from the left.
                fresh = np.concatenate([[True], p[1:] != q[:-1]])
                run = np.flatnonzero(fresh)
                even = (np.arange(len(p)) - run[np.cumsum(fresh) - 1]) % 2 == 0
                p, q = p[even], q[even]
            if not len(p):
                continue
            after = nxt[q]
            sym[p], sym[q], nxt[p] = new, -1, after
            prv[after[after >= 0]] = p[after >= 0]
            before = prv[p]
            touched = np.unique(np.concatenate([before[before >= 0], p[after >= 0]]))
            if not len(touched):
                continue
            rank = self._rank(sym[touched], sym[nxt[touched]])
            use = rank >= 0
            if use.any():
                for k in self._put(index, touched[use], rank[use]):
                    heapq.heappush(active, k)

    @staticmethod
    def _put(index: dict[int, list[np.ndarray]], at: np.ndarray, rank: np.ndarray) -> list[int]:
        """Add ascending positions to the lists of their pairs; returns the ranks that were not active."""
        if not len(at):
            return []
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cut.tolist(), len(at)]
        fresh = []
        for k, r in enumerate(rank[np.concatenate([[0], cut])].tolist()):
            part = at[bounds[k] : bounds[k + 1]]
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                fresh.append(r)
        return fresh

    def chunk(self, docs: list[np.ndarray], words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each document, given by its words' numbers: its ids, and the ids that each word got."""
        number, flat, counts = _Numbers(), [], []
        for w in words:
            own = self.pieces(w)
            flat += map(number.__getitem__, own)
            counts.append(len(own))
        ids, offsets = self.encode_pieces(list(number)) if number else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        per_word, sizes = ragged_take(ids, offsets, np.array(flat, np.int64))
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        self.word_ids, self.word_ends = per_word, ends
        for d in docs:
            yield ragged_take(per_word, ends, d)

    def encode_all(self, rows: Iterator[tuple[int | None, str | None]]) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
        """(key, ids, numbers of the words in the current chunk) of every (key, text), chunk by chunk."""
        keys, docs, number, chars = [], [], _Numbers(), 0

        def done():
            for key, d, (ids, _) in zip(keys, docs, self.chunk(docs, list(number)), strict=True):
                yield key, ids, d

        for key, text in rows:
            w = self.words(text or "")
            keys.append(key)
            docs.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)).astype(np.int32))
            chars += len(text or "")
            if chars >= CHUNK_CHARS or len(number) >= CHUNK_WORDS:
                yield from done()
                keys, docs, number, chars = [], [], _Numbers(), 0
        if keys:
            yield from done()

    def word_strings(self) -> list[str]:
        """What each word of the current chunk decodes to."""
        token, ends = self.token, self.word_ends.tolist()
        strings = [token[i] for i in self.word_ids.tolist()]
        return [" ".join(strings[a:b]) for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: what a vocabulary without a decoder gives. Unknown ids are left out."""
        return " ".join(t for i in ids if (t := self.token.get(i)) is not None)


_LOADED: dict[str, PairIndexBPE] = {}


def loaded(path: str) -> PairIndexBPE:
    """The encoder for a vocabulary file, read once per process."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text, as the vocabulary's own library gives them."""
    small_batches(docs.sparkSession)

    def run(batches):
        for key, ids, _ in loaded(path).encode_all(rows_of(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every list of ids (null: empty text)."""
    small_batches(encoded.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode([i for i in x or [] if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian 32 bit) and of the text they decode to.

    Encoding and decoding share one pass, so neither ids nor texts leave the worker.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        bpe, out, strings, chunk = loaded(path), ([], [], [], []), None, None

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            for c in out:
                c.clear()
            return batch

        for key, ids, words in bpe.encode_all(rows_of(batches)):
            if chunk is not bpe.word_ids:
                chunk, strings = bpe.word_ids, bpe.word_strings()
            text = " ".join(filter(None, map(strings.__getitem__, words.tolist())))
            for c, v in zip(out, (key, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())):
                c.append(v)
            if len(out[0]) >= 2000:
                yield flush()
        if out[0]:
            yield flush()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
