"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over
fixed-length windows and classified by a softmax. Training runs on the driver
over a bounded sample of labelled windows; whole texts are then classified in
batches of windows, and a text's windows vote with their logits.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, id_text, saved, small_batches

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: Labelled documents of each language that are learned from, about, and windows of each, spread over its text.
DOCS_PER_LANG, WINDOWS_PER_DOC = 1000, 4
EPOCHS, BATCH, RATE = 4, 64, 3e-3


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L."""
    return any(unicodedata.category(c)[0] == "L" for c in text)


@dataclass
class ByteCNN:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    out_bias: np.ndarray
    _tables: list = field(default_factory=list, repr=False)

    @staticmethod
    def fresh(langs: list[str], seed: int = 1) -> ByteCNN:
        rnd = np.random.default_rng(seed)
        normal = lambda *s: rnd.normal(0, 1, s).astype(np.float32)
        total = len(WIDTHS) * FILTERS
        return ByteCNN(langs, normal(256, EMBED) * 0.5, [normal(w * EMBED, FILTERS) * (2 / (w * EMBED)) ** 0.5 for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(total, len(langs)) * (1 / total) ** 0.5, np.zeros(len(langs), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.weights, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of windows x (n, WINDOW) with labels y, and its gradients."""
        n = len(x)
        e = self.embed[x]
        pooled, at, seen = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
            a = view @ f
            k = a.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(a, k[:, None], 1)[:, 0] + b, 0))
            at.append(k)
            seen.append(view)
        h = np.concatenate(pooled, 1)
        z = h @ self.weights + self.out_bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.weights.T) * (h > 0)
        de, df, db = np.zeros_like(self.embed), [], []
        rows = np.arange(n)[:, None]
        for j, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            inputs = seen[j][rows, at[j]]
            df.append(np.einsum("nfi,nf->if", inputs, d))
            db.append(d.sum(0))
            back = (d[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBED)
            bytes_ = x[rows[:, :, None], at[j][:, :, None] + np.arange(w)]
            np.add.at(de, bytes_.reshape(-1), back.reshape(-1, EMBED))
        return loss, [de, *df, *db, h.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 1) -> ByteCNN:
        """Adam over shuffled batches."""
        rnd = np.random.default_rng(seed)
        params = self.parameters()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rnd.permutation(len(x))
            for k in range(0, len(x), BATCH):
                _, grads = self.gradients(x[order[k : k + BATCH]], y[order[k : k + BATCH]])
                t += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def logits(self, data: np.ndarray) -> np.ndarray:
        """Logits of consecutive windows; data: bytes, a multiple of WINDOW long.

        A convolution over bytes is a sum of table look-ups: byte pairs (and
        the odd last byte) index precomputed responses.
        """
        if not self._tables:
            for w, f, b in zip(WIDTHS, self.filters, self.bias):
                one = [self.embed @ f[k * EMBED : (k + 1) * EMBED] for k in range(w)]
                one[0] = one[0] + b
                pairs = [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
                self._tables.append((w, pairs, one[-1] if w % 2 else None))
        out = np.empty((len(data) // WINDOW, len(self.langs)), np.float32)
        step = 64
        for k in range(0, len(out), step):
            part = data[k * WINDOW : (k + step) * WINDOW].reshape(-1, WINDOW).astype(np.int64)
            pair = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for w, pairs, last in self._tables:
                n = WINDOW - w + 1
                a = pairs[0].take(pair[:, :n], 0)
                for j in range(1, len(pairs)):
                    a += pairs[j].take(pair[:, 2 * j : 2 * j + n], 0)
                if last is not None:
                    a += last.take(part[:, w - 1 : w - 1 + n], 0)
                pooled.append(a.max(1))
            out[k : k + step] = np.maximum(np.concatenate(pooled, 1), 0) @ self.weights + self.out_bias
        return out


def windows_of(text: str) -> np.ndarray:
    """The text's bytes, lower-cased, zero-padded to whole windows; at least one."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([data, np.zeros(-len(data) % WINDOW if len(data) else WINDOW, np.uint8)])


def learned_from(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the row may be learned from; the others (and null ids) are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != fold, F.lit(False))


def train(docs: DataFrame, seed: int = 1) -> ByteCNN | None:
    """A network for the languages of the labelled rows outside the held-out fold; None if there are none.

    docs: doc_id, text, lang. About DOCS_PER_LANG documents of each language,
    whose ids' hashes fall under the language's threshold; only those leave the JVM.
    """
    known = docs.where(learned_from()).where("lang is not null and text is not null")
    counts = saved(known.groupBy("lang").count())
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    if not langs:
        return None
    picked = known.join(broadcast_if(counts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("count")) < DOCS_PER_LANG).select("doc_id", "lang", "text").distinct()

    def cut(batches):
        for b in batches:
            for i, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                all_ = windows_of(text.as_py()).reshape(-1, WINDOW)
                spread = all_[np.unique(np.linspace(0, len(all_) - 1, WINDOWS_PER_DOC).astype(int))]
                yield pa.RecordBatch.from_pydict({"_id": [i], "lang": [lang], "w": [spread.tobytes()]})

    rows = sorted(picked.mapInArrow(cut, "_id long, lang string, w binary").collect(), key=lambda r: (r["_id"], r["lang"], r["w"]))
    x = [np.frombuffer(r["w"], np.uint8).reshape(-1, WINDOW) for r in rows]
    y = np.repeat([langs.index(r["lang"]) for r in rows], [len(a) for a in x])
    return ByteCNN.fresh(langs, seed).fit(np.concatenate(x), y, seed)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the network's probability of lang_pred) of every row.

    Null texts and texts without a letter are `und` with score 0, and so is
    everything if no row can be learned from. Repeated rows and null ids are
    kept; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(id_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).withColumn("lang", F.lit(None)) if lang_col not in docs.columns else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for b in batches:
            texts, names, scores, some = b.column(1), [], [], []

            def flush():
                z = net.logits(np.concatenate([d for d, _ in some]))
                at = 0
                for d, slot in some:
                    own = z[at : at + len(d) // WINDOW]
                    # A window counts by the share of it that is text.
                    full = np.count_nonzero(d.reshape(-1, WINDOW), axis=1) / WINDOW
                    total = full @ own / full.sum()
                    p = np.exp(total - total.max())
                    p /= p.sum()
                    names[slot], scores[slot] = net.langs[int(p.argmax())], float(p.max())
                    at += len(own)
                some.clear()

            size = 0
            for k in range(len(texts)):
                text = texts[k].as_py()
                names.append("und")
                scores.append(0.0)
                if net is not None and text and has_letter(text):
                    some.append((windows_of(text), k))
                    size += len(some[-1][0])
                    if size > 1 << 20:
                        flush()
                        size = 0
            if some:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (~learned_from()).alias("held_out"), "lang_pred", "score")
