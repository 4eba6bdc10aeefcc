"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all fingerprints within half the radius of
it. Two fingerprints within the radius share such a variant, so a shuffle on
the variant brings every linked pair together. Those that meet at a variant
lie within half the radius of it: at radius 2 at most 65 distinct
fingerprints, all of them linked to each other, so a link of each to the
smallest one keeps the components whole without listing all pairs. Pairs are
deduplicated and their distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if, id_text, saved, small_batches, word_blocks
from .components import connected_components

BITS = 64
_WEIGHTS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    out = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def majority(set_bits: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes, as a signed 64-bit integer."""
    return int(_WEIGHTS[2 * set_bits > n].sum(dtype=np.uint64).astype(np.int64))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit integer; zero if it has no word."""
    from xxhash import xxh64_intdigest

    set_bits, n, tail, short = np.zeros(BITS, np.int64), 0, [], None
    for block in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + block
        tail = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            short = words
            continue
        grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
        h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, len(words) - width + 1)
        set_bits += ones(h)
        n += len(h)
    if not n:
        if not short:
            return 0
        return int(np.uint64(xxh64_intdigest(b" ".join(short), seed)).astype(np.int64))
    return majority(set_bits, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (signed 64-bit SimHash) of every row; null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = b.column(1)
            fps = [fingerprint(texts[k].as_py(), width, seed) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _variants(radius: int):
    """The fingerprints within half the radius of `fp`, as an array column."""
    masks = [0]
    for _ in range(radius // 2):
        masks = list(dict.fromkeys(chain(masks, (m ^ (1 << b) for m in masks for b in range(BITS)))))
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("fp").bitwiseXOR(m))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v) links between representatives, for distinct fingerprints (fp, rep); they join what the radius joins.

    Every link is a pair of fingerprints within `radius` of each other; all
    linked pairs of one variant hang on the smallest representative there.
    """
    if radius != 2:
        raise ValueError("members of a variant's ball are all linked to each other at radius 2 only")
    balls = fps.select("rep", "fp", F.explode(_variants(radius)).alias("variant"))
    here = Window.partitionBy("variant")
    met = balls.withColumn("least", F.min(F.struct("rep", "fp")).over(here)).where(F.col("least.rep") < F.col("rep"))
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= radius)
    return near.select(F.col("rep").alias("u"), F.col("least.rep").alias("v")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id reachable over fingerprints that differ
    in at most `radius` bits. Rows without a word have fingerprint zero and link
    like any other; repeated rows and ties share a component; a null doc_id
    stays null and takes the component of its fingerprint (null if no other row
    is there). Empty tables give empty results; other columns are ignored.
    """
    each = saved(fingerprints(docs, id_col, text_col))
    reps = each.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    found = connected_components(links(reps, radius))
    classes = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return each.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose doc_id names their component: one document of each group stays.

    Rows with a null doc_id stay; of rows that repeat a doc_id that stays, all do.
    """
    gone = broadcast_if(saved(near_duplicates(docs, radius, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()), 1_000_000)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
