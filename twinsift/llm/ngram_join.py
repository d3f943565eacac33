"""N-gram Jaccard join: MinHash banding with exact verification.

Texts are lower-cased word sequences (runs of letters, digits and underscores);
their n-gram sets hold all runs of ``NGRAM`` words, or the whole sequence if it is
shorter. Two texts are linked if the Jaccard coefficient of their sets reaches
``THRESHOLD``. ``choose_bands`` finds the number of bands and rows for a target
recall at the threshold.

Plan
1. One pass over the texts gives per document a 128-bit digest of its word
   sequence and its band hashes. Documents with the same word sequence form a
   copy class, represented by the smallest id; only representatives go on, so
   exact copies never meet as pairs.
2. Representatives are shuffled on band hashes. Buckets of one are dropped, and
   of buckets with the same members all but one.
3. The representatives left are joined with their texts, and each bucket is
   verified on the full n-gram sets. A bucket of more than ``BLOCK`` texts (or
   ``BLOCK_SIZE`` words) is dealt by hash into blocks, and every pair of blocks is
   a tile of its own, so no bucket is collected whole. A pair that shares several
   buckets is verified in the first one only. What leaves a tile is one row per
   text: its number of links and its root in the tile's forest of links.
   Texts travel compressed.
4. Components over these roots give the classes.

Result per row: ``doc_id``, ``class_id`` (smallest id of the connected component
of links) and ``n_links``, the number of other documents linked to it, copies
included. Documents whose texts hold no word are copies only if their texts are
equal. Null texts and null ids have no links and the row's own id as class.
Repeated rows are documents of the same class; so are rows of one id with different
texts only if the texts are near, and in a tile the id stands for the least of its
texts. ``keep_one`` keeps the least text of an id. An empty table gives no rows;
only the named columns are read, so other columns may have any name.

The work in a bucket of N different texts grows with the square of N, as each
pair of different texts is verified; rows shuffled grow with N * N / BLOCK. Rows of
a bucket or copy class that very many documents share are dealt into parts when
they are joined (``join_counted``).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.compressed import packed, unpack_text, unpacked
from twinsift.llm.tiles import BLOCK, bucket_links
from twinsift.operators.components import connected_components
from twinsift.operators.joins import join_counted
from twinsift.plans.storage import arrow_rows, materialize

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = "doc_id long, hi long, lo long, words int, bands array<long>"


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band for which pairs at the threshold are found with ``recall``."""
    best = (max_hashes, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], n: int = NGRAM) -> np.ndarray:
    """64-bit hashes of all n-grams, with repeats."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MIX + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One signed 64-bit hash per band of the MinHash signature."""
    pick = np.random.default_rng(seed)
    a = (pick.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
    b = pick.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[None, :]
    x, low = (grams >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(x), 2048):
        part = (x[at : at + 2048, None] * a + b).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    out = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _sketches(bands: int, rows: int, ngram: int):
    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            digests, counts, hashes = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                # a text without words stands for itself
                whole = " ".join(words) if words else f"\n{text}"
                digests.append(hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                counts.append(len(words))
                hashes.append(band_hashes(shingles(words, ngram), bands, rows).tolist() if words else [])
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(counts, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                ["doc_id", "hi", "lo", "words", "bands"],
            )

    return sketch


def _grams_of(ngram: int):
    return lambda data: np.unique(shingles(words_of(unpack_text(data)), ngram))


def near_duplicate_classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, ngram: int = NGRAM, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(doc_id, class_id, n_links)`` of every row."""
    arrow_rows(df.sparkSession, 500)
    bands, rows = choose_bands(threshold, recall)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    usable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    sketch = materialize(usable.mapInArrow(_sketches(bands, rows, ngram), _SKETCH), "sketch")
    classes = materialize(sketch.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("words").alias("words"), F.first("bands").alias("bands")), "classes")

    spread = classes.select("rep", "words", "copies", F.posexplode("bands").alias("band", "hash")).select("rep", F.col("words").alias("size"), "copies", F.xxhash64("band", "hash").alias("bucket"))
    data = usable.select("doc_id", packed(F.col("text")).alias("payload"))
    linked = bucket_links(spread, data, _grams_of(ngram), threshold, block)

    labels = connected_components(linked, "doc_id", "root").select(F.col("id").alias("rep"), "component")
    counts = linked.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    known = materialize(classes.select("hi", "lo", "rep", "copies").join(labels, "rep", "left").join(counts, "rep", "left"), "known")
    found = join_counted(sketch.select("doc_id", "hi", "lo"), known, ["hi", "lo"], ["doc_id"], "copies").select(
        "doc_id", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    alone = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that represent their class; rows with a null id stay, repeated rows stay once."""
    classes = near_duplicate_classes(df, text_col, id_col, **options)
    keep = classes.where("doc_id = class_id").select(F.col("doc_id").alias(id_col)).distinct()
    data = df.withColumn(text_col, packed(F.col(text_col)))
    rest = [c for c in df.columns if c != id_col]
    least = F.struct(text_col, F.to_json(F.struct(*[c for c in rest if c != text_col])) if len(rest) > 1 else F.lit(0))
    one = data.join(keep.hint("merge"), id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*rest), least).alias("_one")).select(id_col, "_one.*").select(*df.columns)
    return one.withColumn(text_col, unpacked(F.col(text_col))).unionByName(df.where(F.col(id_col).isNull()))
