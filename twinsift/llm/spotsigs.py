"""Document fingerprints by SpotSigs.

A spot is a common word (anchor); its signature is the anchor with the chain of
the next ``CHAIN`` content words. A text's fingerprint is the set of its distinct
signatures, written as sorted 32-bit hashes in hex. Likeness is the Jaccard
coefficient of two sets.

``near_classes`` finds near fingerprints over a corpus. Equal fingerprints are one
class first. Sets are partitioned by length so that two sets can reach the
threshold only if their partitions are equal or adjacent. Within a partition a set is
indexed under the first ``n - ceil(threshold n) + 1`` of its ``n`` signatures in an order
that all sets share: two sets that reach the threshold share one of these, so nothing is
lost, whatever the order. The order puts signatures of rare buckets first (``BUCKETS``
counts over all documents, a table of fixed size), so most of these keys belong to
one set alone and are dropped by a count. Sets that share a key are compared in
tiles, in the first key that they share only; a pair is given up before its Jaccard
coefficient is formed if the lengths, or what is left of either set behind that key,
cannot reach the threshold, or if their parity sketches (about a bit a signature) differ in more bits
than near sets can; whole sets travel only for the others.

Words are runs of letters, digits and underscores in lower case. A text without
any complete chain uses all chains of ``CHAIN`` consecutive words instead, a
shorter one its words, a text without words itself. Null text is the empty text;
its set is empty. Two empty sets have likeness 1, an empty and another one 0.
Repeated rows are rows of their own with equal fingerprints; an empty table gives
no rows. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.compressed import packed, unpack_text
from twinsift.llm.tiles import bucket_links, parity_sketch
from twinsift.operators.components import connected_components
from twinsift.operators.joins import join_counted
from twinsift.plans.storage import arrow_rows, materialize

CHAIN = 2
#: Near fingerprints reach this Jaccard coefficient.
THRESHOLD = 0.8
#: Length partitions span so many times the ratio of lengths that can reach the threshold.
SPAN = 4
#: Counts of signatures by a hash, from which the order of signatures is made; they travel in ``SLABS`` parts.
BUCKETS, SLABS = 1 << 18, 64
#: Common words of English, German, French and Spanish (a parameter of the method).
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf aus das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux dans du est et la le les par pas pour que qui sur un une "
    "como con de del el en es lo los las no por se su y".split()
)
_WORD = re.compile(r"\w+")


def signatures(text: str | None) -> frozenset[int]:
    text = text or ""
    words = _WORD.findall(text.lower())
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    out, at = set(), 0
    for i, w in enumerate(words):
        if at < len(content) and content[at] == i:
            at += 1
            continue
        chain = content[at : at + CHAIN]
        if len(chain) < CHAIN:
            break
        out.add(f"{w}:{':'.join([words[j] for j in chain])}")
    if not out:
        out = {" ".join(words[i : i + CHAIN]) for i in range(max(len(words) - CHAIN + 1, min(len(words), 1)))} or ({text} if text else set())
    return frozenset(xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) for s in out)


def written(signs: frozenset[int]) -> str:
    return _binary(signs).hex()


def length_partition(n: int, threshold: float) -> int:
    """Partition of a set of ``n``; sets further apart than one partition cannot reach the threshold.

    A partition spans ``SPAN`` times the ratio of lengths that can reach it, so most
    sets need their own partition only.
    """
    return 0 if n < 1 else int(math.log(n) / (-SPAN * math.log(threshold)) + 1e-9)


def partitions_of(n: int, threshold: float) -> list[int]:
    """The partitions that a set of ``n`` is sent to: any two sets that can reach the threshold share one."""
    own = length_partition(n, threshold)
    return [own] if length_partition(int(n / threshold + 1e-9), threshold) == own else [own, own + 1]


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """Jaccard coefficient."""
    if not a or not b:
        return float(not a and not b)
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by the first as many of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def with_next(df: DataFrame, near: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows laid out so that each one's successor in descending id order is the next row of its partition.

    Ids are dealt into ranges of about equal count (quantiles of the ids; as many
    as shuffle partitions), one range a partition. A range's successor row, the
    first of the range below (after the last: the first of all), is copied to its
    end and marked ``copy``. So each text is shuffled once, compressed, besides one
    copy a range. Null ids come last; equal ids are ordered by their compressed
    texts. The rows of ``near`` stand before the texts of their id.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"))
    ids = rows.select("k")
    cuts = sorted({int(x) for x in ids.approxQuantile("k", [i / parts for i in range(1, parts)], 1 / (20 * parts))}) if parts > 1 else []

    @F.arrow_udf("int")
    def range_of(k):
        import pyarrow as pa

        return pa.array(np.searchsorted(np.array(cuts, np.int64), k.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    firsts = sorted(((r["part"], r["first"]) for r in ids.withColumn("part", range_of("k")).groupBy("part").agg(F.max("k").alias("first")).collect()), reverse=True)
    after = {firsts[(i + 1) % len(firsts)][1]: part for i, (part, _) in enumerate(firsts)}
    nothing = {"digest": F.lit(None).cast("binary"), "near_class": F.lit(None).cast("long"), "n_near": F.lit(None).cast("long")}
    rows = rows.withColumns({"text": packed(F.col("text")), **nothing})
    dealt = rows.withColumns({"part": range_of("k"), "copy": F.lit(0)})
    if after:
        # at most one row a range
        wanted = spark.createDataFrame(list(after.items()), "k long, part int")
        dealt = dealt.unionByName(rows.join(F.broadcast(wanted), "k").withColumn("copy", F.lit(1)))
    marks = near.withColumns({"k": F.col("doc_id"), "text": F.lit(None).cast("binary"), "part": range_of("doc_id"), "copy": F.lit(0)})
    return dealt.unionByName(marks).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "copy", F.desc("k"), F.col("digest").isNull(), "text")


def _digest(fingerprint: bytes) -> bytes:
    return hashlib.blake2b(fingerprint, digest_size=16).digest()


def _binary(signs: frozenset[int]) -> bytes:
    return np.sort(np.fromiter(signs, dtype=">u4", count=len(signs))).tobytes()


def _prints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [_binary(signatures(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())], ["doc_id", "digest", "payload"])


def _counted(batches: Iterator) -> Iterator:
    """How many signatures fall into each bucket, in slabs."""
    import pyarrow as pa

    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4")
        counts += np.bincount(signs & (BUCKETS - 1), minlength=BUCKETS)
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in np.split(counts, SLABS)])], ["slab", "counts"])


def _summed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}  # at most SLABS arrays of a fixed size
    for batch in batches:
        for slab, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[slab] = sums.get(slab, 0) + np.frombuffer(zstandard.decompress(data), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slab", "counts"])


def signature_order(payloads: DataFrame) -> np.ndarray:
    """Rank of each bucket of signatures, rare buckets first; bounded by ``BUCKETS`` whatever the corpus."""
    slabs = payloads.mapInArrow(_counted, "slab int, counts binary").repartition("slab").mapInArrow(_summed, "slab int, counts binary")
    counts = np.zeros((SLABS, BUCKETS // SLABS), np.int64)
    for r in slabs.collect():
        counts[r["slab"]] = np.frombuffer(r["counts"], np.int64)
    # steps of a logarithm; equal ranks are told apart by the signature itself
    return np.minimum(np.log2(1.0 + counts.ravel()) * 65536, (1 << 22) - 1).astype(np.int64)


def prefix_keys(signs: np.ndarray, ranks: np.ndarray, threshold: float) -> np.ndarray:
    """The signatures that a set is indexed under, in order, as ``rank << 32 | signature``."""
    keys = np.sort(ranks[signs & (BUCKETS - 1)] << 32 | signs)
    return keys[: len(keys) - math.ceil(threshold * len(keys) - 1e-9) + 1]


def _sent(threshold: float, ranks):
    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            reps, sizes, copies, buckets, left = [], [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for rep, many, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                signs = np.frombuffer(data, ">u4").astype(np.int64)
                if not len(signs):
                    continue
                keys = prefix_keys(signs, ranks.value, threshold)
                for part in partitions_of(len(signs), threshold):
                    buckets.append(keys | part << 54)
                    left.append(len(signs) - np.arange(len(keys)))
                    reps += [rep] * len(keys)
                    sizes += [len(signs)] * len(keys)
                    copies += [many] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(copies, pa.int64()), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(left).astype(np.int32))],
                ["rep", "size", "copies", "bucket", "left"],
            )

    return send


def _sketches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        sketches = [parity_sketch(np.frombuffer(x, ">u4").astype(np.int64)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.binary())], ["doc_id", "payload"])


def near_classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, digest, near_class, n_near)`` of every id and fingerprint; rows with a null id have none.

    ``near_class`` is the smallest id of the component of fingerprints that reach the
    threshold, ``n_near`` the number of other rows whose fingerprints reach it. Rows of
    one id with different fingerprints are told apart by ``digest``, but in a bucket
    the id stands for the least of them.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    usable = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    prints = materialize(usable.mapInArrow(_prints, "doc_id long, digest binary, payload binary"), "prints")
    classes = materialize(prints.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    ranks = spark.sparkContext.broadcast(signature_order(prints.select("payload")))
    own = prints.withColumnRenamed("doc_id", "rep").join(classes.hint("merge"), ["rep", "digest"]).dropDuplicates(["rep", "digest"])
    spread = materialize(own.select("rep", "copies", "payload").mapInArrow(_sent(threshold, ranks), "rep long, size int, copies long, bucket long, left int"), "spread")
    linked = bucket_links(spread, prints.select("doc_id", "payload"), lambda payload: np.frombuffer(payload, ">u4").astype(np.int64), threshold, sketches=prints.mapInArrow(_sketches, "doc_id long, payload binary"))
    labels = connected_components(linked, "doc_id", "root").select(F.col("id").alias("rep"), "component")
    links = linked.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    known = materialize(classes.join(labels, "rep", "left").join(links, "rep", "left"), "known")
    ids = prints.select("doc_id", "digest").distinct()
    return join_counted(ids, known, ["digest"], ["doc_id"], "copies").select(
        "doc_id", "digest", F.coalesce("component", "rep").alias("near_class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_near")
    )


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held = None  # id, text, signatures, range and near class of the row that waits for its successor
    known: tuple = (None, {})  # near classes of the present id by digest

    def row(doc, text, signs, known_near, following, next_signs):
        new = edited(text, following)
        new_signs = signatures(new)
        near = known_near if known_near else (doc, 0)
        return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(signs), written(new_signs), likeness(signs, new_signs), likeness(signs, next_signs), *near

    for batch in batches:
        out = []
        names = ("doc_id", "text", "part", "copy", "digest", "near_class", "n_near")
        for doc, data, part, copy, digest, near_class, n_near in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if digest is not None:
                if known[0] != doc:
                    known = (doc, {})
                known[1][digest] = (near_class, n_near)
                continue
            text = "" if data is None else unpack_text(data)
            signs = signatures(text)
            if held and held[4] == part:
                out.append(row(*held[:4], text, signs))
            near = known[1].get(_digest(_binary(signs))) if known[0] == doc else None
            held = None if copy else (doc, text, signs, near, part)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        columns = zip(*out, strict=True) if out else [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_class", "n_near"])


def fingerprint_chain(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses to the edited and to the next text, and the near class in the corpus.

    Rows with a null id are compared with their edited and next text, but are a class of their own.
    """
    arrow_rows(df.sparkSession)
    near = near_classes(df, text_col, id_col, threshold)
    return with_next(df, near, text_col, id_col).mapInArrow(_fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long, n_near long")
