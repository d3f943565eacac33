"""Cross-tokenizer alignment of a byte-level BPE (A) and a SentencePiece model (B).

A encodes a space and the text, B the text, before which it puts a space itself, so
both cover the same bytes. Byte offsets where a token of A and one of B end cut a
text into groups; a link is a pair of occurrences, one of A and one of B, in one
group. The count of an id pair is the number of documents that hold it linked.

Plan
1. Each Arrow batch is aligned as a whole, in slices of about ``SLICE_BYTES``: the
   bytes of its documents stand one behind the other, token ends of A and of B are
   counted by ``bincount`` once, and offsets that both counts hold are cuts, the ends
   of documents among them. Prefix sums over the cuts give tokens by group, and those
   over the documents' cuts give results by document. What leaves the
   pass is a row a document, and a row for each id pair of the slice with the
   documents that hold it and their links, packed. So the corpus's commonest pair
   makes one row a slice.
2. Counts of pairs are sums of these rows, combined before the shuffle. The highest
   count of each id of A has a row for each entry of the vocabulary, so it is
   broadcast whatever the corpus.
3. Rows of pairs are joined with their counts (``join_counted`` deals hot pairs into
   parts), go back to their slice, and are summed by document there. A slice holds as
   many pairs as its bytes allow, whatever the corpus.

A null or empty text, and one that either tokenizer does not give back byte by byte,
has no tokens: zeros and an empty ``groups_sha256``. Strings of special tokens in
texts are ordinary text. A row is a document: repeated rows and rows with the same
or a null id count for themselves. Very long texts are a slice of their own, whose
ends are counted in windows of ``SLICE_BYTES``. An empty table gives no rows; only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm import bpe, pieces
from twinsift.operators.joins import join_counted
from twinsift.plans.storage import arrow_rows, materialize

SLICE_BYTES = 4 << 20
#: Groups with more links than this are multiplied by distinct ids instead of by occurrences.
LARGE_GROUP = 256
_DOC = "slice string, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIR = "a int, b int, holders int, slots binary, links binary"


class Aligner:
    """Both tokenizers with the bytes of their tokens, built once per Python worker."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = bpe.codec(a_path, pattern), pieces.pieces(b_path)
        self.a_bytes = self.a.tokens
        own = self.b.library
        self.b_bytes = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) else p.replace(pieces.MARK, " ").encode() for i, p in enumerate(self.b.pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # each id written with what may stand behind it
        self.written = [b"%d," % i for i in range(len(self.a_bytes))] + [b"%d|" % i for i in range(len(self.a_bytes))]
        self.written += [b"%d," % i for i in range(len(self.b_bytes))] + [b"%d;" % i for i in range(len(self.b_bytes))]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of both tokenizers and the number of bytes; none if bytes differ."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), 0
        if not text:
            return none
        data = f" {text}".encode("utf-8", "surrogatepass")
        a, b = self.a.ordinary(f" {text}"), self.b.ids(text).tolist()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return none
        return np.array(a, np.int64), np.array(b, np.int64), len(data)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    return Aligner(a_path, b_path, pattern)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, total: int) -> np.ndarray:
    """Offsets up to ``total`` at which a token of either side ends, by counts in windows."""
    cuts = []
    for low in range(0, total + 1, SLICE_BYTES):
        size = min(SLICE_BYTES, total + 1 - low)
        here = [np.bincount(e[np.searchsorted(e, low) : np.searchsorted(e, low + size)] - low, minlength=size) for e in (ends_a, ends_b)]
        cuts.append(np.flatnonzero((here[0] > 0) & (here[1] > 0)) + low)
    return np.concatenate(cuts)


def group_links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(group, id of A, id of B, links)`` of all groups; ``na`` and ``nb`` are the groups' tokens, in order.

    Links of a pair may be spread over several entries. In a large group each distinct
    id stands once with its occurrences, so that no group makes more entries than its
    distinct ids allow.
    """
    group = np.arange(len(na))
    large = np.repeat(na * nb > LARGE_GROUP, na), np.repeat(na * nb > LARGE_GROUP, nb)
    sides = []
    for ids, n, big in ((a, na, large[0]), (b, nb, large[1])):
        of, many = np.repeat(group, n), np.ones(len(ids), np.int64)
        if big.any():
            keys, seen = np.unique(np.stack([of[big], ids[big]]), axis=1, return_counts=True)
            of, ids, many = np.concatenate([of[~big], keys[0]]), np.concatenate([ids[~big], keys[1]]), np.concatenate([many[~big], seen])
            order = np.argsort(of, kind="stable")
            of, ids, many = of[order], ids[order], many[order]
        sides.append((of, ids, many, np.bincount(of, minlength=len(na))))
    (of, ids_a, many_a, _), (_, ids_b, many_b, right) = sides
    # each entry of A meets all entries of B in its group
    times, first = right[of], np.cumsum(right) - right
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[of], times)
    left = np.repeat(np.arange(len(of)), times)
    return of[left], ids_a[left], ids_b[at], many_a[left] * many_b[at]


def align_slice(own: Aligner, texts: list[str | None]) -> tuple[list[tuple], tuple[np.ndarray, ...]]:
    """Per text ``(n_a, n_b, n_groups, n_links, groups_sha256)``; and ``(id of A, id of B, slot, links)`` of the slice's pairs, ordered."""
    both = [own.tokens(t) for t in texts]
    a, b = (np.concatenate([x[i] for x in both]) if both else np.empty(0, np.int64) for i in (0, 1))
    ends = np.cumsum([x[2] for x in both])
    ends_a, ends_b = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
    cuts = common_ends(ends_a, ends_b, int(ends[-1]) if len(both) else 0)
    upto_a, upto_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
    na, nb = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    links = np.concatenate([[0], np.cumsum(na * nb)])
    last = np.searchsorted(cuts, ends, "right")  # groups up to each document's end
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)

    # the written groups: tokens of A and of B take turns by group
    codes = np.empty(len(a) + len(b), np.int64)
    before_a, before_b = np.repeat(upto_b - nb, na), np.repeat(upto_a, nb)
    closing_a, closing_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    closing_a[upto_a - 1], closing_b[upto_b - 1] = True, True
    codes[np.arange(len(a)) + before_a] = a + np.where(closing_a, len(own.a_bytes), 0)
    codes[np.arange(len(b)) + before_b] = b + 2 * len(own.a_bytes) + np.where(closing_b, len(own.b_bytes), 0)
    docs, start = [], 0
    for (ids_a, ids_b, _), lo, hi in zip(both, first, last, strict=True):
        size = len(ids_a) + len(ids_b)
        digest = ""
        if size:
            hashed, stop = hashlib.sha256(), start + size
            for at in range(start, stop, 1 << 16):
                part = b"".join(map(own.written.__getitem__, codes[at : min(at + (1 << 16), stop)].tolist()))
                hashed.update(part[:-1] if at + (1 << 16) >= stop else part)
            digest, start = hashed.hexdigest(), stop
        docs.append((len(ids_a), len(ids_b), int(hi - lo), int(links[hi] - links[lo]), digest))

    slot_of = np.repeat(np.arange(len(both)), last - first)
    n_slots, n_b = max(1, len(both)), len(own.b_bytes)
    found = []
    # blocks of groups bound the memory that their links take
    edges = [0]
    while edges[-1] < len(cuts):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(links, links[edges[-1]] + (1 << 21), "right")) - 1))
    for lo, hi in zip(edges, edges[1:], strict=False):
        of, ia, ib, many = group_links(a[upto_a[lo] - na[lo] : upto_a[hi - 1]], b[upto_b[lo] - nb[lo] : upto_b[hi - 1]], na[lo:hi], nb[lo:hi])
        found.append(_summed((ia * n_b + ib) * n_slots + slot_of[lo:hi][of], many))
    keys, many = _summed(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.empty(0, np.int64),) * 2
    pair, slot = keys // n_slots, keys % n_slots
    return docs, (pair // n_b, pair % n_b, slot, many)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(weights, starts) if len(keys) else weights


def _aligned(a_path: str, b_path: str, pattern: str):
    def align(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = aligner(a_path, b_path, pattern)
        for batch in batches:
            ids, texts, start = batch.column(0), batch.column(1), 0
            sizes = np.cumsum([len(t.as_py() or "") + 1 for t in texts])
            while start < len(texts):
                room = (sizes[start - 1] if start else 0) + SLICE_BYTES
                stop = max(start + 1, int(np.searchsorted(sizes, room, "right")))
                docs, (a, b, slot, links) = align_slice(own, texts[start:stop].to_pylist())
                name, n = uuid.uuid4().hex, stop - start
                none = lambda kind, k: pa.nulls(k, kind)
                columns = [pa.array(c, k) for c, k in zip(zip(*docs, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(n), pa.int32()), ids[start:stop], *columns, *(none(k, n) for k in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    [c.split()[0] for c in f"{_DOC}, {_PAIR}".split(", ")],
                )
                firsts = np.flatnonzero(np.diff(a, prepend=-1) | np.diff(b, prepend=-1))
                for lo in range(0, len(firsts), 20_000):
                    at = firsts[lo : lo + 20_000]
                    end = firsts[lo + 20_000] if lo + 20_000 < len(firsts) else len(a)
                    holders = np.diff(np.append(at, end))
                    offsets = pa.array(np.append(at, end) - at[0], pa.int32())
                    packed = [pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.array((4 * offsets.to_numpy()).astype(np.int32)).buffers()[1], pa.py_buffer(x[at[0] : end].astype("<i4").tobytes())]) for x in (slot, links)]
                    k = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * k), none(pa.int32(), k), none(pa.int64(), k), *(none(pa.int64(), k) for _ in range(4)), none(pa.string(), k), pa.array(a[at], pa.int32()), pa.array(b[at], pa.int32()), pa.array(holders, pa.int32()), *packed],
                        [c.split()[0] for c in f"{_DOC}, {_PAIR}".split(", ")],
                    )
                start = stop

    return align


def _by_slot(batches: Iterator) -> Iterator:
    """Sums by document; rows of a slice come one behind the other."""
    import pyarrow as pa

    def batch_of(name, slots, best, counted):
        seen = np.flatnonzero(counted)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(slots[seen], pa.int32()), pa.array(best[seen], pa.int64()), pa.array(counted[seen], pa.int64())], ["slice", "slot", "n_best", "count_sum"])

    now, best, counted = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        names = batch.column(0).to_pylist()
        edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if names[lo] != now:
                if now is not None:
                    yield batch_of(now, np.arange(len(best)), best, counted)
                now, best, counted = names[lo], np.zeros(0, np.int64), np.zeros(0, np.int64)
            n, is_best, slots, links = (batch.column(i)[lo:hi] for i in range(1, 5))
            at = np.frombuffer(b"".join(slots.to_pylist()), "<i4")
            many = np.frombuffer(b"".join(links.to_pylist()), "<i4").astype(np.int64)
            times = np.array([len(x) // 4 for x in slots.to_pylist()])
            if int(at.max()) >= len(best):
                best, counted = (np.concatenate([x, np.zeros(int(at.max()) + 1 - len(x), np.int64)]) for x in (best, counted))
            np.add.at(best, at, many * np.repeat(is_best.to_numpy(zero_copy_only=False).astype(np.int64), times))
            np.add.at(counted, at, many * np.repeat(n.to_numpy(zero_copy_only=False), times))
    if now is not None:
        yield batch_of(now, np.arange(len(best)), best, counted)


def aligned(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id", pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``: both stored, the columns of ``_DOC``, and those of ``_PAIR`` with their ``slice``."""
    arrow_rows(df.sparkSession, 2000)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = materialize(rows.mapInArrow(_aligned(a_path, b_path, pattern or bpe.default_pattern()), f"{_DOC}, {_PAIR}"), "aligned")
    docs = stored.where("slot IS NOT NULL").select(*[c.split()[0] for c in _DOC.split(", ")])
    return docs, stored.where("a IS NOT NULL").select("slice", *[c.split()[0] for c in _PAIR.split(", ")])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(a, b, n, parts, best)``: documents that hold the pair, its rows in ``pairs``, and whether ``n`` is the highest of its id of A."""
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("holders").alias("n"), F.count("*").alias("rows")), "counts")
    # a row for each id of A: no more than the vocabulary has
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "n", "rows", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id", pattern: str | None = None) -> DataFrame:
    """Tokens, groups and links of every document, with its best links and the sum of the counts of its links."""
    docs, pairs = aligned(df, a_path, b_path, text_col, id_col, pattern)
    counts = materialize(pair_counts(pairs), "pair_counts")
    known = join_counted(pairs, counts, ["a", "b"], ["slice"], "rows").select("slice", "n", "best", "slots", "links")
    sums = known.repartition("slice").sortWithinPartitions("slice").mapInArrow(_by_slot, "slice string, slot int, n_best long, count_sum long")
    return docs.join(sums.hint("merge"), ["slice", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256"
    )
