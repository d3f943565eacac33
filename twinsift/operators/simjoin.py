"""Blocked Hamming joins.

For radius r, cut the bits into m segments and let e = floor(r / m). Two words
within r differ by more than e bits in at most floor(r / (e + 1)) segments, so
whichever ``need`` = floor(r / (e + 1)) + 1 segments a row is indexed by, one of them
matches. An index row takes its rarest segments (``choose``): values that very many
rows share are avoided where m leaves a choice. The other side probes with all its
segments and, for e = 1, their one-bit neighbours. A pair is kept in the first
matching segment of the index row only, so no ``distinct`` follows.

Values that stay hot are dealt into pairs of blocks (``join_tiled``), so no task
takes all rows of a segment value, though every two rows that share a chosen one are
compared. Rows with the same bits are one class in the joins of words and videos, so a value that a third of
all rows share is one row there. ``hamming_classes`` and ``video_classes`` give the pairs of classes and
each member's representative, dealt over tasks; ``hamming_pairs`` and ``video_pairs`` expand them to the pairs of
all rows, equal ones too (``member_pairs``). Only ``hamming_pairs_wide`` joins every row that it gets.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming, hamming_words, segment_widths, segments
from twinsift.functions.gates import FRAMES, VIDEO_WINDOW_MS
from twinsift.operators.blocks import member_pairs, near_in_window
from twinsift.operators.joins import hot_counts, join_counted, join_tiled
from twinsift.operators.wide import wide_pairs
from twinsift.plans.storage import materialize


#: Most segment values that are told apart as hot when rows choose, and the rows that make one hot.
CHOICE_KEYS, CHOICE_ROWS = 2_000, 1_000


class Blocking(NamedTuple):
    """How a signature is cut into segments for a radius; ``cut`` and ``distance`` take columns."""

    cut: Callable[[str], list[Column]]
    distance: Callable[[str, str], Column]
    widths: list[int]
    radius: int

    @property
    def inner(self) -> int:
        """Bits that may differ in a matching segment."""
        return self.radius // len(self.widths)

    @property
    def need(self) -> int:
        """Segments that a row must be indexed by; one of them matches."""
        return self.radius // (self.inner + 1) + 1


def _checked(blocking: Blocking) -> Blocking:
    if blocking.inner > 1:
        raise ValueError("use more segments: at most one bit may differ within a segment")
    return blocking


def words(radius: int, bits: int = 64, parts: int | None = None) -> Blocking:
    """Blocking of one word of ``bits`` bits, by default in one segment more than the radius."""
    parts = parts or radius + 1
    return _checked(Blocking(lambda c: segments(c, parts, bits), hamming, segment_widths(bits, parts), radius))


def word_arrays(radius: int, count: int = 4, segment_bits: int = 16) -> Blocking:
    """Blocking of arrays of ``count`` 64-bit words in segments of ``segment_bits`` bits."""
    per = 64 // segment_bits
    cut = lambda c: [s for i in range(count) for s in segments(F.get(F.col(c), F.lit(i)), per)]
    return _checked(Blocking(cut, hamming_words, [segment_bits] * (count * per), radius))


def choose(rows: DataFrame, blocking: Blocking, word: str = "w", hot_keys: int = CHOICE_KEYS, hot_rows: int = CHOICE_ROWS) -> Column:
    """Array of the numbers of a row's ``need`` rarest segments, ascending.

    Only hot values need to be known: they are counted, told apart by the power of
    four in their counts, and put into the expression (at most ``hot_keys`` numbers), so
    that no row is shuffled to choose.
    """
    parts, need = len(blocking.widths), blocking.need
    if need >= parts:
        return F.array(*map(F.lit, range(parts)))
    keys = rows.select(F.posexplode(F.array(*blocking.cut(word))).alias("seg", "key"))
    tiers: dict[tuple[int, int], list[int]] = {}
    for r in hot_counts(keys, ["seg", "key"], hot_keys, hot_rows).collect():
        tiers.setdefault((r["seg"], r["n"].bit_length() // 2), []).append(r["key"])
    ranks = []
    for i, key in enumerate(blocking.cut(word)):
        rank = F.lit(0)
        for (seg, tier), values in sorted(tiers.items()):
            rank = F.when(key.isin(values), tier).otherwise(rank) if seg == i else rank
        ranks.append(F.struct(rank.alias("rank"), F.lit(i).alias("seg")))
    return F.array_sort(F.transform(F.slice(F.array_sort(F.array(*ranks)), 1, need), lambda x: x["seg"])) if tiers else F.array(*map(F.lit, range(need)))


def index_rows(rows: DataFrame, blocking: Blocking, hot_keys: int = CHOICE_KEYS, hot_rows: int = CHOICE_ROWS) -> DataFrame:
    """``(right_id, rw, seg, key, chosen)`` of ``(id, w)``: a row per chosen segment; ``chosen`` holds their numbers."""
    keyed = rows.select("id", "w", choose(rows, blocking, "w", hot_keys, hot_rows).alias("chosen"), F.array(*blocking.cut("w")).alias("keys"))
    return keyed.select(F.col("id").alias("right_id"), F.col("w").alias("rw"), "chosen", "keys", F.explode("chosen").alias("seg")).select("right_id", "rw", "seg", F.get("keys", F.col("seg")).alias("key"), "chosen")


def probe_rows(rows: DataFrame, blocking: Blocking) -> DataFrame:
    """``(left_id, lw, seg, key)`` of ``(id, w)``: a row per segment and, where one bit may differ, per neighbour."""
    near = lambda k, width: F.array(k, *[k.bitwiseXOR(F.lit(1 << b)) for b in range(width if blocking.inner else 0)])
    entries = F.array(*[near(k, width) for k, width in zip(blocking.cut("w"), blocking.widths, strict=True)])
    return rows.select(F.col("id").alias("left_id"), F.col("w").alias("lw"), F.posexplode(entries).alias("seg", "ks")).select("left_id", "lw", "seg", F.explode("ks").alias("key"))


def near_only(met: DataFrame, blocking: Blocking) -> DataFrame:
    """Of rows that met in a segment the pairs within the radius, each in the first chosen segment that matches."""
    earlier = F.lit(False)
    for i, (a, b) in enumerate(zip(blocking.cut("lw"), blocking.cut("rw"), strict=True)):
        match = a == b if blocking.inner == 0 else F.bit_count(a.bitwiseXOR(b)) <= blocking.inner
        earlier = earlier | ((F.col("seg") > i) & F.array_contains("chosen", i) & match)
    distance = blocking.distance("lw", "rw")
    return met.where((distance <= blocking.radius) & ~earlier).select("left_id", "right_id", distance.alias("distance"))


def self_pairs(rows: DataFrame, blocking: Blocking) -> DataFrame:
    """``(left_id, right_id, distance)`` of all pairs of ``(id, w)`` rows within the radius, left id smaller."""
    met = join_tiled(probe_rows(rows, blocking), index_rows(rows, blocking), ["seg", "key"], "left_id", "right_id")
    return near_only(met.where("left_id < right_id"), blocking)


def hamming_pairs(df: DataFrame, id_col: str, word_col: str, radius: int, bits: int = 64, parts: int | None = None) -> DataFrame:
    """``(left_id, right_id, distance)`` of all pairs of words of ``bits`` bits within ``radius``, left id smaller.

    Rows with null ids or words have no partner. Pairs of equal words are part of
    the result; where words repeat often use ``hamming_classes``. Words are joined once
    each, and pairs of words are then expanded to those of their rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(word_col).alias("w")).where("id IS NOT NULL AND w IS NOT NULL")
    classes, members, same = classes_with_numbers(rows, "w")
    near = self_pairs(classes.select(F.struct("c", F.col("members").alias("n")).alias("id"), "w"), words(radius, bits, parts))
    pairs = near.select(F.col("left_id.c").alias("left_c"), F.col("right_id.c").alias("right_c"), F.col("left_id.n").alias("left_n"), F.col("right_id.n").alias("right_n"), "distance")
    return member_pairs(pairs.unionByName(same.drop("w").withColumn("distance", F.lit(0))), members)


def hamming_pairs_wide(df: DataFrame, id_col: str, words_col: str, radius: int, count: int = 4, segment_bits: int = 16) -> DataFrame:
    """As ``hamming_pairs`` for arrays of 64-bit words, in segments of ``segment_bits`` bits."""
    blocking = word_arrays(radius, count, segment_bits)
    whole = (F.size(F.coalesce(words_col, F.array())) == count) & F.col(id_col).isNotNull()
    return self_pairs(df.where(whole).select(F.col(id_col).alias("id"), F.col(words_col).alias("w")), blocking)


def array_pairs(df: DataFrame, id_col: str, words_col: str, radius: int, count: int = 4) -> DataFrame:
    """As ``hamming_pairs_wide``; where a row has no choice among 16-bit segments that may differ in one bit, rows meet in NumPy.

    A row is then sent 32 times (by either byte of a segment), not 272 times as a probe and 16 times as an index row.
    """
    blocking = word_arrays(radius, count)
    if blocking.inner != 1 or blocking.need < len(blocking.widths):
        return hamming_pairs_wide(df, id_col, words_col, radius, count)
    whole = (F.size(F.coalesce(words_col, F.array())) == count) & F.col(id_col).isNotNull() & ~F.exists(words_col, lambda x: x.isNull())
    return wide_pairs(df.where(whole).select(F.col(id_col).alias("id"), F.col(words_col).alias("w")), radius, count)


def _videos(df: DataFrame, id_col: str, frames_col: str, duration_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(frames_col).alias("f"), F.col(duration_col).cast("long").alias("ms")).where("id IS NOT NULL AND f IS NOT NULL AND ms IS NOT NULL")


def _near_videos(classes: DataFrame, number: str, max_average: int, window_ms: int, frames: int) -> DataFrame:
    """Near pairs of ``(number, f, ms, members)`` rows; arrays with a null have no partner."""
    whole = classes.where(~F.exists("f", lambda x: x.isNull())).select(F.col(number).alias("id"), "f", "ms", F.col("members").alias("n"))
    return near_in_window(whole, frames * max_average, window_ms)


def classes_with_numbers(rows: DataFrame, *signature: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored classes of equal rows with a number ``c`` each, ``(id, c, n)`` of every member, and each class of several beside itself."""
    classes = materialize(word_classes(rows, "id", *signature).withColumn("c", F.monotonically_increasing_id()), "classes")
    members = join_counted(rows, classes, list(signature), ["id"], "members").select("id", "c", F.col("members").alias("n"))
    same = classes.where("members > 1").select(F.col("c").alias("left_c"), F.col("c").alias("right_c"), F.col("members").alias("left_n"), F.col("members").alias("right_n"), *signature)
    return classes, members, same


def video_pairs(df: DataFrame, id_col: str, frames_col: str, duration_col: str, max_average: int = 5, window_ms: int = VIDEO_WINDOW_MS, frames: int = FRAMES) -> DataFrame:
    """Pairs of videos with durations within the window and a total frame distance within ``frames * max_average``.

    Videos with the same frames and duration are one class. Classes are compared in pairs of blocks of
    neighbouring duration buckets (``near_in_window``): at such radii most videos share one of the segments that would
    block them, so that blocking on segments met nearly all pairs, several times. Pairs of classes are then expanded to
    those of their members.
    """
    rows = _videos(df, id_col, frames_col, duration_col)
    classes, members, same = classes_with_numbers(rows, "f", "ms")
    pairs = _near_videos(classes, "c", max_average, window_ms, frames)
    same = same.where(~F.exists("f", lambda x: x.isNull())).drop("f", "ms").withColumns({"distance": F.lit(0), "apart": F.lit(0).cast("long")})
    found = member_pairs(materialize(pairs.unionByName(same), "near"), members)
    return found.select("left_id", "right_id", F.col("distance").alias("total_distance"), F.col("apart").alias("duration_difference"))


def word_classes(df: DataFrame, id_col: str, *signature: str) -> DataFrame:
    """One row per signature: its smallest id as ``rep`` and its member count."""
    return df.groupBy(*signature).agg(F.min(id_col).alias("rep"), F.count("*").alias("members"))


def hamming_classes(df: DataFrame, id_col: str, word_col: str, radius: int, bits: int = 64, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes of equal words, and ``(id, rep)`` of every member.

    Members of a class are at distance 0 from each other and are not paired, so a
    word that a third of all rows share is one row in the join; nothing is lost, as
    a member's other partners are its representative's.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(word_col).alias("w")).where("id IS NOT NULL AND w IS NOT NULL")
    classes = materialize(word_classes(rows, "id", "w"), "words")
    pairs = self_pairs(classes.select(F.col("rep").alias("id"), "w"), words(radius, bits, parts))
    return pairs, join_counted(rows, classes, ["w"], ["id"], "members").select("id", "rep")


def flipped_classes(df: DataFrame, id_col: str, word_col: str, radius: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """As ``hamming_classes`` for few bits: a word is joined with those that differ in up to ``radius`` bits, all of which are named."""
    rows = df.select(F.col(id_col).alias("id"), F.col(word_col).alias("w")).where("id IS NOT NULL AND w IS NOT NULL")
    classes = materialize(word_classes(rows, "id", "w"), "words")
    masks = [sum(1 << b for b in chosen) for n in range(1, radius + 1) for chosen in itertools.combinations(range(bits), n)]
    probes = classes.select(F.col("rep").alias("left_id"), F.col("w").alias("lw"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
    probes = probes.select("left_id", F.col("lw").bitwiseXOR(F.col("m")).alias("w"), F.bit_count("m").alias("distance"))
    pairs = probes.join(classes.select(F.col("rep").alias("right_id"), "w").hint("merge"), "w").where("left_id < right_id").select("left_id", "right_id", "distance")
    return materialize(pairs, "near"), join_counted(rows, classes, ["w"], ["id"], "members").select("id", "rep")


def video_classes(df: DataFrame, id_col: str, frames_col: str, duration_col: str, max_average: int = 5, window_ms: int = VIDEO_WINDOW_MS, frames: int = FRAMES) -> tuple[DataFrame, DataFrame]:
    """As ``hamming_classes`` for ``video_pairs``: a class has the same frames and the same duration."""
    rows = _videos(df, id_col, frames_col, duration_col)
    classes = materialize(word_classes(rows, "id", "f", "ms"), "videos")
    near = _near_videos(classes, "rep", max_average, window_ms, frames).where("left_c <> right_c")
    pairs = near.select(F.least("left_c", "right_c").alias("left_id"), F.greatest("left_c", "right_c").alias("right_id"), F.col("distance").alias("total_distance"), F.col("apart").alias("duration_difference"))
    return pairs, join_counted(rows, classes, ["f", "ms"], ["id"], "members").select("id", "rep")


def hot_signatures(df: DataFrame, signature: list[str], max_members: int = 2048, max_pairs: int = 2_000_000) -> DataFrame:
    """Signatures whose direct member pairs exceed a limit; reports name them as deferred."""
    counted = df.groupBy(*signature).agg(F.count("*").alias("members"))
    return counted.where((F.col("members") > max_members) | (F.col("members") * (F.col("members") - 1) > 2 * max_pairs))
