"""Unit vectors, brute-force comparisons and invariants of the engine's operators."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import config
from twinsift.functions import bits, gates, images, media
from twinsift.operators import backfill, cluster, exact, ingest, report, segment_index, selection, similar, simjoin, wide
from twinsift.operators.components import connected_components
from twinsift.operators.joins import join_counted
from twinsift.plans.generations import Generations, schema_version
from twinsift.plans.storage import materialize
from twinsift.plans.report_store import RELATIONS, SKIPPED, ReportStore
from twinsift.plans.selection_store import SELECTION, SelectionStore
from twinsift.sources import files, schemas
from twinsift.streaming import logs, outbox


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def one(df):
    return df.first()[0]


def test_exact_grouping(spark):
    rows = [(1, "a", 100), (2, "b", 100), (3, "b", 100), (4, "c", 250), (5, "c", 250), (6, "c", 250), (7, None, 5)]
    g = {r["sha"]: r for r in exact.exact_groups(spark.createDataFrame(rows, "path_id long, sha string, size_bytes long")).collect()}
    assert {k: (r["member_count"], r["reclaimable_bytes"]) for k, r in g.items()} == {"b": (2, 100), "c": (3, 500)}


def test_segments_cover_and_recall():
    rng = random.Random(5)
    for n in range(16):
        widths = bits.segment_widths(64, n + 1)
        assert sum(widths) == 64 and max(widths) - min(widths) <= 1
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            at, hit = 64, False
            for w in widths:
                at -= w
                hit |= (x >> at) & ((1 << w) - 1) == (y >> at) & ((1 << w) - 1)
            assert hit
    with pytest.raises(ValueError):
        bits.segment_widths(64, 65)


def test_hamming_functions(spark):
    d = spark.createDataFrame([(0, 0x1F, "0f", "F0"), (-1, 0, "0g", "00"), (5, 5, "abc", "abc"), (1, 3, "aa", "aaaa")], "a long, b long, x string, y string")
    got = d.select(bits.hamming("a", "b").alias("h"), bits.hamming_hex("x", "y").alias("hex")).collect()
    assert [r["h"] for r in got] == [5, 64, 0, 1]
    assert [r["hex"] for r in got] == [8, -1, -1, -1]


@pytest.mark.parametrize(("radius", "parts"), [(2, 3), (3, 4), (7, 4), (31, 16)])
def test_blocked_join_equals_nested_loop(spark, radius, parts):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    words = [(i, signed(base[i % 20] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, radius + 3))))) for i in range(120)]
    got = simjoin.hamming_pairs(spark.createDataFrame(words + [(None, 1), (500, None)], "id long, w long"), "id", "w", radius, parts=parts)
    rows = [tuple(r) for r in got.collect()]
    want = {(a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for a, x in words for b, y in words if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= radius}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_wide_join_of_256_bits(spark):
    rows = []
    for i in range(48):
        base = [0x00, 0xFF, 0xAA][i // 16]
        v = int.from_bytes(bytes([base]) * 32, "big")
        for k in range((i % 16) * 2):
            v ^= 1 << (k * 7 % 256)
        rows.append((i, [signed(v >> s & (1 << 64) - 1) for s in (192, 128, 64, 0)]))
    got = [tuple(r) for r in simjoin.hamming_pairs_wide(spark.createDataFrame(rows, "id long, w array<long>"), "id", "w", 31).collect()]
    dist = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))
    want = {(a, b, dist(x, y)) for a, x in rows for b, y in rows if a < b and dist(x, y) <= 31}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("group_rows", "tile_rows", "cells"), [(16_384, 65_536, 1 << 19), (8, 20, 50)])
def test_array_pairs_meet_in_groups_and_tiles(spark, monkeypatch, group_rows, tile_rows, cells):
    """No row is sent for neighbouring values; half of all rows share a segment, and the pairs are those of brute force, once each."""
    monkeypatch.setattr(wide.wide_pairs, "__defaults__", (group_rows, tile_rows, cells))
    monkeypatch.setattr(simjoin, "probe_rows", None)
    rng = random.Random(11)
    rows = []
    for i in range(40):
        v = rng.getrandbits(256) & ~(0xFFFF << 240 if i % 2 else 0)
        for k in range(4):
            marked = v
            for s in rng.sample(range(16), min(16, 5 * k + i % 3)):
                marked ^= 1 << 16 * s + rng.randrange(16)
            rows.append((4 * i + k, [signed(marked >> s & (1 << 64) - 1) for s in (192, 128, 64, 0)]))
    rows += [(1000, rows[0][1]), (1001, None), (1002, [1, 2, 3]), (1003, [1, 2, 3, None])]
    got = [tuple(r) for r in simjoin.array_pairs(spark.createDataFrame(rows, "id long, w array<long>"), "id", "w", 31).collect()]
    dist = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))
    whole = rows[:-3]
    want = {(a, b, dist(x, y)) for a, x in whole for b, y in whole if a < b and dist(x, y) <= 31}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_classes_of_videos_and_words(spark):
    """Nine in ten rows are copies of one video; pairs of classes and membership give all pairs of different videos."""
    rng = random.Random(3)
    kinds = [([rng.getrandbits(62)] * 6, 1000), ([rng.getrandbits(62)] * 6, 1000)]
    kinds += [([kinds[0][0][0] ^ 1] * 6, 1000), ([kinds[0][0][0] ^ 1] * 6, 9000), (None, 5), ([1] * 6, None)]
    rows = [(i, *kinds[0 if i % 10 else rng.randrange(len(kinds))]) for i in range(400)] + [(None, *kinds[0])]
    videos = spark.createDataFrame(rows, "id long, f array<long>, ms long")
    pairs, members = simjoin.video_classes(videos, "id", "f", "ms", max_average=2)
    known = [r for r in rows if None not in r]
    rep = {}
    for i, f, ms in known:
        rep.setdefault((tuple(f), ms), i)
    assert {(r["id"], r["rep"]) for r in members.collect()} == {(i, rep[tuple(f), ms]) for i, f, ms in known} and members.count() == len(known)
    near = {tuple(sorted((rep[a], rep[b]))) for a, b in itertools.combinations(rep, 2) if sum(bin(x ^ y).count("1") for x, y in zip(a[0], b[0], strict=True)) <= 12 and abs(a[1] - b[1]) <= gates.VIDEO_WINDOW_MS}
    assert {(r["left_id"], r["right_id"]) for r in pairs.collect()} == near and near
    assert [t.count() for t in simjoin.video_classes(videos.limit(0), "id", "f", "ms")] == [0, 0]
    words = videos.select("id", F.get("f", F.lit(0)).alias("w"))
    hamming, of = simjoin.hamming_classes(words, "id", "w", 2)
    assert hamming.count() == len({w for _, w in {(r["rep"], r["w"]) for r in of.join(words, "id").collect()} if any(bin(w ^ x).count("1") in (1, 2) for x in {k[0][0] for k in rep})}) // 2


def test_videos_in_blocks_equal_nested_loop(spark, monkeypatch):
    """Copies, hot classes and negative durations over several blocks and buckets: every pair once."""
    from twinsift.operators import blocks

    monkeypatch.setattr(blocks.near_in_window, "__defaults__", (5,))
    monkeypatch.setattr(blocks.member_pairs, "__defaults__", (3,))
    rng = random.Random(11)
    kinds = [([rng.getrandbits(63) ^ (rng.getrandbits(2) << 1)] * 2 + [signed(rng.getrandbits(64)) for _ in range(4)], rng.randrange(-5000, 5000)) for _ in range(12)]
    kinds += [([f[0] ^ (1 << rng.randrange(60)), *f[1:]], ms + rng.randrange(-2100, 2100)) for f, ms in kinds for _ in range(4)]
    rows = [(i, *kinds[0 if i % 3 == 0 else rng.randrange(len(kinds))]) for i in range(150)] + [(500, [1, None, 1, 1, 1, 1], 0), (501, [1, None, 1, 1, 1, 1], 0), (502, [1] * 5, 0), (503, None, 0)]
    rows += [(600, [1 << 61] * 6, 0), (600, [1 << 51] * 6, 0), (601, [1 << 61] * 6, 0), (602, [1 << 51] * 6, 0)]  # one id with two contents
    got = [tuple(r) for r in simjoin.video_pairs(spark.createDataFrame(rows, "id long, f array<long>, ms long"), "id", "f", "ms", max_average=2).collect()]
    far = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))
    want = {(a, b, far(f, g), abs(m - n)) for (a, f, m), (b, g, n) in itertools.combinations(rows[:150], 2) if far(f, g) <= 12 and abs(m - n) <= 2000}
    want |= {(600, 601, 0, 0), (600, 601, 12, 0), (600, 602, 0, 0), (600, 602, 12, 0), (601, 602, 12, 0)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1225
    assert simjoin.video_pairs(spark.createDataFrame([], "id long, f array<long>, ms long"), "id", "f", "ms").count() == 0


def test_blocks_are_compared_in_several_tasks(spark, monkeypatch):
    """Pairs of blocks are few bytes but much work, so they stay dealt; all radii and numbers of frames give all pairs."""
    from twinsift.operators import blocks

    rng = random.Random(12)
    kinds = [[rng.getrandbits(8) * 0x0101010101010101 for _ in range(n)] for n in (0, 1, 5) for _ in range(40)]
    rows = [(i, [signed(w) for w in f], rng.randrange(-900, 2600), 1) for i, f in enumerate(kinds)]
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    spark.conf.set(name, "false")
    try:
        for radius in (0, 30, 150, 300):
            monkeypatch.setattr(blocks, "HOT_KEYS", 0 if radius == 150 else 10_000)  # more buckets than are broadcast
            got = blocks.near_in_window(spark.createDataFrame(rows, "id long, f array<long>, ms long, n long"), radius, 1000, 8).withColumn("task", F.spark_partition_id()).collect()
            far = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))
            want = {(a, b, far(f, g), abs(m - n)) for (a, f, m, _), (b, g, n, _) in itertools.combinations(rows, 2) if len(f) == len(g) and far(f, g) <= radius and abs(m - n) <= 1000}
            assert {(min(r["left_c"], r["right_c"]), max(r["left_c"], r["right_c"]), r["distance"], r["apart"]) for r in got} == want and len(got) == len(want) > 0
            assert len({r["task"] for r in got}) > 1
    finally:
        spark.conf.unset(name)


def test_copies_of_a_video_before_the_start(spark):
    """Videos whose durations lie on both sides of 0, in copies: accepted edges are all pairs within the window."""
    rng = random.Random(2)
    frames, far = ([rng.getrandbits(62) | 1 for _ in range(6)] for _ in range(2))
    rows = [(i, [far, frames][i % 2], -1500 + 700 * (i % 4)) for i in range(60)]
    got = similar.video_edges(spark.createDataFrame(rows, "id long, video_dhashes array<long>, video_duration_ms long"), 15).select("left_id", "right_id").collect()
    static = {i for i, f, _ in rows if sum(bin(x ^ y).count("1") for x, y in itertools.combinations(f, 2)) < 75}
    near = lambda f, g: sum(bin(x ^ y).count("1") for x, y in zip(f, g, strict=True)) <= 90
    want = {(a, b) for (a, f, m), (b, g, n) in itertools.combinations(rows, 2) if near(f, g) and abs(m - n) <= 2000 and not {a, b} & static}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 400


def test_video_rules(spark):
    v = [(1, [0xF0] * 6, 10_000), (2, [0xFF] * 6, 12_000), (3, [0xFF] * 6, 12_001), (4, [0x1F] * 6, 10_000)]
    got = {(r["left_id"], r["right_id"]): r["total_distance"] for r in simjoin.video_pairs(spark.createDataFrame(v, "id long, f array<long>, ms long"), "id", "f", "ms").collect()}
    assert got[(1, 2)] == 24 and (1, 3) not in got and (1, 4) not in got and got[(2, 3)] == 0
    edge = spark.createDataFrame([(1, [0] * 6, 0), (2, [31] * 6, 0), (3, [63] + [31] * 5, 0)], "id long, f array<long>, ms long")
    assert (1, 2) in {tuple(r)[:2] for r in simjoin.video_pairs(edge, "id", "f", "ms").collect()}
    d = spark.createDataFrame([(2, [0, 1, 1, 1, 1, 1]), (2, None), (2, [1] * 6), (0, None)], "media_kind int, video_dhashes array<long>").withColumn("image_dhash", F.lit(0).cast("long"))
    assert [r[0] for r in d.select(media.visual_status()).collect()] == ["ZeroVideoFrame", "MissingVideo", "Valid", "UnsupportedMedia"]


def test_gates(spark):
    d = spark.createDataFrame([([0xFF] * 12 + [0xFFFFF] * 4, [0] * 16), ([0xFF] * 11 + [0x7FF] + [0xFFFFF] * 4, [0] * 16)], "a array<long>, b array<long>")
    z = [r[0] for r in d.select(gates.zoned_evidence("a", "b", F.lit(False))).collect()]
    assert (z[0]["accepted"], z[0]["passing"], z[0]["trimmed_sum"]) == (True, 12, 96) and (z[1]["accepted"], z[1]["passing"]) == (False, 11)
    shapes = spark.createDataFrame([(1009, 1000), (1020, 1000), (0, 1000)], "w long, h long")
    assert [r[0] for r in shapes.select(media.aspect_compatible(F.lit(1000), F.lit(1000), "w", "h")).collect()] == [True, False, False]
    pair = "image_pdq array<long>, image_dhash long, image_pdq_quality int, width long, height long"
    far, near = [signed((1 << 44) - 1), 0, 0, 0], [0, 0, 0, 0]
    for quality, want in ((100, "DHashFallback"), (20, None)):
        l = spark.createDataFrame([(far, 0, quality, 100, 100)], pair).alias("l")
        r = spark.createDataFrame([(near, 0b111, quality, 100, 100)], pair).alias("r")
        assert one(l.crossJoin(r).select(gates.primary_route("l", "r"))) == want


def test_complete_link_example_and_brute_force(spark):
    e = spark.createDataFrame([(0, 1, 4), (1, 2, 4)], "left_id long, right_id long, distance int")
    roots, _ = cluster.complete_link(e)
    roots = roots.cache()
    assert {(r["id"], r["root"]) for r in roots.collect()} == {(0, 0), (1, 0), (2, 2)}
    assert {(r["left_id"], r["right_id"]) for r in cluster.cross_relations(e, roots).collect()} == {(1, 2), (2, 1)}
    rng = random.Random(3)
    edges = sorted({(a, b): rng.randrange(6) for a, b in (sorted(rng.sample(range(70), 2)) for _ in range(110))}.items())
    edges = [(a, b, d) for (a, b), d in edges]
    got, late = cluster.complete_link(spark.createDataFrame(edges, "left_id long, right_id long, distance int"))
    assert {r["id"]: r["root"] for r in got.collect()} == cluster.greedy(edges) and late.count() == 0
    _, late = cluster.complete_link(spark.createDataFrame(edges, "left_id long, right_id long, distance int"), max_edges=3)
    assert late.count() >= 1


@pytest.mark.parametrize("round_nodes", [1_000, 35])
def test_complete_link_of_copies_makes_no_edges_of_nodes(spark, monkeypatch, round_nodes):
    """Groups and relations from pairs of classes are those of all pairs of their nodes, in one round and in several."""
    rng = random.Random(29)
    kinds = [rng.randrange(1 << 9) for _ in range(60)]
    words = [(5 * i + 3, rng.choice(kinds) if i % 7 else rng.randrange(1 << 9)) for i in range(200)] + [(2_000, 1 << 15 | 0x5555), (2_001, 1 << 15 | 0x5555), (2_002, 0x6AAA << 1)]
    edges = [(a, b, bin(x ^ y).count("1")) for (a, x), (b, y) in itertools.combinations(words, 2) if bin(x ^ y).count("1") <= 2]
    roots = cluster.greedy(edges)
    monkeypatch.setattr(simjoin, "member_pairs", None)
    pairs, members = simjoin.flipped_classes(spark.createDataFrame(words, "id long, w long"), "id", "w", 2, 16)
    got = cluster.complete_link_copies(pairs, members, round_nodes)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(roots) and dict(rows) == roots and len(set(roots.values())) < len(roots) // 3
    want = {(x, y, d, roots[x], roots[y]) for a, b, d in edges for x, y in ((a, b), (b, a)) if roots[a] != roots[b]}
    across = [tuple(r[c] for c in ("left_id", "right_id", "distance", "left_root", "right_root")) for r in cluster.cross_copies(pairs, members, got).collect()]
    assert len(across) == len(want) and set(across) == want


def test_complete_link_in_rounds_leaves_no_component_out(spark):
    rng = random.Random(5)
    kind = "left_id long, right_id long, distance int"
    # a sparse component, and two dense blocks that lack a few edges and overlap
    sparse = {tuple(sorted(rng.sample(range(60), 2))): rng.randrange(4) for _ in range(110)}
    dense = {(a, b): rng.randrange(3) for lo, hi in ((100, 130), (124, 150)) for a in range(lo, hi) for b in range(a + 1, hi) if rng.random() < 0.93}
    edges = [(a, b, d) for (a, b), d in sorted({**sparse, **dense}.items())]
    got, late = cluster.complete_link(spark.createDataFrame(edges, kind), task_edges=60)
    rows = got.collect()
    assert len(rows) == len({x for a, b, _ in edges for x in (a, b)})
    assert {r["id"]: r["root"] for r in rows} == cluster.greedy(edges) and late.count() == 0


def test_join_counted(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, rng.randrange(50)]), i) for i in range(600)] + [(None, 900)]
    r = spark.createDataFrame(rows, "k long, v long")
    counted = r.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("n > 1")
    want = sorted((k, v, min(x for y, x in rows if y == k)) for k, v in rows if k is not None and sum(y == k for y, _ in rows) > 1)
    for hot_rows in (5, 50, 10_000):
        got = join_counted(r, counted, ["k"], ["v"], hot_keys=100, hot_rows=hot_rows)
        assert sorted(tuple(x) for x in got.select("k", "v", "least").collect()) == want
    assert join_counted(r.limit(0), counted.limit(0), ["k"], ["v"]).count() == 0


def test_unique_edges_are_dealt_by_their_number(spark):
    """The tasks that look for equal edges grow in number with the edges, and no aggregation comes before the exchange."""
    from twinsift.plans.storage import dealt

    rows = materialize(spark.range(1000).selectExpr("id % 90 AS a", "id AS b"), "edges")
    assert dealt(rows, "a", "b", rows=50).rdd.getNumPartitions() == 20
    plan = dealt(rows, "a", "b", rows=50).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


MEMBER = "group_id long, path_id long, size_bytes long, width long, height long, bitrate long, last_write_time_utc_ms long, scan_root_priority int, storage_target_key string"


def _three(spark):
    return spark.createDataFrame([(1, i, 100 * i, 100 * i, 100, 1000 * i, i, 3 - i, f"PhysicalDrive{1 if i < 3 else 2}") for i in (1, 2, 3)], MEMBER)


@pytest.mark.parametrize(("policies", "want"), [(["smallest"], 1), (["highest_quality"], 3), (["path_priority"], 3), (["newest", "oldest"], 3), (["largest", "smallest"], 3), (["oldest"], 1)])
def test_retention(spark, policies, want):
    m = _three(spark)
    assert one(selection.keep_one(m, policies).select("retained_path_id")) == want
    assert {r["retained_path_id"] for r in selection.plan(m, policies).collect()} == {want}


def test_retention_edges(spark):
    m = _three(spark)
    p = {r["path_id"]: (r["selected"], r["retained_path_id"]) for r in selection.plan(m, ["largest"], "  physicaldrive1  ").collect()}
    assert p == {1: (True, 3), 2: (True, 3), 3: (False, 3)}
    assert {r["status"] for r in selection.plan(m, ["largest"], "PhysicalDrive99").collect()} == {"TargetStorageNotFound"}
    assert {r["status"] for r in selection.plan(m, []).collect()} == {"InvalidPolicy"}
    assert {r["status"] for r in selection.plan(m.where("path_id = 1"), ["newest"]).collect()} == {"InsufficientMembers"}
    tie = spark.createDataFrame([(1, i, 5, 1, 1, 1, 1, 1, "d") for i in (3, 1, 2)], MEMBER)
    assert one(selection.keep_one(tie, ["largest"]).select("retained_path_id")) == 1
    with pytest.raises(ValueError):
        selection.keep_order(["best"], set())


def test_selection_is_strict(spark):
    m = spark.createDataFrame([(1, 1, 10, 0b1111, None), (1, 2, 250, 0b1100, None), (1, 3, 5, None, None)], "group_id long, path_id long, size_bytes long, image_dhash long, video_dhashes array<long>")
    kept = spark.createDataFrame([(1, 1)], "group_id long, retained_path_id long")
    for limit, want in ((2, (False, "image_distance_not_below_limit")), (3, (True, ""))):
        d = {r["path_id"]: r["decision"] for r in selection.safe_selection(m, kept, F.lit(1), three_stage=False, image_limit=limit).collect()}
        assert (d[2]["allowed"], d[2]["reason"]) == want and d[1]["reason"] == "retained_member" and d[3]["reason"] == "image_dhash_invalid"
    s = selection.safe_selection(m, kept, F.lit(1)).where("decision.allowed AND path_id = 2")
    assert tuple(selection.snapshot(s).first()) == (1, 250, 1)
    assert selection.recheck(s, m.where("path_id <> 2"), F.lit(1)).count() == 0


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}", "exact")
    d = spark.range(3)
    g.write(1, "t", d)
    assert g.active() is None
    with pytest.raises(LookupError):
        g.read("t")
    g.publish(1, 3)
    g.write(2, "t", spark.range(5))
    assert g.read("t").count() == 3
    assert g.clean() == [2] and g.active() == 1
    g.write(3, "t", spark.range(7))
    g.publish(3, 7)
    assert g.read("t").count() == 7 and g.generations() == [1, 3]  # the one before stays for its readers
    g.write(4, "t", spark.range(9))
    g.publish(4, 9)
    assert g.read("t").count() == 9 and g.generations() == [3, 4]
    g.delete_all()
    assert g.active() is None and g.generations() == []


def test_generations_survive_a_crash(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}", "exact")
    g.write(1, "t", spark.range(3))
    with pytest.raises(LookupError):
        g.clean()
    assert g.generations() == [1]
    g.publish(1, 3)
    g.write(2, "t", spark.range(5))
    (tmp_path / "exact" / "active" / "1").mkdir()  # a pointer whose job died before its commit
    assert g.active() == 1 and g.read("t").count() == 3
    g.publish(2, 5)
    assert g.active() == 2 and g.clean() == [] and g.generations() == [1, 2]
    for f in sorted((tmp_path / "exact" / "active").rglob("*"), reverse=True):
        f.unlink() if f.is_file() else f.rmdir()
    with pytest.raises(LookupError):
        g.clean()
    assert g.generations() == [1, 2] and g.clean(unpublished=True) == [1, 2]


def test_selection_store(spark, tmp_path):
    store = SelectionStore(spark, f"file://{tmp_path}")
    rows = lambda *r: spark.createDataFrame(list(r), SELECTION)
    held = lambda: sorted(tuple(r) for r in store.present().collect())
    assert held() == []
    first = store.begin()
    store.save(first, rows((1, 10, 11, 5)))
    store.save(first, rows((2, 20, 21, 6)))
    assert held() == []
    store.publish(first)
    assert held() == [(1, 10, 11, 5), (2, 20, 21, 6)]
    store.set_groups(spark.createDataFrame([(2,), (3,)], "group_id long"), rows((2, 22, 21, 7), (9, 1, 2, 3)))
    assert held() == [(1, 10, 11, 5), (2, 22, 21, 7)]
    store.save(store.begin(), rows((5, 50, 51, 1)))  # a replacement that is never finished
    other = store.begin()
    store.discard(other)
    assert len(store.cleanup()) == 1 and len(held()) == 2
    with pytest.raises(ValueError):
        store.stored.drop(store.stored.active())
    # another session goes on with a replacement; a batch that was not written to the end does not count
    number = store.begin()
    store.save(number, rows((7, 70, 71, 1)))
    (tmp_path / f"selection/gen={number}/batch=2").mkdir()
    store = SelectionStore(spark, f"file://{tmp_path}")
    store.save(number, rows((8, 80, 81, 2)))
    (tmp_path / f"selection/gen={number}/batch=3").mkdir()
    store.publish(number)
    assert held() == [(7, 70, 71, 1), (8, 80, 81, 2)]
    store.clear()
    assert held() == []


def test_selection_is_decided_once(spark, monkeypatch):
    """What the store saves is read from one stored decision, not decided again for each batch."""
    from twinsift.plans import catalog

    saved, save = [], SelectionStore.save
    monkeypatch.setattr(SelectionStore, "save", lambda self, number, rows: (saved.append(rows), save(self, number, rows))[1])
    assert catalog.QUERIES["selection_store"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(saved) > 5 and not [f for rows in saved for f in rows.inputFiles() if "lineitem" in f]


def test_copy_of_a_generation(spark, tmp_path):
    g, backup = Generations(spark, f"file://{tmp_path}/a", "exact"), Generations(spark, f"file://{tmp_path}/b", "exact")
    with pytest.raises(LookupError):
        g.copy(backup)
    g.write(1, "t", spark.range(3))
    g.write(1, "u", spark.range(4))
    g.publish(1, 7)
    assert g.copy(backup) == 7 and backup.active() == 1
    assert backup.tables(1) == ["t", "u"] and backup.tables(9) == []
    assert sorted(r["id"] for r in backup.read("u").collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):  # a published copy is never overwritten
        g.copy(backup)
    versions = spark.createDataFrame([(1,), (4,), (None,)], "schema_version int")
    assert one(schema_version(versions)) == 4 and one(schema_version(versions.limit(0))) == 0


def test_report_store(spark, tmp_path):
    store = ReportStore(spark, f"file://{tmp_path}")
    number = store.begin()
    # one group holds most rows, one a single row, and a row is repeated
    rows = spark.createDataFrame([(7, i) for i in range(300)] + [(8, 5), (None, 1), (7, 3)], "left_root long, right_root long")
    store.save_rules(number, {"pdq_max": 31, "dhash_max": 4})
    store.save(number, RELATIONS, rows, ["right_root"], "left_root")
    store.save(number, SKIPPED, rows.limit(0), ["right_root"])
    with pytest.raises(LookupError):
        store.rules()
    store.publish(number)
    assert store.rules() == {"dhash_max": 4, "pdq_max": 31}
    got = lambda value, offset, count: [(r["ordinal"], r["right_root"]) for r in store.group_page(RELATIONS, "left_root", value, offset, count).orderBy("ordinal").collect()]
    assert got(7, 2, 4) == [(2, 2), (3, 3), (4, 3), (5, 4)]
    assert got(7, 299, 50) == [(299, 298), (300, 299)] and got(7, 301, 5) == [] == got(99, 0, 5)
    assert got(8, 0, 9) == [(0, 5)] and got(None, 0, 9) == [(0, 1)]
    assert store.page(SKIPPED, 0, 10).count() == 0
    assert {r["left_root"]: r["rows"] for r in store.counts(RELATIONS).collect()} == {7: 301, 8: 1, None: 1}
    assert store.begin() == number + 1


def test_backfill(spark, tmp_path):
    schema = "sha string, path_id long, features struct<q:int>, outcome string"
    tried = spark.createDataFrame(
        [("a", 2, 1, "ok", (9,)), ("a", 1, 5, "ok", (8,)), ("a", 0, 3, "decode", None), ("b", 0, 4, "unreadable", None), ("c", 0, 6, "unreadable", None), ("c", 0, 7, "timeout", None), ("c", 0, 8, "decode", None), ("d", 0, 9, "decode", None), ("e", 0, 10, None, None)],
        "sha string, scan_root_priority int, path_id long, status string, features struct<q:int>",
    )
    done = backfill.outcomes(tried)
    assert {r["sha"]: (r["outcome"], r["path_id"], r["features"] and r["features"]["q"]) for r in done.collect()} == {
        "a": ("completed", 5, 8), "b": ("no_readable_path", None, None), "c": ("timeout", None, None), "d": ("decode_failed", None, None), "e": ("decode_failed", None, None),
    }
    assert tuple(backfill.counters(done).first()) == ("e", 5, 4, 1, 1, 1, 2)
    assert tuple(backfill.counters(done.limit(0)).first()) == (None, 0, 0, 0, 0, 0, 0)
    base = f"file://{tmp_path}/b"
    assert backfill.checkpoints(spark, base) is None and backfill.saved(spark, base, schema).count() == 0
    done.write.parquet(f"{base}/features/batch=0")  # features whose checkpoint never came
    assert backfill.saved(spark, base, schema).count() == 0
    backfill.save_batch(base, 0, done.where("sha <= 'b'"))
    done.write.parquet(f"{base}/features/batch=1")
    assert sorted(r["sha"] for r in backfill.saved(spark, base, schema).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        backfill.save_batch(base, 0, done)
    left = backfill.pending(tried, backfill.saved(spark, base, schema))
    assert sorted({r["sha"] for r in left.collect()}) == ["b", "c", "d", "e"]
    contents = spark.createDataFrame([("a", "2", [1], 5, [1], 1, 1), ("b", None, None, 5, [1], 1, 0), ("c", "1", [1], None, None, None, 1)], "sha string, media_algorithm_version string, image_pdq array<long>, image_pdq_quality int, image_zoned_phashes array<long>, image_perceptual_algorithm_version int, image_structural_algorithm_version int")
    lacks = {r["sha"]: r["m"] for r in contents.select("sha", media.missing_features("2").alias("m")).collect()}
    assert lacks == {"a": [], "b": ["media_version", "pdq", "structural_version"], "c": ["media_version", "quality", "zoned", "perceptual_version"]}
    paths = spark.createDataFrame([("a", 0, 1, "x", True), ("b", 0, 2, "y", True), ("b", 0, 3, "z", False)], "sha string, scan_root_priority int, path_id long, full_path string, active boolean")
    assert [r["path_id"] for r in backfill.targets(contents, paths, media.missing_features("2")).collect()] == [2]


def test_restart_recovery(spark):
    ops = spark.createDataFrame([(9, 2, "upsert", "k"), (3, 1, "delete", "a"), (4, 1, "upsert", "b")], "arrival long, batch_scan_id long, kind string, key string")
    queue = spark.createDataFrame([(40,), (7,)], "sequence long")
    found = sorted((r["sequence"], r["batch_scan_id"], r["key"]) for r in outbox.recover(ops, queue).collect())
    assert found == [(41, 1, "a"), (42, 1, "b"), (43, 2, "k")]  # scan by scan, after the queue
    assert sorted(r["sequence"] for r in outbox.recover(ops, queue.limit(0)).collect()) == [1, 2, 3]
    assert outbox.recover(ops.limit(0), queue).count() == 0
    assert sorted((r["sequence"], r["batch"]) for r in outbox.batches(spark.createDataFrame([(s,) for s in (5, 9, 11, 20, 21)], "sequence long"), 2).collect()) == [(5, 0), (9, 0), (11, 1), (20, 1), (21, 2)]
    runs = spark.createDataFrame([(1, "Hashing", 10), (2, "Failed", 20), (3, "Paused", 30), (4, "CompletedSynchronized", 40)], "scan_id long, phase string, updated_utc_ms long")
    after = outbox.mark_interrupted(runs, spark.createDataFrame([(1,), (1,), (8,)], "scan_id long"), 99)
    assert sorted(map(tuple, after.collect())) == [(1, "Interrupted", 99), (2, "Failed", 20), (3, "Paused", 30), (4, "CompletedSynchronized", 40)]
    assert [r["scan_id"] for r in outbox.resumable(after).collect()] == [1, 3]
    saved = outbox.save_runs(runs, spark.createDataFrame([(5, "Idle", 1), (1, "Syncing", 12), (1, "Planning", 11)], "scan_id long, phase string, updated_utc_ms long"))
    assert {r["scan_id"]: r["phase"] for r in saved.collect()} == {1: "Syncing", 2: "Failed", 3: "Paused", 4: "CompletedSynchronized", 5: "Idle"}
    log = spark.createDataFrame([(1, 1, "prepared"), (2, 2, "prepared"), (3, 3, "prepared"), (3, 4, "file_deleted"), (4, 5, "done")], "intent_id long, sequence long, state string")
    present = spark.createDataFrame([(1,), (1,), (3,), (4,)], "intent_id long")
    actions = outbox.recover_deletes(outbox.delete_intents(log), present).collect()
    assert sorted((r["intent_id"], r["action"]) for r in actions) == [(1, "drop"), (2, "delete_mapping"), (3, "delete_mapping")]


def test_written_logs(spark, tmp_path):
    folder = f"file://{tmp_path}/logs"
    rows = spark.createDataFrame([("failure", 1), ("execution", 2), ("failure", 3)], "kind string, sequence long").coalesce(1)
    logs.append(rows, folder, rows=1)
    logs.append(rows, folder)
    assert logs.written(spark, folder, "failure").count() == 4 and logs.written(spark, folder, "scan_errors").count() == 0
    assert len(list((tmp_path / "logs" / "kind=failure").glob("*.parquet"))) == 3
    for bad in ("other", None):
        with pytest.raises(ValueError):
            logs.append(spark.createDataFrame([(bad, 1)], "kind string, sequence long"), folder)
    assert logs.written(spark, folder, "failure").count() == 4
    feed = spark.createDataFrame([(1, 0, "s1", "m1"), (2, 3, "s2", "m2"), (3, None, "s3", "m3")], "sequence long, repeat_count long, subject string, message string").withColumn("ts", F.col("sequence")).withColumns({k: F.lit("x") for k in logs.KEY})
    r = logs.aggregated(feed).first()
    assert (r["repeat_count"], r["sequence"], r["last_ts"], r["subject"], r["message"]) == (5, 3, 3, "s1", "m1")


@pytest.mark.parametrize("per_block", [128, 1])
def test_structural_gate_takes_the_score_of_each_pair(spark, per_block):
    f = [images.image_features(_picture(kind)) for kind in ("base", "mark", "other")]
    planes = spark.createDataFrame([(i, x["plane"]) for i, x in enumerate(f)], "id long, plane binary")
    own = gates.Gates()
    pairs = spark.createDataFrame([(0, 1, False), (0, 2, True), (1, 2, False), (0, 9, False), (0, 1, True), (0, 1, None)], "left_id long, right_id long, low_quality boolean")
    got = {(r["left_id"], r["right_id"], r["low_quality"]): (r["s"] and tuple(r["s"]), r["accepted"]) for r in similar.structural_gate(pairs, planes, own, per_block=per_block).collect()}
    want = {}
    for a, b, low in ((0, 1, False), (0, 2, True), (1, 2, False), (0, 1, True)):
        profile = own.low_quality if low else own.standard
        want[a, b, low] = tuple(images.compare_planes(f[a]["plane"], f[b]["plane"], profile.block_pass_score / 1_000_000))
    assert {k: v[0] for k, v in got.items()} == want | {(0, 9, False): None}
    assert got[0, 1, False][1] and not got[1, 2, False][1]


def test_signature_classes_stand_for_their_members(spark):
    pdq = lambda x: [x, 0, 0, 0]
    rows = [(i, pdq(7), 3, 80, 100, 100, [1] * 16) for i in (5, 2, 9)] + [(4, pdq(3), 3, 80, 100, 100, [1] * 16), (6, pdq(-1), 1 << 40, 80, 10, 900, [2] * 16), (7, pdq(-1), 1 << 40, 80, 10, 900, [2] * 16)]
    d = spark.createDataFrame(rows, "id long, image_pdq array<long>, image_dhash long, image_pdq_quality int, width long, height long, image_zoned_phashes array<long>")
    members = similar.class_members(d)
    assert {r["id"]: r["rep"] for r in members.collect()} == {5: 2, 2: 2, 9: 2, 4: 4, 6: 6, 7: 6}
    roots = spark.createDataFrame([(2, 2), (4, 2)], "id long, root long")
    assert {r["id"]: r["root"] for r in similar.with_members(roots, members).collect()} == {5: 2, 2: 2, 9: 2, 4: 2, 6: 6, 7: 6}
    planes = spark.createDataFrame([(i, None) for i in (2, 4, 6)], "id long, plane binary")
    staged, _ = similar.image_edges(d, planes)
    assert [(r["left_id"], r["right_id"], r["pdq_distance"]) for r in staged.collect()] == [(2, 4, 1)]


@pytest.mark.parametrize("held", ["plane", "content"])
def test_pictures_with_the_same_hashes_are_compared(spark, held):
    """Equal hashes do not make a class: only equal planes do, and a picture without a plane stays alone."""
    kinds = {1: "base", 2: "base", 3: "other", 4: None}
    d = spark.createDataFrame([(i, [7, 0, 0, 0], 3, 80, 100, 100, [1] * 16) for i in kinds], "id long, image_pdq array<long>, image_dhash long, image_pdq_quality int, width long, height long, image_zoned_phashes array<long>")
    value = lambda kind: kind and (_picture(kind) if held == "content" else images.image_features(_picture(kind))["plane"])
    planes = spark.createDataFrame([(i, value(kind)) for i, kind in kinds.items()], f"id long, {held} binary")
    staged, members = similar.image_edges(d, planes)
    assert {(r["left_id"], r["right_id"]): (r["secondary_ok"], r["structure_ok"]) for r in staged.collect()} == {pair: (True, False) for pair in ((1, 3), (1, 4), (3, 4))}
    assert {r["id"]: r["rep"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_repeated_members_are_one_file(spark):
    m = _three(spark).where("path_id < 3")
    m = m.unionByName(m.where("path_id = 2").withColumn("size_bytes", F.lit(5).cast("long")))
    rows = selection.plan(m, ["largest"]).collect()
    assert sorted((r["path_id"], r["selected"], r["status"]) for r in rows) == [(1, True, "Succeeded"), (2, False, "Succeeded"), (2, False, "Succeeded")]
    alone = selection.plan(m.where("path_id = 2"), ["largest"]).collect()
    assert {(r["selected"], r["status"]) for r in alone} == {(False, "InsufficientMembers")}
    h = m.withColumns({"image_dhash": F.col("size_bytes"), "video_dhashes": F.lit(None).cast("array<bigint>")})
    assert selection.safe_selection(h, selection.keep_one(h, ["largest"]), F.lit(0)).count() == 3


def test_outbox_table_in_any_order(spark, tmp_path):
    kind = "sequence long, kind string, key long, payload string"
    parts = [[(1, "upsert", 1, "a"), (2, "upsert", 2, "b")], [(3, "delete", 1, None), (4, "upsert", 3, "c")], [(5, "upsert", 2, "d"), (6, "delete", 3, None)]]
    for k, order in enumerate(itertools.permutations(parts)):
        base = f"file://{tmp_path}/{k}"
        assert outbox.applied_table(spark, base, kind).count() == 0
        apply = outbox.table_applier(base)
        for number, rows in enumerate(order):
            for _ in range(2 if number == 1 else 1):  # one batch is delivered again
                apply(spark.createDataFrame(rows, kind), number)
        assert [tuple(r) for r in outbox.applied_table(spark, base, kind).select("key", "payload").collect()] == [(2, "d")]
    outbox.compact(spark, base, kind, f"{base}-new")
    outbox.table_applier(f"{base}-new")(spark.createDataFrame([(0, "upsert", 1, "late")], kind), 1)
    assert [tuple(r) for r in outbox.applied_table(spark, f"{base}-new", kind).select("key", "payload").collect()] == [(2, "d")]
    log = spark.createDataFrame([(1, 1, "prepared"), (1, 2, "done"), (2, 3, "prepared"), (3, 5, "file_deleted"), (3, 4, "prepared")], "intent_id long, sequence long, state string")
    assert {r["intent_id"]: (r["state"], r["replay"]) for r in outbox.delete_intents(log).collect()} == {1: ("done", False), 2: ("prepared", True), 3: ("file_deleted", True)}


def test_outbox(spark):
    q = spark.createDataFrame([(i, 1, "upsert", f"k{i}", "p", 0, 1000 if i == 3 else 0) for i in range(1, 6)], schemas.OUTBOX)
    assert [r["sequence"] for r in outbox.due_batch(q, 10, 4).orderBy("sequence").collect()] == [1, 2]
    assert outbox.due_batch(q.where("sequence >= 3"), 10, 4).count() == 0
    after = outbox.failed(q, outbox.due_batch(q, 10, 4), 50)
    assert {r["sequence"]: (r["attempt_count"], r["next_attempt_utc_ms"]) for r in after.collect()}[1] == (1, 1050)
    assert outbox.acknowledge(q, q.where("sequence < 3")).count() == 3
    delays = spark.createDataFrame([(a,) for a in (1, 2, 7, 40)], "a int").select(outbox.backoff_ms("a", 10)).collect()
    assert [r[0] for r in delays] == [10_000, 20_000, 300_000, 300_000]
    published = outbox.publish(outbox.staged(q.withColumn("arrival", F.col("sequence")).drop("sequence")), 5)
    assert sorted(r["sequence"] for r in published.collect()) == [6, 7, 8, 9, 10]
    runs = spark.createDataFrame([(1, "CompletedLocal"), (2, "CompletedLocal"), (3, "Hashing")], "scan_id long, phase string")
    assert [r["scan_id"] for r in outbox.finalizable(runs, q, q.limit(0)).collect()] == [2]


def test_log_runs_cross_ranges(spark):
    """Runs that end within a range, cross one border, or span several ranges; the plain rule goes over all entries."""
    rng, rows = random.Random(5), []
    for task in ("a", "b", None):
        for sequence in sorted(rng.sample(range(200), 90)):
            rows.append((task, sequence, "x" if 40 < sequence < 110 else rng.choice("xyy")))
    log = spark.createDataFrame(rows, "task string, sequence long, message string")
    want = []
    for (task, _), run in itertools.groupby(rows, key=lambda r: (r[0], r[2])):
        places = [r[1] for r in run]
        want.append((str(task), places[0], places[-1], len(places)))
    for block in (1, 7, 16, 1000):
        got = logs.run_lengths(log, ("message",), block=block).collect()
        assert sorted((str(r["task"]), r["first"], r["last"], r["length"]) for r in got) == sorted(want), block
    assert logs.run_lengths(log.limit(0), ("message",)).count() == 0


def test_incomplete_targets(spark):
    contents = spark.createDataFrame([("a", None), ("b", 1), ("c", None), ("d", None)], "sha string, image_dhash long")
    paths = spark.createDataFrame([("a", 2, 5, "p5", True), ("a", 1, 9, "p9", True), ("a", 1, 1, "p1", False), ("b", 1, 2, "p2", True), ("c", 1, 3, "p3", False), ("d", 1, 4, "p4", True)], "sha string, scan_root_priority int, path_id long, full_path string, active boolean")
    rows = exact.incomplete_with_paths(contents, paths, F.col("image_dhash").isNotNull())
    assert sorted((r["sha"], r["full_path"]) for r in rows.collect()) == [("a", "p5"), ("a", "p9"), ("d", "p4")]
    assert sorted(map(tuple, exact.incomplete_targets(rows).collect())) == [("a", 2, 5, 9), ("d", 1, 4, 4)]


def test_files_and_incremental_scan(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name, data in (("photo.JPG", b"a"), ("nested/movie.MP4", b"b"), ("nested/sound.FLAC", b"b"), ("data.bin", b"c")):
        (tmp_path / name).write_bytes(data)
    listed = files.list_files(spark, str(tmp_path))
    assert sorted(r["media_kind"] for r in listed.collect()) == [0, 1, 2, 3]
    assert all(len(r["sha512"]) == 32 for r in files.hash_files(spark, str(tmp_path), F.md5).collect())
    hashed = {r["path"].rsplit("/", 1)[1]: r["sha512"] for r in files.hash_files(spark, str(tmp_path)).collect()}
    assert hashed["movie.MP4"] == hashlib.sha512(b"b").hexdigest() == hashed["sound.FLAC"]
    known = "normalized_path string, size_bytes long, last_write_time_utc_ms long, volume_serial long, file_id_high long, file_id_low long"
    stored = spark.createDataFrame([("d:\\a", 1, 1, 1, 0, 1, "x", 10), ("d:\\b", 1, 1, 1, 0, 2, "x", 11), ("e:\\c", 1, 1, 1, 0, 3, "y", 12)], known + ", sha512 string, path_id long")
    seen = spark.createDataFrame([("d:\\a", 1, 1, 1, 0, 1), ("d:\\n", 1, 1, 1, 0, 9)], known)
    assert {r["normalized_path"]: r["action"] for r in ingest.reuse_plan(seen, stored).collect()} == {"d:\\a": "reuse", "d:\\n": "new"}
    gone = ingest.mark_unseen(stored, seen, spark.createDataFrame([("d:\\", 0)], "root string, priority int"))
    assert {r["path_id"]: r["path_state"] for r in gone.collect()} == {11: media.STATE["Missing"], 12: media.STATE["OutOfScope"]}


def test_under_root(spark):
    d = spark.createDataFrame([("d:\\a",), ("d:\\a\\x",), ("d:\\abc",)], "p string")
    assert [r[0] for r in d.select(media.under_root("p", F.lit("d:\\a\\"))).collect()] == [True, True, False]


def test_ordinals_and_row_starts(spark):
    s = spark.range(500).select(F.col("id").alias("group_id"), (F.col("id") % 5 + 2).alias("member_count"))
    n = report.with_ordinals(s, F.col("group_id"))
    assert [r["ordinal"] for r in n.orderBy("group_id").collect()] == list(range(500))
    starts = [r["row_start"] for r in report.row_starts(n).orderBy("ordinal").collect()]
    assert starts == [0, *np.cumsum([i % 5 + 4 for i in range(499)]).tolist()]


def test_stable_group_id(spark):
    def fold(data, kind=0):
        v = 1469598103934665603 ^ kind
        for b in data:
            v = (v ^ b) * 1099511628211 & (1 << 64) - 1
        return signed(v)

    d = spark.createDataFrame([("00ff",), ("ab",), (None,)], "k string")
    assert [r[0] for r in d.select(media.stable_group_id(F.col("k"))).collect()] == [fold(b"\x00\xff"), fold(b"\xab"), None]
    assert [r[0] for r in d.select(media.stable_group_id(F.col("k"), 2)).collect()][:2] == [fold(b"00ff", 2), fold(b"ab", 2)]


def _picture(kind, h=48, w=64):
    y, x = np.mgrid[0:h, 0:w] / (h / 48)
    rgb = np.stack([128 + 60 * np.sin(x / 5) + 40 * np.cos(y / 7), 128 + 50 * np.cos(x / 9 + y / 4), 120 + 70 * np.sin((x + y) / 11)], -1)
    if kind == "bright":
        rgb = rgb + 12
    if kind == "warm":
        rgb = rgb * np.array([1.06, 1.0, 0.94])
    if kind == "mark":
        part = (y >= 38) & (y < 46) & (x >= 40) & (x < 62)
        rgb[part] = 0.85 * rgb[part] + 35
    if kind == "other":
        rgb = np.stack([((x // 8 + y // 6) % 2) * 255] * 3, -1)
    return b"P6\n%d %d\n255\n" % (w, h) + np.clip(rgb, 0, 255).astype(np.uint8).tobytes()


def test_image_decisions():
    base = images.image_features(_picture("base"))
    d = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    for kind, size in (("bright", (48, 64)), ("warm", (48, 64)), ("mark", (48, 64)), ("base", (96, 128)), ("other", (48, 64))):
        f = images.image_features(_picture(kind, *size))
        pdq = sum(d(a, b) for a, b in zip(base["image_pdq"], f["image_pdq"], strict=True))
        tiles = sorted(d(a, b) for a, b in zip(base["image_zoned_phashes"], f["image_zoned_phashes"], strict=True))
        edge, trimmed, share = images.compare_planes(base["plane"], f["plane"])
        primary = pdq <= 31 or d(base["image_dhash"], f["image_dhash"]) <= 4
        structure = edge >= 780_000 and trimmed >= 930_000 and share >= 750_000
        assert (primary and structure) == (kind != "other"), (kind, pdq, tiles, edge, trimmed, share)
    same = images.compare_planes(base["plane"], base["plane"])
    assert same == (1_000_000, 1_000_000, 1_000_000)
    assert images.image_features(b"P3 1 1 255 1 2 3")["width"] == 1
    for bad in (b"", b"P6", b"P6\n4 4\n255\nxx", b"GIF89a", None):
        assert images.image_features(bad)["error"]


def test_planes_leave_in_small_batches(spark):
    """Features are those of each image, whatever the batches; planes only where asked for."""
    rows = [(i, _picture(i % 3, 8 + i, 9) if i % 5 else b"bad") for i in range(150)] + [(150, None)]
    df = spark.createDataFrame(rows, "id long, content binary").coalesce(1)
    wide = images.with_features(df).collect()
    assert {r["id"]: r["plane"] for r in wide} == {i: images.image_features(x)["plane"] for i, x in rows}
    assert [f.name for f in images.with_features(df, plane=False).schema] == ["id", *[f.name for f in images.FEATURES if f.name != "plane"]]

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    assert max(r["n"] for r in images.with_features(df).mapInArrow(sizes, "n long").collect()) < 32 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    pairs = spark.createDataFrame([(0, wide[1]["plane"], wide[4]["plane"]), (1, None, wide[1]["plane"]), (2, wide[1]["plane"], wide[1]["plane"])], "id long, a binary, b binary")
    found = {r["id"]: r["c"] for r in images.with_comparison(pairs, "a", "b").collect()}
    assert tuple(found[0]) == images.compare_planes(wide[1]["plane"], wide[4]["plane"]) and found[1] is None and found[2]["edge_zncc"] == 1_000_000


def test_config(tmp_path):
    with pytest.raises(config.ConfigError):
        config.Config(low_quality=gates.Profile(pdq_max=31, fallback_dhash_max=9))
    with pytest.raises(config.ConfigError):
        config.Config(pdq_min_quality=101)
    path = str(tmp_path / "c.json")
    config.save(config.Config(pdq_min_quality=60), path)
    config.save(config.Config(pdq_min_quality=70), path)
    assert config.load(path).pdq_min_quality == 70
    with open(path, "w") as f:
        f.write("{")
    assert config.load(path).pdq_min_quality == 60


def test_schema_contract(spark):
    assert schemas.validate_schema(spark.createDataFrame([], schemas.PATHS), schemas.PATHS) == []
    assert schemas.validate_schema(spark.range(1), "id int, x string") == ["id: expected int, found bigint", "x: expected string, found none"]


@pytest.mark.parametrize(("radius", "parts"), [(2, 3), (2, 6), (3, 8), (7, 6), (12, 8)])
def test_hot_segments_are_avoided_or_dealt(spark, monkeypatch, radius, parts):
    """Half of all different words share a segment, most of the others two."""
    from twinsift.operators import joins

    rng = random.Random(radius)
    words = []
    for i in range(220):
        w = words[-1][1] & (1 << 64) - 1 if words and not i % 5 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(radius + 2)):
            w ^= 1 << b
        w = w >> 24 if i % 2 else w & ~((1 << 24) - 1) if i % 3 else w
        words.append((i, signed(w)))
    df = spark.createDataFrame(words, "id long, w long")
    monkeypatch.setattr(joins.join_tiled, "__defaults__", (50, 10))
    monkeypatch.setattr(simjoin.choose, "__defaults__", ("w", 50, 10))
    monkeypatch.setattr(simjoin.index_rows, "__defaults__", (50, 10))
    rows = [tuple(r) for r in simjoin.hamming_pairs(df, "id", "w", radius, parts=parts).collect()]
    want = {(a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for a, x in words for b, y in words if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= radius}
    assert len(rows) == len(set(rows)) and set(rows) == want
    blocking = simjoin.words(radius, 64, parts)
    index = simjoin.index_rows(df, blocking)
    assert index.count() == len(words) * blocking.need
    if parts - blocking.need >= 24 // bits.segment_widths(64, parts)[0]:  # rows that have the choice leave the values of half of all rows aside
        assert index.where("seg = 0 AND key = 0").count() < len(words) // 10


def test_exploded_segments_are_not_broadcast(spark):
    """A file of few words is small, its 288 index and probe rows a word are not."""
    words = materialize(spark.range(40).selectExpr("id", "array(id, id * 7919, id * 104729, id * 1299709) AS w"), "words")
    plan = simjoin.hamming_pairs_wide(words, "id", "w", 31)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_copies_of_words_meet_once(spark, monkeypatch):
    """Three hundred rows of six words: six rows are joined, and every pair of rows comes out once."""
    joined, own = [], simjoin.index_rows
    monkeypatch.setattr(simjoin, "index_rows", lambda rows, *more: (joined.append(rows.count()), own(rows, *more))[1])
    rows = [(i, [0, 1, 3, 255, 254, 1 << 40][i % 6]) for i in range(300)] + [(7, 99), (0, None)]
    got = [tuple(r) for r in simjoin.hamming_pairs(spark.createDataFrame(rows, "id long, w long"), "id", "w", 2).collect()]
    want = [(a, b, bin(x ^ y).count("1")) for (a, x), (b, y) in itertools.combinations(sorted(rows[:300] + [(7, 99)]), 2) if a != b and bin(x ^ y).count("1") <= 2]
    assert sorted(got) == sorted(want) and joined == [7]


def test_tiles_bound_what_a_task_meets(spark):
    from twinsift.operators.joins import join_tiled

    left = spark.createDataFrame([(i, 1 if i % 2 else i) for i in range(200)], "a long, k long")
    right = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(150)], "b long, k long")
    got = [tuple(r) for r in join_tiled(left, right, ["k"], "a", "b", hot_keys=5, hot_rows=20).select("a", "b", "k").collect()]
    want = {(a, b, k) for a, k in ((i, 1 if i % 2 else i) for i in range(200)) for b, m in ((i, 1 if i % 3 else i) for i in range(150)) if k == m}
    assert len(got) == len(want) and set(got) == want


def test_segment_index_grows_by_batches(spark, tmp_path):
    """Batches one after the other give the pairs and components of the whole; a repeated batch changes nothing."""
    rng = random.Random(4)
    base = [rng.getrandbits(40) for _ in range(30)]
    words = [(i, signed(rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))) for i in range(160)]
    near = {(a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for a, x in words for b, y in words if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= 3}
    blocking, found, parts = simjoin.words(3, 64, 6), [], None
    for n in (0, 1, 2, 2):
        index = segment_index.SegmentIndex(spark, f"file://{tmp_path}/index", blocking, buckets=4, hot_rows=8)
        rows = spark.createDataFrame([w for w in words if (0 if w[0] % 10 < 8 else w[0] % 10 - 7) == n] + [(None, 1)], "id long, w long")
        edges = index.extend(n, rows)
        if n == 2 and found[-1][0] == 2:
            assert sorted(map(tuple, edges.collect())) == sorted(found[-1][1])
            continue
        found.append((n, list(map(tuple, edges.collect()))))
        stored = spark.createDataFrame([], "id long, component long") if parts is None else parts
        parts = spark.createDataFrame(segment_index.merge_components(stored, edges).collect(), "id long, component long")
    pairs = [e for _, rows in found for e in rows]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near
    low = {x: x for e in near for x in e[:2]}
    for _ in low:
        for a, b, _ in near:
            low[a] = low[b] = min(low[a], low[b])
    assert {(r["id"], r["component"]) for r in parts.collect()} == set(low.items())
    # the index is read as it lies: of its two sides only the probing one is exchanged
    plan = index.find(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(slot") == 1


def feed_rows(n=900, feeds=2, keys=130):
    rng = random.Random(7)
    return [(f"f{rng.randrange(feeds)}", i, 1000 + i, "info", rng.randrange(keys), "ta\nsk", "stage", "run", f"s{i}", rng.choice(["a\tb", None]), 0, rng.choice([None, 5]), rng.choice([None, 0, 1, 3])) for i in range(n)]


def replayed(rows, capacity, window):
    """A list a feed, searched from its end."""
    lists, dropped, ids, sequences = {}, {}, {}, {}
    for f, _, ms, sev, task_id, task, stage, op, subject, message, status, native, repeats in rows:
        entries = lists.setdefault(f, [])
        key = (sev, task_id, task.replace("\n", " "), stage, op, status, native)
        sequences[f] = sequences.get(f, 0) + 1
        repeats = max(repeats or 1, 1)
        at = next((i for i in reversed(range(max(0, len(entries) - window), len(entries))) if entries[i]["key"] == key), None)
        if at is None:
            ids[f] = ids.get(f, 0) + 1
            entry = {"key": key, "id": ids[f], "n": 0, "subject": subject, "message": None if message is None else message.replace("\t", " ")}
        else:
            entry = entries.pop(at)
        entries.append(entry | {"n": entry["n"] + repeats, "sequence": sequences[f], "ms": ms})
        if len(entries) > capacity:
            entries.pop(0)
            dropped[f] = dropped.get(f, 0) + 1
    live = {(f, e["id"], e["sequence"], e["ms"], e["n"], e["key"][1], e["subject"], e["message"]) for f, es in lists.items() for e in es}
    return live, {(f, n, dropped.get(f, 0)) for f, n in sequences.items()}


@pytest.mark.parametrize("cuts", [[900], [1, 10, 450, 900]])
def test_feed_equals_a_plain_replay_under_any_cut(spark, tmp_path, cuts):
    from twinsift.streaming import feed

    rows, source, base, low = feed_rows(), f"file://{tmp_path}/in", f"file://{tmp_path}/out", 0
    for high in cuts:
        spark.createDataFrame(rows[low:high], feed.INPUT).repartition(3).write.mode("append").parquet(source)
        low = high
        run = feed.run(spark.readStream.schema(feed.INPUT).parquet(source), base, capacity=70, window=20)
        run.awaitTermination()
        assert run.exception() is None
        live, counts = replayed(rows[:high], 70, 20)
        got = feed.snapshot(spark, base).collect()
        assert {(r["feed"], r["entry_id"], r["sequence"], r["utc_ms"], r["repeat_count"], r["task_id"], r["subject"], r["message"]) for r in got} == live and len(got) == len(live)
        assert {tuple(r) for r in feed.counters(spark, base).collect()} == counts
    assert {r["sequence"] for r in feed.snapshot(spark, base, 400).collect()} == {e[2] for e in live if e[2] > 400}
    assert any(d for _, _, d in counts)


def test_feed_task_holds_a_piece_and_the_state(spark):
    """Dropped entries leave with the piece that drops them, and only the feed's capacity is kept to the end."""
    import pyarrow as pa

    from twinsift.streaming import feed

    names, read = [c.split()[0] for c in feed.INPUT.split(", ")], []

    def pieces():
        for n in range(20):
            read.append(n)
            rows = [dict(zip(names, r, strict=True)) | {"state": None, "feed": "f", "task_id": n * 50 + i} for i, r in enumerate(feed_rows(50))]
            yield pa.RecordBatch.from_pylist(rows)

    sizes = [(len(read), b.num_rows) for b in feed._fold(30, 10)(pieces())]
    assert sizes[0] == (1, 20) and max(n for _, n in sizes) <= 50 and len(sizes) == 21


def test_published_sequences_survive_a_replay(spark, tmp_path):
    ops = [(s, k, key, f"p{i}", i) for i, (s, k, key) in enumerate((random.Random(i).randrange(2), random.Random(i + 99).choice(["upsert", "delete"]), random.Random(i * 3).randrange(9)) for i in range(60))]
    schema, base = "batch_scan_id long, kind string, key long, payload string, arrival long", f"file://{tmp_path}/q"
    want, low = [], 1
    for number, part in enumerate((ops[:20], [], ops[20:25], ops[25:])):
        df = spark.createDataFrame(part, schema)
        outbox.publish_batch(df, number, base)
        if number != 1:
            outbox.publish_batch(df.repartition(3), number, base)  # delivered again
        last = {(s, key, k): (s, k, key, p, a) for s, k, key, p, a in part}
        want += [(*last[x], low + i) for i, x in enumerate(sorted(last))]
        low += len(last)
    got = sorted((tuple(r) for r in outbox.published(spark, base, schema).select("batch_scan_id", "kind", "key", "payload", "arrival", "sequence").collect()), key=lambda r: r[5])
    assert got == want and [r[5] for r in got] == list(range(1, low))


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    import os

    from twinsift.plans.merged_table import MergedTable

    schema, base = "k long, v string, n int", str(tmp_path / "t")
    table = MergedTable(spark, f"file://{base}", schema, "k", buckets=8)
    change = lambda rows: spark.createDataFrame(rows, "k long, v string, n int, kind string, sequence long")
    assert table.read().count() == 0 and table.merge(change([])) == []
    held = {k: (f"v{k}", k % 5) for k in range(100)}
    assert table.merge(change([(k, *v, "upsert", 1) for k, v in held.items()])) == list(range(8))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{base}/data") for f in fs if f.endswith(".parquet")}
    before = files()
    touched = table.merge(change([(3, "x", 1, "upsert", 1), (3, "new", 9, "upsert", 2), (4, "v4", 0, "delete", 1), (5, "other", 0, "delete", 1), (777, "add", 0, "upsert", 1)]), compare=("v",))
    held |= {3: ("new", 9), 777: ("add", 0)}
    held.pop(4)
    assert {r["k"]: (r["v"], r["n"]) for r in table.read().collect()} == held
    assert 0 < len(touched) < 8 and all(files()[f] == t for f, t in before.items())
    manifest = MergedTable(spark, f"file://{base}", schema, "k", buckets=8).manifest()
    assert {b for b, g in manifest.items() if g == max(manifest.values())} <= set(touched) and all(g == 1 for b, g in manifest.items() if b not in touched)
    # a failed merge leaves the table as it was; the next one does not read what it left
    with pytest.raises(Exception):
        table.merge(change([(3, "bad", 1, "upsert", 3)]), derive=lambda rows: rows.withColumn("n", F.raise_error(F.lit("stop")).cast("int")))
    assert {r["k"]: (r["v"], r["n"]) for r in table.read().collect()} == held
    table.merge(change([(k, None, None, "delete", 1) for k in held]))
    table.vacuum()
    assert table.read().count() == 0
    table.merge(change([(1, "back", 1, "upsert", 1)]))
    table.vacuum()
    assert [tuple(r) for r in table.read().collect()] == [(1, "back", 1)] and len(files()) <= 9


def test_many_roots_equal_the_prefix_rule(spark, monkeypatch):
    from twinsift.operators import joins

    rng = random.Random(2)
    names = ["a", "b", "ab", "c d"]
    folder = lambda n: "\\".join(["d:"] + [rng.choice(names) for _ in range(n)])
    paths = sorted({folder(rng.randrange(6)) for _ in range(150)}) + ["x", "", "e:\\z"] + ["d:\\a\\same"] * 40 + [None]
    roots = sorted({(folder(rng.randrange(4)) + rng.choice(["", "\\"]), rng.randrange(5)) for _ in range(40)})
    monkeypatch.setattr(joins.join_counted, "__defaults__", ("n", 50, 3))
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(paths)], "id long, path string, root string")
    r = spark.createDataFrame(roots, "root string, priority int")
    got = {x["id"]: (x["root"], x["priority"]) for x in ingest.assign_root(df, r).collect()}
    under = lambda p, root: p == root.rstrip("\\") or p.startswith(root.rstrip("\\") + "\\")
    want = {i: min(((n, x) for x, n in roots if p is not None and under(p, x)), default=(None, None))[::-1] for i, p in enumerate(paths)}
    assert got == want
    uncovered = {tuple(x) for x in ingest.uncovered_roots(r).collect()}
    assert uncovered == {(x, n) for x, n in roots if not any(m < n and under(x, y) for y, m in roots)}


def test_routed_paths_read_the_paths_once(spark, monkeypatch):
    from twinsift.operators import joins

    monkeypatch.setattr(joins.join_tiled, "__defaults__", (50, 5))
    paths = spark.createDataFrame([(i, f"s{i % 7 if i % 2 else 1}", i % 5 != 0) for i in range(80)], "path_id long, sha string, active boolean")
    groups = spark.createDataFrame([("s1", 10, "x"), ("s3", 11, None)], "sha string, root long, note string")
    skipped = spark.createDataFrame([("s1", "why"), ("s9", "none")], "sha string, reason string")
    out = report.route_paths(paths, {"groups": groups, "skipped": skipped})
    rows = [tuple(r) for r in paths.collect() if r["active"]]
    assert sorted(map(tuple, out["groups"].collect())) == sorted((*r, *g[1:]) for r in rows for g in [("s1", 10, "x"), ("s3", 11, None)] if r[1] == g[0])
    assert sorted(map(tuple, out["skipped"].collect())) == sorted((*r, "why") for r in rows if r[1] == "s1")


def test_parts_of_a_block_are_independent(spark):
    """Nodes that share an edge of the block or an earlier group are one part; a third node between them keeps them together."""
    inside = spark.createDataFrame([(10, 11), (11, 12), (20, 21)], "a long, b long")
    groups = spark.createDataFrame([(12, 1), (30, 1), (31, 2), (32, 2), (33, 2), (40, 3)], "b long, root long")
    parts = {r["b"]: r["part"] for r in cluster.block_parts(inside, groups).collect()}
    assert parts == {10: 10, 11: 10, 12: 10, 30: 10, 20: 20, 21: 20, 31: 31, 32: 31, 33: 31}
    # one chain of a thousand near cliques is one component; its blocks fall into many parts
    rng, n = random.Random(9), 300
    edges = sorted({(a, b): rng.randrange(3) for c in range(n) for a in range(4 * c, 4 * c + 5) for b in range(a + 1, 4 * c + 5) if rng.random() < 0.95}.items())
    edges = [(a * 7919 % 10_007, b * 7919 % 10_007, d) for (a, b), d in edges]
    edges = [(min(a, b), max(a, b), d) for a, b, d in edges]
    df = spark.createDataFrame(edges, "left_id long, right_id long, distance int")
    got, _ = cluster.complete_link(df, task_edges=600)
    assert {r["id"]: r["root"] for r in got.collect()} == cluster.greedy(edges)


def test_walk_lists_by_level_and_digests_in_blocks(spark, tmp_path):
    import os
    import tracemalloc

    from twinsift.sources import walk

    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    data = {"x.JPG": b"1", "a/y.mp4": b"22", "a/b/c/z z.txt": b"333", "a/b/e%20.bin": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    os.symlink(tmp_path / "a", tmp_path / "a/b/loop")
    found = walk.walk(spark, [f"file://{tmp_path}", str(tmp_path / "missing")]).cache()
    assert {r["path"]: r["size_bytes"] for r in walk.files_of(found).collect()} == {str(tmp_path / n): len(c) for n, c in data.items()}
    assert tuple(walk.totals(found).first()) == (6, 4, 1, 1, 6)
    got = {r["path"]: (r["sha512"], r["status"]) for r in walk.digests(found.where("kind = 'file'").unionByName(found.where("kind = 'error'")), block=2).collect()}
    assert got == {str(tmp_path / n): (hashlib.sha512(c).hexdigest(), "ok") for n, c in data.items()} | {str(tmp_path / "missing"): (None, "error")}
    # a file that changes while it is read
    path = str(tmp_path / "x.JPG")

    def growing(name, mode, buffering):
        with open(path, "ab") as file:
            file.write(b"more")
        return open(name, mode, buffering=buffering)

    assert walk.digest(path, opened=growing)[3:] == (None, "changed", None)
    # memory is a block's, not the file's
    with open(tmp_path / "large", "wb") as file:
        file.truncate(300 << 20)
    tracemalloc.start()
    assert walk.digest(str(tmp_path / "large"))[4] == "ok" and tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()
