"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from twinsift.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if hasattr(v, "item"):
        v = v.item()
    return str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.6g}" if isinstance(v, float) else str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(_plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert _rows(catalog.QUERIES[name](spark, D).toPandas()) == _rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def near_edges(duck, radius=2):
    words = duck.sql("WITH " + catalog.tables.SIGNATURES + " SELECT id, w16 FROM signatures ORDER BY id").fetchall()
    return {(a, b): bin(x ^ y).count("1") for k, (a, x) in enumerate(words) for b, y in words[k + 1 :] if bin(x ^ y).count("1") <= radius}


def plain_complete_link(edges):
    """Nodes in order; each joins the best earlier group to all of whose members it has an edge, else founds one."""
    d = lambda a, b: edges.get((min(a, b), max(a, b)))
    groups = []
    for node in sorted({x for pair in edges for x in pair}):
        fits = [(max(d(node, m) for m in g), sum(d(node, m) for m in g) / len(g), g[0], g) for g in groups if all(d(node, m) is not None for m in g)]
        if fits:
            min(fits)[3].append(node)
        else:
            groups.append([node])
    return {m: g[0] for g in groups for m in g}


def test_clusters_equal_plain_rule(spark, duck):
    edges = near_edges(duck)
    roots = plain_complete_link(edges)
    assert len(edges) > 50
    assert {r["id"]: r["root"] for r in catalog.QUERIES["complete_link_groups"](spark, D).collect()} == roots
    across = {(a, b) for pair in edges for a, b in (pair, pair[::-1]) if roots[a] != roots[b]}
    got = catalog.QUERIES["cross_relations"](spark, D).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == across and len(got) == len(across)
    size = dict(duck.sql("WITH " + catalog.tables.SIGNATURES + " SELECT id, ms FROM signatures").fetchall())
    members = {}
    for m, r in roots.items():
        members.setdefault(r, []).append(m)
    want = {}
    for r, own in members.items():
        if len(own) > 1:
            sizes, mean = [size[m] for m in own], sum(edges[r, m] for m in own if m != r) / (len(own) - 1)
            want[r] = (len(own), sum(sizes) - min(sizes), round(mean, 9))
    rows = catalog.QUERIES["similar_report"](spark, D).orderBy("ordinal").collect()
    assert {r["root"]: (r["member_count"], r["reclaimable_bytes"], round(r["average_distance"], 9)) for r in rows} == want
    assert [r["root"] for r in rows] == sorted(want) and [r["ordinal"] for r in rows] == list(range(len(want)))
    assert {r["root"]: r["group_id"] for r in rows} == {r: plain_fold(str(r).encode(), 1) for r in want}


def plain_fold(data, kind=0):
    value = catalog.media.FNV_START ^ kind
    for b in data:
        value = (value ^ b) * catalog.media.FNV_PRIME & (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def test_clusters_of_classes_equal_plain_rule(spark, duck):
    words = duck.sql("WITH " + catalog.tables.SIGNATURES + " SELECT id, w16 FROM signatures ORDER BY id").fetchall()
    rep = {}
    for i, w in words:
        rep.setdefault(w, i)
    reps = sorted((i, w) for w, i in rep.items())
    edges = {(a, b): bin(x ^ y).count("1") for k, (a, x) in enumerate(reps) for b, y in reps[k + 1 :] if bin(x ^ y).count("1") <= 2}
    roots = plain_complete_link(edges)
    members = [(i, rep[w]) for i, w in words]
    copies = {r for i, r in members if i != r}
    want = {i: roots.get(r, r) for i, r in members if r in roots or r in copies}
    assert {r["id"]: r["root"] for r in catalog.QUERIES["complete_link_classes"](spark, D).collect()} == want and want


def test_group_ids_equal_plain_fold(spark):
    rows = catalog.QUERIES["group_ids"](spark, D).collect()
    assert rows and all(r["group_id"] == plain_fold(bytes.fromhex(r["sha"])) for r in rows)
    assert len({r["group_id"] for r in rows}) == len(rows) == catalog.QUERIES["exact_groups"](spark, D).count()


def test_picture_queries(spark, duck):
    """Every picture has features, scores stay in their ranges, and the two brightnesses of a picture mostly meet in one group."""
    n = duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    features = catalog.QUERIES["image_features"](spark, D).collect()
    assert len(features) == n and all(r["error"] is None and (r["width"], r["height"]) == (16, 4) and len(r["image_pdq"]) == 4 and len(r["image_zoned_phashes"]) == 16 for r in features)
    gate = catalog.QUERIES["structural_gate"](spark, D).collect()
    assert all(abs(r["edge_zncc"]) <= 1_000_000 and 0 <= r["passing_share"] <= 1_000_000 and r["accepted"] in (True, False) for r in gate if r["edge_zncc"] is not None)
    groups = {r["id"]: r["root"] for r in catalog.QUERIES["image_pipeline"](spark, D).collect()}
    assert all(root <= i and groups.get(root) == root for i, root in groups.items())
    pairs = [i // 2 for i in groups if i % 2 == 0 and i + 1 in groups]
    assert len(pairs) > n // 2 and sum(groups[2 * i] == groups[2 * i + 1] for i in pairs) > len(pairs) // 2


def test_manifest_holds_all_paths(spark, monkeypatch):
    written, write = [], catalog.files.write_manifest
    monkeypatch.setattr(catalog.files, "write_manifest", lambda rows, folder: (written.append(folder), write(rows, folder)))
    catalog.QUERIES["manifest_round_trip"](spark, D).collect()
    columns = ["path", "storage_target_key", "size_bytes"]
    read = catalog.files.read_manifest(spark, written[0]).select(columns).collect()
    want = catalog.tables.paths(spark, D).withColumnRenamed("full_path", "path").select(columns).collect()
    assert sorted(map(tuple, read)) == sorted(map(tuple, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_structural_gate_stores_no_planes(spark, monkeypatch):
    """Stored planes come back thousands at a time, hundreds of MB a task; scores are those of both pictures' features."""
    stored, keep = [], catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, *a, **b: (stored.extend(df.columns), keep(df, *a, **b))[1])
    got = {r["vec_id"]: (r["edge_zncc"], r["trimmed_block"], r["passing_share"], r["accepted"]) for r in catalog.QUERIES["structural_gate"](spark, D).collect()}
    assert "plane" not in stored
    made = {r["vec_id"]: catalog.images.image_features(bytes(r["content"])) for r in catalog._pictures(spark, D).where("vec_id < 20").collect()}
    for i in range(19):
        a, b = made[i], made[i + 1]
        edge, block, share = want = catalog.images.compare_planes(a["plane"], b["plane"])
        low = min(a["image_pdq_quality"], b["image_pdq_quality"]) < 50
        own = catalog.gates.LOW_QUALITY if low else catalog.gates.STANDARD
        assert got[i] == (*want, edge >= own.edge_min and block >= own.trimmed_block_min and share >= own.passing_share_min)


def test_image_pipeline_stores_no_planes(spark, monkeypatch):
    stored, keep = [], catalog.materialize
    for module in (catalog, catalog.similar):
        monkeypatch.setattr(module, "materialize", lambda df, *a, **b: (stored.append(df.columns), keep(df, *a, **b))[1])
    assert catalog.QUERIES["image_pipeline"](spark, D).count() > 0
    assert len(stored) > 5 and not any("plane" in columns for columns in stored)
