"""Line dedup, n-gram join and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from twinsift.llm import line_dedup, ngram_join, queries

SCHEMA = "doc_id long, text string, rep long, gone string"


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]) + str(rng.randrange(60)) for _ in range(n)]


def corpus(seed=1, docs=160):
    """Near copies with a few words changed, exact copies, short, empty and null texts."""
    rng = random.Random(seed)
    bases = [words(rng, rng.choice([3, 6, 40, 120])) for _ in range(30)]
    out = []
    for i in range(docs):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(5))
        lines, at = [], 0
        while at < len(w):
            n = rng.randrange(3, 16)
            lines.append(" ".join(w[at : at + n]))
            at += n
        out.append((i * 3, "\n".join(lines)))
    return out + [(1000, ""), (1001, None), (1002, ""), (1003, "!!!"), (1004, "!!!"), (None, "alpha1 beta2"), (1005, "z " * 30000), (0, out[0][1])]


def brute_classes(docs, threshold=0.8):
    rows = [(i, t) for i, t in docs if i is not None and t is not None]
    sets = [frozenset(ngram_join.shingles(ngram_join.words_of(t)).tolist()) or frozenset([t]) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[rows[a][0], a] += 1
                links[rows[b][0], b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, find(i), links[i, k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicate_classes(spark, block):
    docs = corpus()
    got = ngram_join.near_duplicate_classes(spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA), block=block).collect()
    rows = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got if r["doc_id"] not in (None, 1001))
    want = [r for r in brute_classes(docs) if r[0] != 1001]
    assert [r[:2] for r in rows] == [r[:2] for r in want] and rows == want
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got if r["doc_id"] in (None, 1001)} == {(None, None, 0), (1001, 1001, 0)}


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicate_classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0
    docs = corpus(2)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    want = sorted({c for _, c, _ in brute_classes(docs)} | {1001})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want and kept.where("doc_id IS NULL").count() == 1


def test_bands_reach_recall():
    bands, rows = ngram_join.choose_bands()
    assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.999
    rng, hit, tries = random.Random(3), 0, 400
    for _ in range(tries):
        a = {rng.getrandbits(64) for _ in range(90)}
        rest = {rng.getrandbits(64) for _ in range(10)}
        b = set(list(a)[:80]) | rest  # 80 of 110
        x, y = (ngram_join.band_hashes(np.array(sorted(s), np.uint64), bands, rows) for s in (a, b))
        hit += bool(set(x.tolist()) & set(y.tolist()))
    j = 80 / 110
    assert abs(hit / tries - (1 - (1 - j**rows) ** bands)) < 0.03


def test_near_duplicate_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in queries.op1_ngram_join(spark, sf).select("doc_id", "class_id", "n_links").collect()) == brute_classes(docs)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def one_edit(a, b):
    """At most one insertion, deletion or replacement; the sets are compared first as that is faster."""
    return abs(len(a) - len(b)) <= 1 and len(set(a) ^ set(b)) <= 2 and edit_distance(a, b) <= 1


def plain_near(a, b):
    """Lines as strings: one word apart with five words or more, or one character apart with ten characters or more and under ten words."""
    x, y = a.split(), b.split()
    return (max(len(x), len(y)) >= 5 and one_edit(x, y)) or (max(len(a), len(b)) >= 10 and min(len(x), len(y)) < 10 and one_edit(a, b))


def brute_lines(docs):
    """Kept text of each document: every line against every earlier line."""
    by_words, by_chars, seen, out = defaultdict(list), defaultdict(list), set(), {}
    for i, text in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        if i in out:
            continue
        kept = []
        for line in text.split("\n"):
            if not line.split():
                kept.append(line)
                continue
            plain = " ".join(line.lower().split())
            n, m = len(plain.split()), len(plain)
            if plain not in seen:
                # lines further apart in both lengths cannot be near
                others = {o for d in (-1, 0, 1) for o in by_words[n + d] + (by_chars[m + d] if n <= 10 else [])}
                if not any(plain_near(plain, o) for o in others):
                    kept.append(line)
                seen.add(plain)
                by_words[n].append(plain)
                by_chars[m].append(plain)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize(
    ("a", "b", "linked"),
    [
        ("one two three four five six seven eight nine ten", "one two three four five six seven eight nine", True),
        ("one two three four five six seven eight nine", "one two three four five six seven other nine", True),
        ("one two three four five", "one two three four", True),
        ("one two three four", "one two three", False),
        ("one two three four", "one two three other", False),
        ("abcdefghij", "abcdefghi", True),
        ("abcdefghi", "abcdefghx", False),
        ("one two threefour", "one two three four", True),
        ("a b c d e f g h i jk", "a b c d e f g h ijk", True),
        ("a b c d e f g h i j kl", "a b c d e f g h i jkl", False),
        ("one two three four five six seven", "one two three other other six seven", False),
    ],
)
def test_lines_at_the_limits(spark, a, b, linked):
    assert plain_near(a, b) == linked == line_dedup.near(a, b) == line_dedup.near(b, a)
    rows = line_dedup.duplicate_lines(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == ([(2, 0, 1)] if linked else [])


def test_line_dedup_short_long_and_hot(spark, monkeypatch):
    """Lines of a few characters, one of very many words, and lines that most documents share."""
    from twinsift.operators import joins

    rng = random.Random(12)
    base = ["}", "a b", "page 12 of 20", "same footer line", "one two three four five six seven eight nine ten eleven"]
    docs = []
    for i in range(150):
        lines = [rng.choice(base) for _ in range(3)] + [f"Line number {rng.randrange(40)} of this table", f"the text {rng.choice('abc')}{i % 7} is one of very many that differ in a single word only", ""]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(900, "x" * 12), (901, "x" * 13), (902, "x" * 12 + "é"), (903, "é" * 9), (904, "é" * 9), (905, "é" * 8), (906, "a a a a a a a a a a a"), (907, "a a a a a a a a a a"), (908, "A  a a a a a a a a\ta b"), (909, "four words or five"), (910, "four words or five now"), (911, "x" * 9)]
    want = brute_lines(docs)
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    docs += [(1000, long), (1001, long + " more"), (1002, "less " + long)]
    want |= {1000: long, 1001: "", 1002: ""}
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df).collect()} == want
    monkeypatch.setattr(joins.join_counted, "__defaults__", ("n", 50, 3))  # many hot keys in small parts
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df).collect()} == want


def test_line_dedup(spark):
    docs = corpus(4, 120)
    rng = random.Random(8)
    tail = []
    for i, (_, t) in enumerate(docs[:60]):  # lines with a word added, lost or replaced
        lines = [x.split() for x in t.split("\n")]
        for w in lines:
            k = rng.randrange(4)
            at = rng.randrange(len(w)) if w else 0
            if w and k == 0:
                w.insert(at, "added")
            elif w and k == 1:
                w.pop(at)
            elif w and k == 2:
                w[at] = "other"
        tail.append((2000 + i, "\n".join(" ".join(w).upper() for w in lines)))
    docs += tail
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)
    got = line_dedup.drop_lines(df)
    assert got.columns == [*df.columns, "lines_dropped"]
    rows, want = got.collect(), brute_lines(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["text"] == (want[r["doc_id"]] if r["doc_id"] in want else dict(docs)[r["doc_id"]]), r["doc_id"]
    assert sum(r["lines_dropped"] for r in rows) > 100
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_units_are_hashed_once(monkeypatch):
    """Both sums of a line's variants use the same hashes, and what depends on a line's length only is worked out once."""
    real, digests, inverses = line_dedup.xxhash.xxh3_64_intdigest, [], []
    monkeypatch.setattr(line_dedup.xxhash, "xxh3_64_intdigest", lambda x: digests.append(x) or real(x))
    words = [f"w{i}" for i in range(53)]
    assert sum(len(at) for _, _, at in line_dedup.variants(words, np.arange(53))) == 54
    assert len(digests) == 53
    line_dedup.window_keys(words)
    monkeypatch.setattr(line_dedup, "pow", lambda *x: inverses.append(x) or pow(*x), raising=False)
    keys = line_dedup.window_keys(words[::-1])
    assert not inverses and len(keys) == 2 * line_dedup.WINDOWS
    # beyond the powers that are kept, too: a line's sums are those of its units
    long = np.arange(line_dedup.KNOWN_POWERS + 2, dtype=np.uint64)
    base = line_dedup._BASES[0]
    assert int(line_dedup.Sums(long, base).upto[-1]) == sum(i * pow(base, i, 1 << 64) for i in range(len(long))) % (1 << 64)


@pytest.mark.parametrize("kind", ["words", "characters"])
def test_half_keys_meet(kind):
    rng, least = random.Random(6), {"words": 5, "characters": 10}[kind]
    tries = 0
    while tries < 1500:
        a = [str(rng.randrange(9)) for _ in range(rng.randrange(least - 1, 45))]
        b = list(a)
        at = rng.randrange(len(b))
        k = rng.randrange(3)
        if k == 0:
            b[at] = "x"
        elif k == 1:
            b.insert(at, "x")
        else:
            b.pop(at)
        if max(len(a), len(b)) < least:
            continue
        tries += 1
        if kind == "characters":
            a, b = "".join(a), "".join(b)
        assert set(line_dedup.half_keys(a)) & set(line_dedup.half_keys(b))
        assert edit_distance(a, b) == 1 and line_dedup.within_one(a, b)
        shared = {key: (lo, hi) for key, lo, hi in line_dedup.window_keys(a)}
        found = [(shared[key], (lo, hi)) for key, lo, hi in line_dedup.window_keys(b) if key in shared]
        assert found and all(a[:p] + a[q:] == b[:r] + b[s:] for (p, q), (r, s) in found)
        va, vb = ({v for w in side for x in line_dedup.variants(line, np.arange(*w)) for v in zip(*(c.tolist() for c in x), strict=True)} for line, side in ((a, [f[0] for f in found]), (b, [f[1] for f in found])))
        assert {v for v in va if v[2] >= 0} & {v for v in vb if v[2] >= 0} if k == 0 else {v[:2] for v in va} & {v[:2] for v in vb}


@pytest.mark.parametrize("size", [3, 100_000])
def test_variants_are_hashes_of_what_is_left(monkeypatch, size):
    monkeypatch.setattr(line_dedup, "SLICE", size)
    rng = random.Random(9)
    seen = {}
    for _ in range(400):
        line = [rng.choice("abc") for _ in range(rng.randrange(2, 9))]
        for units in (line, "".join(line)):
            hi, lo, at = (np.concatenate(c) for c in zip(*line_dedup.variants(units, np.arange(len(units))), strict=True))
            for h, l, p in zip(hi.tolist(), lo.tolist(), at.tolist(), strict=True):
                left = units if p < 0 else units[:p] + units[p + 1 :]
                assert seen.setdefault((h, l), (type(left), tuple(left))) == (type(left), tuple(left))
    assert len(set(seen.values())) == len(seen)


def test_within_one_equals_edit_distance():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ([rng.choice("xy") for _ in range(rng.randrange(0, 6))] for _ in range(2))
        assert line_dedup.within_one(a, b) == (edit_distance(a, b) <= 1)


def test_line_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert {r["doc_id"]: r["text"] for r in queries.op2_line_dedup(spark, sf).collect()} == brute_lines(docs)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from twinsift.llm import quality
    from twinsift.plans.storage import materialize

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i: t for i, t in texts.items() if quality.apply(model, np.array([quality.features(t)]))[0] >= quality.CUT}
    cut = {i: t for i, t in brute_lines(list(good.items())).items() if t == good[i] or t.strip()}
    one = {c for _, c, _ in brute_classes(list(cut.items()))}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {r["doc_id"] for r in docs.collect()})
    assert seen[0] == good and seen[1] == cut and set(seen[2]) == one and set(seen[3]) == one and seen[4] == one
    assert all(seen[3][i] == cut[i] or "[secret]" in seen[3][i] for i in one)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == one


def test_pipeline_edges(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from twinsift.plans.storage import materialize

    long = " ".join(words(random.Random(1), 30000))
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "same words in this line\nsame words in this line", "en", "s", 46), (3, "same words in this line\nsame words in this line", "en", "s", 46), (4, long, "en", "s", len(long)), (None, "a null id stays here", "en", "s", 20), (5, "token = abcdef123456", "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data in (rows, []):
        docs = spark.createDataFrame([(*r, 1, "x") for r in data], schema + ", rep int, quality_score string")
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, str(tmp_path)))
            assert name == "best-fit packing" or docs.columns == corpus_pipeline.DOCUMENTS
            if name == "secret scans" and data:
                texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
                assert texts[1] == (None, 0) and texts[3] == ("same words in this line", 23) and texts[5] == ("[secret]", 8) and texts[None][0] == "a null id stays here"
        assert (docs.count() > 0) == bool(data)
