"""Operators of the optional subpackage that map texts: round trips, held-out accuracy and edge cases."""

import base64
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from twinsift.llm import bpe, chat, flac, langid, packing, quality, queries, secrets, spotsigs

D = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "a\x1cb \x1c c", "  two  spaces\t\ttab\r\nend  ", "nbsp\xa0\xa0x 　 y", "it's 'sx' I'LL", "<|endoftext|>", "é" * 40, "x" * 3000, "ab " * 30000, "1234 5678" * 50, "🙂🙃 zwj‍", "\\b\\l<turn>"]


def frame(spark, texts, **extra):
    rows = [(i, t, "copy", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, rep int")


def brute_bpe(name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_library_and_round_trips(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    want = brute_bpe("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_decode(frame(spark, ODD), path).collect()
    for r in got:
        text = r["text"] or ""
        assert np.frombuffer(r["bpe_ids"], "<u4").tolist() == want(text)
        assert bytes(r["bpe_bytes"]) == text.encode()
    assert bpe.encode_decode(frame(spark, []), path).count() == 0


def test_bpe_pieces_are_safe():
    own, want = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), brute_bpe("byte_bpe_50k.tiktoken")
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab1 é!\n\t '\xa0\x1cs") for _ in range(200))
        parts = bpe.pieces(text, rng.randrange(1, 40))
        assert "".join(parts) == text
        assert [i for p in parts for i in own.ids(p)] == want(text) == own.ids(text)


def test_bpe_query(spark):
    want = brute_bpe("byte_bpe_multi_50k.tiktoken")
    rows = {r["doc_id"]: r for r in queries.op3_bpe(spark, D).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall():
        ids = want(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_packing_ids_equal_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [x for x in ODD if x] + [x for (x,) in duckdb.sql(f"SELECT text FROM '{D}/documents.parquet'").fetchall()]
    for text in texts:
        assert own.ids(text) == t.encode(text, add_special_tokens=False).ids


def test_packing_ids_with_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [*ODD, f"a {end} b", end * 3, f"{end}x", f"  {end}\n\n {end}  ", f"<{end}>", end[:-1], "two  spaces " * 9000 + end + " tail " * 20000]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            want[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for rows in (queries.op9_packing(spark, str(tmp_path)).collect(), corpus_pipeline.pack_sequences(spark, frame(spark, texts), "").collect()):
        check_packing(rows)
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want


def check_packing(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    rows = queries.op9_packing(spark, D).collect()
    used = check_packing(rows)
    total = sum(r["length"] for r in rows)
    assert used <= -(-total // 1024) + 3
    own = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(got) == len(rows)
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall():
        ids = [*own.ids(text), 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, s in enumerate(starts):
            part = ids[s : first if k == 0 else s + 1024]
            r = got[(i, k)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))


def test_packing_edges(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = packing.pack_documents(frame(spark, ODD + ODD[:3]).withColumn("length", F.lit(1)), path).collect()
    check_packing(rows)
    assert {r["doc_id"] for r in rows} == set(range(len(ODD) + 3))
    twice = frame(spark, ["same"]).union(frame(spark, ["same"]))
    many = packing.pack(packing.materialize(packing.token_pieces(spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("the same row " * 9).alias("text")), path)), shard_pieces=500).collect()
    per_shard = {}
    for r in many:
        per_shard[r["sequence_id"] >> 32] = per_shard.get(r["sequence_id"] >> 32, 0) + 1
    assert check_packing(many) and len(many) == 3000 and len(per_shard) == 6 and max(per_shard.values()) < 700
    assert len(packing.pack_documents(twice, path).collect()) == 2
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 20, 300))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 20)
    gaps, fill = {}, {}
    for size, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        assert fill.get(b, 0) == o
        counts = {}
        for k in gaps.values():
            counts[k] = counts.get(k, 0) + 1
        cost = {}
        for g in [g for g in counts if g >= size]:
            after = dict(counts)
            after[g] -= 1
            if g > size:
                after[g - size] = after.get(g - size, 0) + 1
            cost[g] = sum(v * v for v in after.values())
        if cost:
            assert b in gaps and cost[gaps[b]] == min(cost.values())
        else:
            assert b not in fill
        fill[b] = o + size
        gaps[b] = 20 - fill[b]
        if not gaps[b]:
            del gaps[b]
    assert max(fill.values()) <= 20


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


SECRET_TEXTS = [
    None, "", "é🙂 token = 'abcdef1' x", "Password:short", "PASSWD == abcdefgh", 'api_key": "AKIA' + "Q7" * 9 + '"', "AKIAAKIA" + "Z" * 20, "AKIA" + "Z" * 10, "0" * 23, "0" * 24, "deadbeef" * 5 + "g" + "deadbeef" * 3,
    "secret=" + "aB3+" * 20, "token token=xyz123456 apikey=1234567", "word " * 2000, "key Zq8vT3xW1nL5pR7yB2mK9cH4dF6gJ0s2 end", "internationalization2 usr/local/lib64/python3",
]


def corpus_away(texts):
    counts = np.zeros(256)
    for t in texts:
        for c in t or "":
            if ord(c) < 128:
                counts[ord(c)] += 1
    return secrets.noncentralities(counts)


def test_secrets(spark):
    found, _ = secrets.scan_texts(SECRET_TEXTS, corpus_away(SECRET_TEXTS))
    for text, spans in zip(SECRET_TEXTS, found, strict=True):
        assert ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, p in spans if p is None) == brute_base(text or "")
    rows = secrets.find_secrets(frame(spark, SECRET_TEXTS)).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(SECRET_TEXTS)))
    kinds = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in rows}
    assert "random" in kinds[14] and not kinds[15] and not kinds[0]
    assert secrets.find_secrets(frame(spark, [])).count() == 0
    odd = frame(spark, SECRET_TEXTS).withColumns({"scanned": F.lit("mine"), "found": F.lit(1), "tested": F.lit(2)})
    redacted = secrets.redact(odd)
    clean = {r["doc_id"]: r for r in redacted.collect()}
    assert redacted.columns == odd.columns and clean[2]["scanned"] == "mine"
    assert clean[0]["text"] is None and clean[2]["text"] == "é🙂 [secret]' x" and clean[14]["text"] == "key [secret] end" and clean[2]["part"] == "copy"
    assert secrets.redact(odd.limit(0)).count() == 0
    twice = frame(spark, SECRET_TEXTS[14:15]).union(frame(spark, SECRET_TEXTS[14:15]))
    assert len({str(r["spans"]) for r in secrets.find_secrets(twice).collect()}) == 1


KEY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain_runs(text):
    """Maximal runs of key characters, one character at a time."""
    out, begin = [], None
    for i, c in enumerate(text + " "):
        if c in KEY + "-_":
            begin = i if begin is None else begin
        elif begin is not None:
            out.append((begin, i))
            begin = None
    return out


def test_secrets_score_every_run():
    """All runs in one go, whatever their length, against one run at a time; long texts are cut between runs."""
    rng = random.Random(7)
    texts = ["", "é" * 30, " ".join("".join(rng.choice(KEY[: rng.choice([26, 36, 64])] + "-_") for _ in range(rng.choice([1, 3, 8, 20, 40, 90, 200]))) for _ in range(400))]
    texts.append("🙂 " + texts[2].replace(" ", " ü "))
    away, size = corpus_away(["the quick brown fox jumps over 13 lazy dogs and the Old Man"]), secrets.PIECE
    want = []
    for t in texts:
        scored = [(s, 3, e, *secrets.battery(t[s:e], away)) for s, e in plain_runs(t)]
        want.append([(s, k, e, p) for s, k, e, random_p, p in scored if p <= 0.01 and random_p >= secrets.RANDOM_AT])
    assert 50 < len(want[2]) < 300
    for piece in (size, 100):
        secrets.PIECE = piece
        try:
            got, tested = secrets.random_runs(texts, away, 0.01)
        finally:
            secrets.PIECE = size
        assert [[x[:3] for x in g] for g in got] == [[x[:3] for x in w] for w in want]
        assert all(a[3] == pytest.approx(b[3], rel=1e-6) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))
        for t, counts in zip(texts, tested, strict=True):
            lengths = [e - s for s, e in plain_runs(t)]
            assert counts.tolist() == [sum(2**j <= n < 2 ** (j + 1) for n in lengths) for j in range(secrets.STRATA)]


def test_secrets_cuts_equal_plain_benjamini_hochberg():
    rng = random.Random(3)
    for _ in range(50):
        tests, ps = rng.randrange(20, 400), [10 ** -rng.uniform(0, rng.choice([2, 4, 9])) for _ in range(rng.randrange(1, 20))]
        width = secrets.BINS_PER_DECADE
        edges = [10 ** (-int(np.floor(-np.log10(p) * width)) / width) for p in ps]  # a p counts as the upper edge of its bin
        ranked = sorted(edges)
        kept = [k for k, p in enumerate(ranked, 1) if p * tests <= 0.05 * sum(x <= p for x in ranked)]
        want = ranked[kept[-1] - 1] if kept else 0.0
        bins = {}
        for p in ps:
            b = int(np.floor(-np.log10(p) * width))
            bins[b] = bins.get(b, 0) + 1
        assert secrets.cuts_of({4: tests}, {4: bins}, 0.05)[4] == pytest.approx(want)


def test_secrets_find_planted_keys(spark):
    """Random keys of five encodings in clean documents: recall by length, and no false span beside them."""
    rng = random.Random(11)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{D}/documents.parquet' ORDER BY doc_id").fetchall() if not brute_base(t) and len(t) > 200]
    alphabets = {"hex": "0123456789abcdef", "base64": KEY, "base32": KEY[:26] + "234567", "letters": KEY[26:52], "base36": KEY[26:62]}
    planted, rows = [], []
    for i, t in enumerate(texts):
        name, n = list(alphabets)[i % 5], (12, 32, 40, 64)[i // 5 % 4]
        key, at = "".join(rng.choice(alphabets[name]) for _ in range(n)), t.index(" ", 100) + 1
        rows.append(t[:at] + key + " " + t[at:])
        planted.append((n, i, at, at + n))
    found = {(r["doc_id"], s["start"], s["end"]) for r in secrets.find_secrets(frame(spark, rows)).collect() for s in r["spans"] if s["kind"] == "random"}
    keys = [x for x in planted if x[0] >= 32]
    assert len(keys) > 60 and sum(x[1:] in found for x in keys) >= 0.95 * len(keys)
    assert len(found - {x[1:] for x in planted}) <= 0.05 * len(found)


def test_secrets_long_text_in_linear_time():
    text = "token = abcdef123456 Zq8vT3xW1nL5pR7yB2mK9cH4dF6gJ0s2\n" * 20_000
    began = time.perf_counter()
    spans, _ = secrets.scan_texts([text], corpus_away([text[:1000]]))
    assert len(spans[0]) >= 20_000 and time.perf_counter() - began < 20


def test_secrets_query(spark):
    rows = {r["doc_id"]: r for r in queries.op4_secrets(spark, D).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall():
        want = brute_base(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(rows[i]["spans"].split(","))
        assert (rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"]) == tuple(want.count(k) for k in ("assign", "access", "hex"))


def test_randomness_has_power_and_level():
    rng = random.Random(4)
    away = corpus_away([t for (t,) in duckdb.sql(f"SELECT text FROM '{D}/documents.parquet'").fetchall()])
    keys = ["".join(rng.choice(KEY) for _ in range(40)) for _ in range(200)]
    assert sum(secrets.battery(k, away)[0] >= secrets.RANDOM_AT for k in keys) > 190
    assert sum(secrets.battery(k, away)[1] < 1e-4 for k in keys) > 180
    words = ["".join(rng.choice(["tion", "ment", "er", "an", "the", "ou"]) for _ in range(12)) + "1" for _ in range(200)]
    assert sum(secrets.battery(w, away)[0] >= secrets.RANDOM_AT and secrets.battery(w, away)[1] < 1e-4 for w in words) == 0
    assert secrets.battery(KEY, away)[0] < secrets.RANDOM_AT and secrets.battery("ab" * 40, away)[0] < secrets.RANDOM_AT


def plain_signatures(text):
    """Spots written out word by word; hashes as 8 hex digits."""
    words = re.findall(r"\w+", text.lower())
    common = lambda w: w in spotsigs.ANCHORS
    out = set()
    for i, w in enumerate(words):
        if not common(w):
            continue
        chain = [x for x in words[i + 1 :] if not common(x)][:2]
        if len(chain) == 2:
            out.add(f"{w}:{chain[0]}:{chain[1]}")
    if not out and len(words) >= 2:
        out = {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}
    elif not out:
        out = set(words) or ({text} if text else set())
    return {f"{xxhash.xxh32(x.encode()).intdigest():08x}" for x in out}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_classes(sets, threshold=0.8):
    """Components and link counts by comparing all pairs."""
    low, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    near = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] if not (sets[i] and sets[j]) else len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9)]
    for i, j in near:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return {i: (low[i], links[i]) for i in sets}


def test_spotsigs(spark):
    rows = {r["doc_id"]: r for r in queries.op5_spotsigs(spark, D).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        new = text[: len(text) - cut] + following[:cut]
        a, b, c = (plain_signatures(x) for x in (text, new, following))
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(a, b)) and r["near_next"] == pytest.approx(jaccard(a, c))
        assert r["fingerprint"] == "".join(sorted(a)) and r["edited_fingerprint"] == "".join(sorted(b))
    assert {i: (r["near_class"], r["n_near"]) for i, r in rows.items()} == plain_classes({i: plain_signatures(t) for i, t in docs})


def test_spotsigs_near_classes_equal_all_pairs(spark):
    """Edited copies around the threshold, copies, texts without words, very short sets, repeated and null ids."""
    rng = random.Random(21)
    content = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [(rng.choice(["the", "a", "of", "der"]), rng.choice(content), rng.choice(content)) for _ in range(rng.choice([1, 3, 5, 20, 60]))]
        for _ in range(4):
            texts.append(" ".join(" ".join(x if rng.random() > 0.08 else ("the", rng.choice(content), rng.choice(content))) for x in base))
    texts += ["", "", "!!", "!!", "one", "two words"]
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = spotsigs.near_classes(spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string")).collect()
    want = plain_classes({(i, k): plain_signatures(t) for k, (i, t) in enumerate(rows)})
    assert {r["doc_id"]: (r["near_class"], r["n_near"]) for r in got} == {i: (c[0], n) for (i, _), (c, n) in want.items()}


def test_spotsigs_partitions_lose_nothing():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        both = rng.choice(4000, n, replace=False)
        t = float(rng.choice([0.5, 0.8, 0.9]))
        a = np.concatenate([both, 5000 + rng.choice(500, int(rng.integers(0, 8)), replace=False)])
        b = np.concatenate([both, 6000 + rng.choice(500, int(rng.integers(0, 8)), replace=False)])
        if n >= t * (len(a) + len(b) - n) - 1e-9:
            assert set(spotsigs.partitions_of(len(a), t)) & set(spotsigs.partitions_of(len(b), t))


def test_spotsigs_prefixes_lose_nothing():
    """Sets at the threshold share a key whatever the counts, and what is left behind the first one allows for all that they share."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        t, shared = float(rng.choice([0.5, 0.8, 0.9])), rng.integers(0, 1 << 32, int(rng.integers(1, 50)))
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 32, int(rng.integers(0, 8)))])) for _ in range(2))
        common = len(np.intersect1d(a, b))
        if common < t * (len(a) + len(b) - common) - 1e-9:
            continue
        ranks = rng.integers(0, 4, spotsigs.BUCKETS)
        x, y = (spotsigs.prefix_keys(s, ranks, t) for s in (a, b))
        first = min(set(x.tolist()) & set(y.tolist()))
        assert common <= min(len(a) - x.tolist().index(first), len(b) - y.tolist().index(first))


def test_spotsigs_order_counts_all_documents(spark):
    signs = [spotsigs.signatures("the abc def in ghi jkl"), spotsigs.signatures("the abc def")]
    ranks = spotsigs.signature_order(spark.createDataFrame([(spotsigs._binary(s),) for s in signs], "payload binary").repartition(2))
    want = np.zeros(spotsigs.BUCKETS, np.int64)
    for s in signs:
        for x in s:
            want[x % spotsigs.BUCKETS] += 1
    assert sorted(set(want.tolist())) == [0, 1, 2] and [sorted(set(ranks[want == n].tolist())) for n in (0, 1, 2)] == [[0], [65536], [103872]]


def test_spotsigs_edges(spark):
    d = spark.createDataFrame([(5, "the abc def", 1), (5, "the abc def", 1), (None, None, 1), (3, "!!", 1), (9, "", 1), (8, "word " * 40000, 1)], "doc_id long, text string, k int")
    rows = spotsigs.fingerprint_chain(d).collect()
    assert len(rows) == 6 and len({r["fingerprint"] for r in rows if r["doc_id"] == 5}) == 1
    assert spotsigs.fingerprint_chain(d.limit(0)).count() == 0
    assert spotsigs.fingerprint_chain(d.where("doc_id = 3")).first()["near_next"] == 1.0
    a, b = frozenset(range(100)), frozenset(range(10, 90))
    assert spotsigs.likeness(a, b) == pytest.approx(0.8)
    for n in range(1, 200):
        for m in range(n, int(n / 0.8) + 1):
            assert abs(spotsigs.length_partition(n, 0.8) - spotsigs.length_partition(m, 0.8)) <= 1


def test_chat_examples(spark):
    t = spark.createDataFrame(
        [(1, 0, "system", "s<", 0), (1, 1, "user", "u\\l", 0), (1, 2, "assistant", "a</turn>\n\\b", 0), (1, 3, "assistant", "", 0), (1, 4, "user", "\n</turn>\n", 0), (2, 0, "assistant", "x", 0), (3, 0, None, None, 0), (None, 0, "user\n>", "n", 0), (2, 0, "assistant", "x", 0)],
        "conv_id long, turn int, role string, text string, full int",
    )
    rows = chat.format_chats(t)
    got = rows.withColumn("turns", chat.turns_of(F.col("text"))).withColumn("loss", chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length"))).orderBy("conv_id", "example").collect()
    one = [r for r in got if r["conv_id"] == 1]
    assert [(r["example"], r["last"], r["loss"]) for r in one] == [(2, False, "a</turn>\n\\b"), (3, False, ""), (4, True, "")]
    assert [tuple(x) for x in one[-1]["turns"]] == [("system", "s<"), ("user", "u\\l"), ("assistant", "a</turn>\n\\b"), ("assistant", ""), ("user", "\n</turn>\n")]
    assert one[2]["text"].startswith(one[1]["text"]) and one[1]["text"].startswith(one[0]["text"])
    assert [r["loss"] for r in got if r["conv_id"] == 2] == ["x", "x"]
    assert [tuple(x) for r in got if r["conv_id"] is None for x in r["turns"]] == [("user\n>", "n")]
    assert chat.format_chats(t.limit(0)).count() == 0


def test_chat_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{D}/conversations.parquet'")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(tuple(r[k] for k in columns) for r in c.sql(queries.ORACLE_SQL["op6_chat"]).df().to_dict("records"))
    assert sorted(tuple(r[k] for k in columns) for r in queries.op6_chat(spark, D).collect()) == want


def test_langid_held_out_accuracy(spark):
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = [r for r in queries.op7_langid(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert len(held) > 200 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_langid_vectors_and_edges(spark):
    d = spark.createDataFrame([(1, "the cat sat", "en", 1), (2, "der hund und die katze", "de", 1), (3, None, "en", 1), (4, "12 !!", "de", 1), (5, "", None, 1), (6, "the dog", None, 1), (7, "der", "de", 1)], "doc_id long, text string, lang string, l int")
    langs, prototypes = langid.learn(d)
    assert langs == ["de", "en"]
    got = {r[0]: r[1] for r in d.select("doc_id", langid.predict(F.col("text"), langs, prototypes)).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[6]["lang_pred"] == "en"
    none = langid.learn(d.limit(0))
    assert none[0] == [] and langid.predict_text("abc", *none) == ("und", 0.0)
    text = "Abc, abd é"
    codes = [32, *map(ord, "abc"), 32, *map(ord, "abd"), 32, ord("é"), 32]
    want = sum(np.asarray(langid.ngram_vector(tuple(codes[i : i + 3])), float) for i in range(len(codes) - 2))
    assert np.array_equal(langid.document_vector(text), want)


def test_langid_query_equals_plain_profiles(spark):
    """The whole query against vectors bound and bundled one n-gram at a time."""

    def letters_only(text):
        out = " "
        for c in text:
            c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
            out += "" if c == " " and out[-1] == " " else c
        return out if out[-1] == " " else out + " "

    made = {}

    def gram(three):
        if three not in made:
            a, b, c = (langid.letter_vector(ord(x)).astype(int) for x in three)
            made[three] = np.roll(a, 2) * np.roll(b, 1) * c
        return made[three]

    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{D}/documents.parquet'").fetchall()
    vectors, sums = {}, {}
    for i, text, lang in docs:
        letters = letters_only(text or "")
        if len(letters) >= 3:
            v = vectors[i] = sum(gram(letters[k : k + 3]) for k in range(len(letters) - 2)).astype(float)
            if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
                sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    langs = sorted(sums)
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    rows = {r["doc_id"]: r for r in queries.op7_langid(spark, D).collect()}
    assert len(rows) == len(docs)
    for i, _, _ in docs:
        if i not in vectors:
            assert rows[i]["lang_pred"] == "und"
            continue
        cosines = unit @ (vectors[i] / np.linalg.norm(vectors[i]))
        assert rows[i]["score"] == pytest.approx(max(cosines.max(), 0), abs=1e-4)
        assert cosines[langs.index(rows[i]["lang_pred"])] == pytest.approx(cosines.max(), abs=1e-4)


def test_langid_keeps_rare_languages(spark):
    rows = [(i, "the common words of this line", "en") for i in range(3000)] + [(5000 + i, "qvz xkj wqy zzv", "rare") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prototypes = langid.learn(df, max_training=100)
    assert langs == ["en", "rare"]
    _, whole = langid.learn(df.where("lang = 'rare'"))
    assert np.array_equal(prototypes[1], whole[0])


def test_flac_round_trip_and_checks():
    rng = random.Random(2)
    for _ in range(25):
        pcm = bytes(rng.choice([rng.randrange(256), 97, 98]) for _ in range(rng.choice([64, 128, 4096, 8192, 8960])))
        for order in (0, 3, 8):
            stream = flac.encode(pcm, order)
            (back, blocks, ok), at, parts = flac.decode_streams([stream])[0], flac.parse_stream(stream)["begin"], []
            assert back == pcm and ok and [b[0] for b in blocks] == list(range(0, len(pcm), flac.BLOCK))
            while at < len(stream):  # the plain reader agrees
                x, at = flac.decode_frame(stream, at)
                parts.append(x)
            assert (np.concatenate(parts) + 128).astype(np.uint8).tobytes() == pcm
            assert flac.read_samples(stream, 50, 5000) == pcm[50:5050]
    whole = flac.encode(flac.payload("word " * 900 + "other text " * 90))
    bad = bytearray(whole)
    bad[-9] ^= 1
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(bad)])
    for cut in (0, 3, 20, 45, 70, 300, len(whole) - 3):  # a stream that ends early raises and never hangs
        with pytest.raises((ValueError, IndexError)):
            flac.decode_streams([whole[:cut]])
    start = flac.parse_stream(whole)["begin"]
    with pytest.raises((ValueError, IndexError)):
        flac.decode_frame(whole[: start + 200], start)
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8
    long = bytes(range(256)) * 40
    assert flac.crc16(long) == flac.crc16(long[:0] + long)


def test_flac_columns(spark):
    d = frame(spark, ODD).withColumn("media", flac.flac_of_text(F.col("text"))).withColumn("d", flac.decoded(F.col("media")))
    for r in d.collect():
        assert bytes(r["d"]["pcm"]) == flac.payload(r["text"]) and r["d"]["md5_ok"]
    blocks = flac.pcm_blocks(d.select("doc_id", "media"), "media").orderBy("doc_id", "sample_offset").collect()
    joined = {}
    for b in blocks:
        assert b["sample_offset"] == len(joined.get(b["doc_id"], b"")) and b["samples"] == len(b["pcm"])
        joined[b["doc_id"]] = joined.get(b["doc_id"], b"") + bytes(b["pcm"])
    assert joined == {i: flac.payload(t) for i, t in enumerate(ODD)}
    assert frame(spark, []).select(flac.decoded(flac.flac_of_text(F.col("text")))).count() == 0


def test_flac_linear_predictor_is_used_and_mixed():
    """Sums of two tones favour the linear predictor; lanes of several orders and sizes are decoded together."""
    wave = lambda n, f: (128 + 60 * np.sin(np.arange(n) * f) + 55 * np.sin(np.arange(n) * f * 2.7)).astype(np.uint8).tobytes()
    pcms = [wave(n, f) for n, f in ((64, 0.9), (5000, 0.8), (9000, 1.1))] + [flac.payload("plain words " * 700)]
    streams = [flac.encode(p, o) for p in pcms for o in (0, 2, 4)]
    kinds = {s[flac.frame_header(s, flac.parse_stream(s)["begin"])[1]] >> 1 for s in streams}
    assert any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)
    assert len(flac.encode(pcms[2], 4)) < len(flac.encode(pcms[2], 0))
    assert [x[0] for x in flac.decode_streams(streams)] == [p for p in pcms for _ in range(3)]


def test_flac_corrupt_streams_are_reported(spark):
    good = flac.encode(flac.payload("some words " * 1000))
    bad = bytearray(good)
    bad[-20] ^= 4
    other = bytearray(good)
    other[30] ^= 1  # within the MD5
    rows = [(0, good), (1, bytes(bad)), (2, good[:200]), (3, b""), (4, None), (5, b"fLaC"), (6, bytes(other))]
    got = {r["id"]: r["d"] for r in spark.createDataFrame(rows, "id long, s binary").select("id", flac.decoded(F.col("s")).alias("d")).collect()}
    assert bytes(got[0]["pcm"]) == flac.payload("some words " * 1000) and got[0]["error"] is None and got[0]["md5_ok"]
    assert all(got[i]["pcm"] is None and got[i]["error"] for i in (1, 2, 3, 5)) and got[4] is None
    assert got[6]["error"] is None and not got[6]["md5_ok"]


def test_flac_query(spark):
    rows = {r["doc_id"]: r for r in queries.op8_flac(spark, D).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall():
        p = flac.payload(text)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_sha256"] == hashlib.sha256(flac.encode(p)).hexdigest() and r["feature"] == flac.feature_of(p)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = queries.op10_quality(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_quality_edges(spark):
    d = frame(spark, ODD)
    labels = spark.createDataFrame([(0, 1), (1, None), (4, 0), (4, 1), (99, 0), (None, 1)], "doc_id long, quality int")
    model = quality.learn(d, labels)
    assert model == {}  # one kind of label only
    assert {r[0] for r in d.select(quality.score(F.col("text"), model)).collect()} == {0.5}
    model = quality.learn(d, spark.createDataFrame([(6, 1), (11, 0), (12, 0), (8, 1)], "doc_id long, quality int"))
    assert all(0 <= r[0] <= 1 for r in d.select(quality.score(F.col("text"), model)).collect())
    assert quality.learn(frame(spark, []), labels) == {}
    assert np.array_equal(quality.features(""), quality.features(None))
    again = d.unionByName(d).unionByName(d.where("doc_id = 6").withColumn("text", F.lit("zzz"))).withColumns({"label": F.lit(1), "labelled_id": F.lit(2), "labelled_text": F.lit("x")})
    repeated = quality.learn(again, spark.createDataFrame([(6, 1), (11, 0), (12, 0), (8, 1), (8, 1)], "doc_id long, quality int"))
    assert np.array_equal(repeated["w"], model["w"]) and repeated["at"] == model["at"]
    assert d.limit(0).select(quality.score(F.col("text"), model)).count() == 0


def test_quality_learns_what_counts_cannot_tell():
    """Texts of the same letters, lengths and punctuation, labelled by the words that they prefer."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    kinds = [[word() for _ in range(150)] for _ in range(2)]
    labels = np.arange(1500) % 2
    texts = [" ".join(rng.choice(kinds[y if rng.random() < 0.7 else 1 - y]) for _ in range(60)) + "." for y in labels]
    x = np.array([quality.features(t) for t in texts])
    counted = x.copy()
    counted[:, 16:] = 0
    right = {name: ((quality.apply(quality.fit(f[:1000], labels[:1000]), f[1000:]) >= quality.CUT) == labels[1000:]).mean() for name, f in (("all", x), ("counts", counted))}
    assert right["all"] > 0.95 and right["counts"] < 0.6


def test_quality_equals_plain_pairwise_loss():
    """The fit is the minimum of the pairwise logistic loss written out pair by pair."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 16)), rng.random((60, quality.WORD_BUCKETS + quality.GRAM_BUCKETS))], 1).astype(np.float32)
    y = (x[:, 0] + x[:, 20] + rng.normal(size=60) > 0.5).astype(int)
    model = quality.fit(x, y, pairs=400, ridge=1e-2, seed=3)
    pick = np.random.default_rng(3)
    better, worse = pick.choice(np.flatnonzero(y == 1), 400), pick.choice(np.flatnonzero(y == 0), 400)
    z = quality._spread(x, model).astype(float)
    loss = lambda w: np.log1p(np.exp(-(z[better] - z[worse]) @ w)).mean() + 0.5e-2 * w @ w
    least = loss(model["w"])
    for _ in range(200):
        assert loss(model["w"] + rng.normal(size=len(model["w"])) * 10 ** rng.uniform(-3, -1)) >= least - 1e-6


def test_quality_query_equals_plain_scores(spark):
    rows = {r["doc_id"]: r for r in queries.op10_quality(spark, D).collect()}
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall())
    labels = {i: q for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{D}/labels.parquet' ORDER BY doc_id").fetchall() if i in docs and q is not None and zlib.crc32(str(i).encode()) % 5}
    model = quality.fit(np.array([quality.features(docs[i]) for i in sorted(labels)]), np.array([labels[i] for i in sorted(labels)]))
    want = quality.apply(model, np.array([quality.features(t) for t in docs.values()]))
    assert len(rows) == len(docs)
    for i, w in zip(docs, want, strict=True):
        assert rows[i]["score"] == pytest.approx(w, abs=1e-6) and rows[i]["predicted"] == int(w >= 0.3)


def serial_crc(bits, width, poly):
    """CRC bit by bit, as polynomial division."""
    value, top = 0, 1 << (width - 1)
    for b in bits:
        value ^= int(b) * top
        value = ((value << 1) ^ (poly if value & top else 0)) & (2 * top - 1)
    return f"{value:0{width}b}"


def in_bits(n, width):
    return f"{n & (1 << width) - 1:0{width}b}"


def rice(values, k):
    """Zigzag, quotient in unary with a one behind, remainder in ``k`` bits."""
    out = ""
    for v in values:
        z = 2 * v if v >= 0 else -2 * v - 1
        out += "0" * (z >> k) + "1" + (in_bits(z, k) if k else "")
    return out


def test_flac_streams_of_another_encoder():
    """A stream put together bit by bit from the format's definition: no seek table, 64-sample frames, every kind of subframe."""
    rng, size = np.random.default_rng(4), 64
    constant = np.full(size, -7)
    verbatim = rng.integers(-128, 128, size)
    fixed = np.cumsum(np.cumsum(rng.integers(-1, 2, size))).clip(-128, 127)
    linear = [50]
    for e in rng.integers(-3, 4, size - 1):
        linear.append(int(np.clip((linear[-1] * 29 >> 5) + e, -128, 127)))
    linear, last = np.array(linear), rng.integers(-5, 6, 40)
    signed = lambda values: "".join(in_bits(int(v), 8) for v in values)
    second = [int(fixed[i] - 2 * fixed[i - 1] + fixed[i - 2]) for i in range(2, size)]
    first = [int(linear[i] - (linear[i - 1] * 29 >> 5)) for i in range(1, size)]
    ends = "".join(in_bits(int(v), 6) for v in last[20:])
    subframes = [
        "0" + in_bits(0, 6) + "0" + signed([-7]),
        "0" + in_bits(1, 6) + "0" + signed(verbatim),
        # fixed predictor of order 2, two Rice partitions with a parameter of their own
        "0" + in_bits(8 + 2, 6) + "0" + signed(fixed[:2]) + "00" + in_bits(1, 4) + in_bits(1, 4) + rice(second[:30], 1) + in_bits(3, 4) + rice(second[30:], 3),
        # linear predictor of order 1: 7-bit coefficients, shift 5; one partition with five-bit parameters
        "0" + in_bits(32, 6) + "0" + signed(linear[:1]) + in_bits(7 - 1, 4) + in_bits(5, 5) + in_bits(29, 7) + "01" + in_bits(0, 4) + in_bits(2, 5) + rice(first, 2),
        # fixed predictor of order 0, the second of two partitions escaped: raw values of six bits
        "0" + in_bits(8, 6) + "0" + "00" + in_bits(1, 4) + in_bits(0, 4) + rice([int(v) for v in last[:20]], 0) + in_bits(15, 4) + in_bits(6, 5) + ends,
    ]
    samples = [constant, verbatim, fixed, linear, last]
    frames = b""
    for number, (subframe, own) in enumerate(zip(subframes, samples, strict=True)):
        header = "11111111111110" + "00" + "0110" + "0000" + "0000" + "001" + "0" + in_bits(number, 8) + in_bits(len(own) - 1, 8)
        bits = header + serial_crc(header, 8, 0x07) + subframe
        bits += "0" * (-len(bits) % 8)
        bits += serial_crc(bits, 16, 0x8005)
        frames += int(bits, 2).to_bytes(len(bits) // 8, "big")
    whole = np.concatenate(samples)
    info = in_bits(size, 16) * 2 + in_bits(0, 24) * 2 + in_bits(8000, 20) + in_bits(0, 3) + in_bits(7, 5) + in_bits(len(whole), 36)
    info = int(info, 2).to_bytes(18, "big") + hashlib.md5(whole.astype(np.int8).tobytes()).digest()
    comment = b"\x04\x00\x00\x00" + b"test" + b"\x00" * 4
    stream = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x84" + len(comment).to_bytes(3, "big") + comment + frames
    pcm, blocks, md5_ok = flac.decode_streams([stream])[0]
    assert pcm == (whole + 128).astype(np.uint8).tobytes() and md5_ok
    assert [(b[0], b[2]) for b in blocks] == [(0, 64), (64, 64), (128, 64), (192, 64), (256, 40)]
    assert flac.read_samples(stream, 100, 150) == pcm[100:250]


def plain_packing(lengths, capacity):
    """Each piece where the squared counts of open sequences by gap become smallest, by adding them up for every choice."""
    gaps, counts, filled, out = [], {}, [], []  # open sequences in the order in which they got their present gap
    for size in lengths:
        choices = []
        for gap in sorted({g for _, g in gaps if g >= size}):
            after = dict(counts)
            after[gap] -= 1
            if gap > size:
                after[gap - size] = after.get(gap - size, 0) + 1
            choices.append((sum(n * n for n in after.values()), gap, after))
        if choices:
            _, gap, counts = min(choices, key=lambda c: c[:2])
            at = max(i for i, (_, g) in enumerate(gaps) if g == gap)
            number = gaps.pop(at)[0]
        else:
            number, gap = len(filled), capacity
            filled.append(number)
            if gap > size:
                counts[gap - size] = counts.get(gap - size, 0) + 1
        out.append((number, capacity - gap))
        if gap > size:
            gaps.append((number, gap - size))
    return out


def test_packing_equals_the_plain_rule():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([5, 16, 40])
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(60))), reverse=rng.random() < 0.7)
        bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), capacity)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == plain_packing(lengths, capacity)
