"""Conversation repair, SentencePiece pieces and tokenizer alignment against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from twinsift.llm import align, bpe, pieces, queries, repair

D = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "▁", "▁▁ x", "a", " a ", "x  y   ", "tab\tand\nline\r\n", "\x00", "<s>hi</s>", "<0x41>", "<|endoftext|>", "日本語 テスト", "🙂🙃 zwj‍", "é é", "ﬁ　x", "x" * 5000, "ab " * 40000, "1234 5678" * 50, "a" * 300 + " " * 300]


def frame(spark, texts):
    rows = [(i, t, "other", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a string, slice string")


def noise(rng, n):
    return "".join(rng.choice(["a", "b", " ", "  ", "▁", "\n", "é", "日", "🙂", "the", "<s>", "1", "the quick", "aaaaaaaaaaaaaaaaaaaaa", "\x00"]) for _ in range(n))


# --- pieces ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_pieces_equal_the_library(library, monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE_CHARS", size)
    monkeypatch.setattr(pieces, "TABLE_BYTES", 5000)
    own, rng = pieces.Pieces(B), random.Random(size)
    assert own.chunked
    for text in [x for x in ODD if x] + [noise(rng, rng.randrange(40)) for _ in range(1500)]:
        ids = library.encode(text)
        assert own.ids(text).tolist() == ids
        for tail in ([], [2]):
            assert own.decode(np.array(ids + tail, np.int32)) == library.decode(ids + tail)
    assert own.table.bytes < 1 << 20  # long chunks are not kept and the table starts anew


def test_distinct_chunks_are_segmented_once():
    own = pieces.Pieces(B)
    own.ids("to be or not to be " * 100)
    assert own.table.segmented == 5  # to, be, or, not and the lone marker at the end


def test_model_without_safe_chunks_encodes_whole_texts(library):
    own = pieces.Pieces(B)
    own.chunked = False
    assert all(own.ids(t).tolist() == library.encode(t) for t in ODD if t)


def test_pieces_query_and_odd_texts(spark, library):
    def want(text):
        ids = library.encode(text or "") + [library.eos_id()]
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_pieces(spark, D).collect()}
    assert got == {i: want(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall()}
    rows = pieces.encode_decode(frame(spark, ODD), B).collect()
    for r in rows:
        ids = library.encode(r["text"] or "") + [2]
        assert r["piece_ids"] == ids and r["piece_text"] == library.decode(ids) and r["n_a"] == "other"
    assert pieces.encode_decode(frame(spark, []), B).count() == 0


# --- alignment ------------------------------------------------------------------------------------------------------


def plain_alignment(texts, library):
    """The contract word by word, with the tokenizers library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    alphabet = bpe.byte_alphabet()
    docs, links, count = [], [], collections.Counter()
    for text in texts:
        data = f" {text or ''}".encode()
        a, b = (t.encode(f" {text}", add_special_tokens=False).ids, library.encode(text)) if text else ([], [])
        a_bytes = [bytes(alphabet[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = [list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(ids, e_, strict=True) if low < e <= cut] for ids, e_ in ((a, ends[0]), (b, ends[1]))])
            low = cut
        links.append([pair for g in groups for pair in itertools.product(*g)])
        count.update(set(links[-1]))
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        docs.append((len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    highest = collections.Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return [(*d[:4], sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own), d[4]) for d, own in zip(docs, links, strict=True)]


def rows_of(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize(("size", "large"), [(4 << 20, 256), (60, 0), (7, 2)])
def test_slices_and_large_groups_change_nothing(library, monkeypatch, size, large):
    monkeypatch.setattr(align, "SLICE_BYTES", size)
    monkeypatch.setattr(align, "LARGE_GROUP", large)
    own, rng = align.Aligner(A, B, P.PATTERN), random.Random(large)
    for _ in range(40):
        texts = [noise(rng, rng.randrange(30)) for _ in range(rng.randrange(6))] + [None, ""]
        docs, (a, b, slot, links) = align.align_slice(own, texts)
        want = plain_alignment(texts, library)
        assert [(*d[:4], d[4]) for d in docs] == [(*w[:4], w[6]) for w in want]
        assert np.bincount(slot, links, len(texts)).astype(int).tolist() == [w[3] for w in want]
        assert len(set(zip(a.tolist(), b.tolist(), slot.tolist(), strict=True))) == len(a)


def test_alignment_query(spark, library):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{D}/documents.parquet' ORDER BY doc_id").fetchall()]
    assert rows_of(queries.op13_align(spark, D)) == plain_alignment(texts, library)


def test_alignment_of_odd_texts_copies_and_hot_pairs(spark, library, monkeypatch):
    from twinsift.operators import joins

    monkeypatch.setattr(align, "SLICE_BYTES", 2000)
    # every pair that two slices hold is hot
    monkeypatch.setattr(align, "join_counted", lambda *a, **o: joins.join_counted(*a, hot_keys=1 << 30, hot_rows=2, **o))
    texts = [x for x in ODD if len(x or "") < 10_000] + ["the same text again"] * 40
    assert rows_of(align.align(frame(spark, texts).repartition(3), A, B)) == plain_alignment(texts, library)
    assert align.align(frame(spark, []), A, B).count() == 0


def test_json_ranks_are_the_rank_file():
    assert bpe.json_ranks(A) == bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    with pytest.raises(ValueError):
        bpe.json_ranks(P.path("word_bpe_49k.json"))


# --- conversation repair --------------------------------------------------------------------------------------------


def plain_repair(rows):
    """Summary, audit and repaired turns of ``(turn, role, text)`` in order, by Bellman-Ford on whole labels."""
    white, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        shown = text.strip(white)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    labels = {"": (0, "", ())}

    def offer(into, state, label):
        if state not in into or label < into[state]:
            into[state] = label

    for i in range(len(rows) + 1):
        for _ in range(3):
            for state, (cost, audit, out) in list(labels.items()):
                for role in ("user", "assistant"):
                    if (to := after.get((state, role[0]))) is not None:
                        offer(labels, to, (cost + 5, f"{audit}I", (*out, f"{role}:")))
        if i == len(rows):
            break
        behind, (_, role, text) = {}, rows[i]
        for state, (cost, audit, out) in labels.items():
            offer(behind, state, (cost + 2, f"{audit}D", out))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                if (to := after.get((state, role[:1]))) is not None:
                    offer(behind, to, (cost + more, f"{audit}K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (to := after.get((state, new[0]))) is not None:
                        offer(behind, to, (cost + 1 + more, f"{audit}R", (*out, f"{new}:{text}")))
        labels = behind
    cost, audit, out = min(labels[s] for s in ("", "a") if s in labels)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repaired(spark, rows, present=None):
    kinds = "conv_id long, turn long, role string, text string, audit string" + (", there boolean" if present else "")
    found, turns = repair.repair(spark.createDataFrame(rows, kinds), present=present)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(turns).collect()}
    return {r["conv_id"]: (*tuple(r)[1:], digests.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in found.collect()}


def plain_of(rows):
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: plain_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for c, r in by_conv.items()}


ROLES, SAID = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "cut", " \t", "", None, "é?", "a\n"]


@pytest.mark.parametrize("block", [1, 3, 128])
def test_search_in_blocks_equals_plain_labels(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        rows = [(i, rng.choice(ROLES[:5]), rng.choice(SAID[:5] + SAID[6:])) for i in range(rng.randrange(9))]
        (*summary, audit), turns = repair._finished([(*r, 1) for r in rows])
        text = "\n".join(f"{t[2]}:{t[3]}" for t in turns)
        assert (*summary, audit, hashlib.sha256(text.encode()).hexdigest()) == plain_repair(rows)


@pytest.mark.parametrize("block", [2, 128])
def test_pieces_give_the_edits_of_the_whole(monkeypatch, block):
    """Pieces searched by themselves, with costs from behind and states from the front, as one search does."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        codes = "".join(repair.code(rng.choice(ROLES[:5]), rng.randrange(3)) for _ in range(rng.randrange(1, 14)))
        cuts = sorted(rng.sample(range(1, len(codes)), rng.randrange(min(4, len(codes)))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        state, cost, audit = 0, 0, ""
        for part, beyond in zip(parts, repair.costs_beyond([repair.transfer(p) for p in parts]), strict=True):
            more, edits, state = repair.least_edits(part, state, beyond)
            cost, audit = cost + more, audit + edits
        assert (cost, audit, state) == repair.least_edits(codes)


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_repair_of_odd_conversations_and_a_hot_one(spark, monkeypatch, held):
    monkeypatch.setattr(repair, "HELD_BYTES", held)
    monkeypatch.setattr(repair, "BLOCK", 16)
    rng = random.Random(3)
    # one text for each turn and role: ties of different texts come in the order of a hash
    rows = [(c, t, role, None if t == 1 and c else f"{rng.choice(SAID)}{t % 3 or ''}", "own") for c in [*range(12), None] for t in rng.sample(range(9), 6) for role in [rng.choice(ROLES)]]
    rows += [(3, None, "user", "No turn.", "own"), (50, None, "user", "Alone", "own")]
    rows += [(99, t, ["user", "assistant", "tool"][t % 3 if t % 7 else 1], f"Said {t % 40}{'.' if t % 5 else ''}", "own") for t in range(700)]
    rows += [(99, 5, "user", "Copies.", "own")] * 60 + [(7, 2, "assistant", "Twice.", "own")] * 2
    rows = [r for r in rows if not (r[0] == 99 and r[1] == 5 and r[3] != "Copies.")]
    got = repaired(spark, rows)
    assert got == plain_of(rows)
    assert repaired(spark, []) == {}


def test_conversations_without_rows(spark):
    got = repaired(spark, [(1, 0, "user", "Gone.", "x", False), (2, 4, "user", "Here.", "x", True), (2, 5, "user", "Gone.", "x", None), (3, 1, "user", "Gone.", "x", False)], "there")
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {1: (0,) * 6 + ("", empty), 2: (0, 0, 0, 0, 0, 2, "D", empty), 3: (0,) * 6 + ("", empty)}


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(20) for t in range(6)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.Counter(tuple(r) for r in queries.damaged(df).collect())
    want = collections.Counter()
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "".join(c for c in text or " " if c not in ".!?")}.get(kind, " " if text is None else text)
        want[conv, turn, "user" if kind == 4 else role or " ", text, kind != 0] += 2 if kind == 3 else 1
    assert got == want


def test_repair_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{D}/conversations.parquet'")
    got = queries.op11_repair(spark, D).toPandas().sort_values("conv_id").reset_index(drop=True)
    want = con.sql(queries.ORACLE_SQL["op11_repair"]).df()[list(got.columns)].sort_values("conv_id").reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str)) and len(got)
