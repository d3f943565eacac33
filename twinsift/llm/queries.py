"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import align, bpe, chat, flac, langid, line_dedup, ngram_join, packing, pieces, quality, repair, secrets, spotsigs
from twinsift.plans.storage import arrow_rows


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.near_duplicate_classes(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line or are one word from it."""
    return line_dedup.drop_lines(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode the ids again."""
    arrow_rows(spark)
    both = bpe.encode_decode(_documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"))
    return both.select(
        "doc_id",
        (F.length("bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2("bpe_bytes", 256).alias("decoded_sha256"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find secrets in every whole text."""
    found = secrets.find_secrets(_documents(spark, sf_dir))
    base = F.filter("spans", lambda f: f["p"].isNull())
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every whole text and its edited form."""
    return spotsigs.fingerprint_chain(_documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that holds control strings, and read everything back from the examples."""
    said = "\\### Assistant: </turn> ok"
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    examples = chat.format_chats(turns.unionByName(odd))
    parsed = chat.turns_of(F.col("text"))
    lines = F.array_join(F.transform(parsed, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"),
        chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.when(F.col("last"), F.size(parsed).cast("long")).alias("n"), F.when(F.col("last"), F.sha2(lines, 256)).alias("sha"),
    )
    by_conv = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return by_conv.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every whole text as a FLAC stream and read it back."""
    arrow_rows(spark, 500)
    stored = _documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), flac.flac_of_text(F.col("text")).alias("media"))
    back = stored.withColumn("d", flac.decoded(F.col("media")))
    return back.select(
        "doc_id", "n_bytes",
        F.octet_length("d.pcm").cast("long").alias("payload_bytes"),
        F.sha2("d.pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(d.pcm, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("d.feature").alias("feature"),
        F.size("d.blocks").cast("long").alias("n_blocks"),
        F.col("d.md5_ok").alias("md5_ok"), F.col("d.error").alias("error"),
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text; a quarter of the documents is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    langs, prototypes = langid.learn(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), langid.predict(F.col("text"), langs, prototypes).alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text for quality; a fifth of the documents is held out of learning."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality.learn(docs, labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens.

    The rank file holds the same vocabulary and merge order as
    ``byte_bpe_50k.json``; with the added tokens of that file both libraries give
    the same ids (a test compares the two).
    """
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"), added=bpe.added_tokens(_tokenizer("byte_bpe_50k.json")))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of id and turn: dropped (``present`` is false), emptied, without ends of sentences, repeated, or said by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    found = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), kind.alias("kind"))
    return found.withColumn("again", F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int")))).drop("kind", "again")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations, count their faults and repair them by least edits."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, repaired = repair.repair(damaged(turns), present="present")
    digests = repair.digests(repaired).withColumnRenamed("conv_id", "conv")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text with an end id and decode the ids again."""
    arrow_rows(spark)
    both = pieces.encode_decode(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("piece_text", 256).alias("decoded_sha256"),
    )


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of two tokenizers in every whole text."""
    return align.align(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_spotsigs": op5_spotsigs,
    "op6_chat": op6_chat,
    "op7_langid": op7_langid,
    "op8_flac": op8_flac,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_pieces": op12_pieces,
    "op13_align": op13_align,
}

def _repair_sql() -> str:
    """Labels by state as text: nine digits of cost and the audit, so that the least text is the best label."""
    more = lambda s, cost, letter: f"lpad(CAST(CAST({s}[1:9] AS BIGINT) + ({cost}) AS VARCHAR), 9, '0') || {s}[10:] || '{letter}'"
    when = lambda test, label: f"CASE WHEN {test} THEN {label} END"
    extra = "CASE WHEN truncated THEN 5 ELSE 0 END"
    keep = lambda s, initial: when(f"NOT bad AND c = '{initial}'", more(s, extra, "K"))
    reroled = lambda s, initial: when(f"NOT bad AND c <> '{initial}'", more(s, f"1 + {extra}", "R"))
    dropped = lambda s: more(s, 2, "D")
    return rf"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ), keyed AS (
            SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations
        ), hashed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i:i]) AS BIGINT))),
                       lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind
            FROM keyed, crc
        ), rows AS (
            SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hashed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text) AS k, role[1:1] AS c,
                   NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM rows
        ), faults AS (
            SELECT *, NOT blank AND row_number() OVER (PARTITION BY id, role, text ORDER BY k) > 1 AS duplicate,
                   lag(c) OVER (PARTITION BY id ORDER BY k) || c NOT IN ('su', 'ua', 'au') AS illegal FROM placed
        ), faulty AS (
            SELECT *, blank OR duplicate AS bad, NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS truncated FROM faults
        ), labels AS (
            SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), '') AS id, CAST(0 AS BIGINT) AS k, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM conversations
            UNION ALL
            SELECT id, k, n0, n1, i2, least(n3, {more("i2", 5, "I")}) FROM (
                SELECT *, least(n2, {more("n0", 5, "I")}, {more("n1", 5, "I")}, {more("n3", 5, "I")}) AS i2 FROM (
                    SELECT l.id, f.k, {dropped("s0")} AS n0, least({dropped("s1")}, {keep("s0", "s")}) AS n1,
                           least({dropped("s2")}, {", ".join(f(s, "u") for s in ("s0", "s1", "s3") for f in (keep, reroled))}) AS n2,
                           least({dropped("s3")}, {keep("s2", "a")}, {reroled("s2", "a")}) AS n3
                    FROM labels l JOIN faulty f ON f.id = l.id AND f.k = l.k + 1))
        ), best AS (
            SELECT id, CAST(b[1:9] AS BIGINT) AS cost, b[10:] AS audit FROM (SELECT id, least(arg_max(s0, k), arg_max(s3, k)) AS b FROM labels GROUP BY id)
        ), replay AS (
            SELECT id, audit, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, 'e' AS state, '' AS said FROM best
            UNION ALL
            SELECT p.id, audit, i + 1, p.k + CASE WHEN audit[i:i] = 'I' THEN 0 ELSE 1 END,
                   CASE audit[i:i] WHEN 'D' THEN state WHEN 'K' THEN c WHEN 'R' THEN fit[1:1] ELSE fit[1:1] END,
                   said || CASE audit[i:i] WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || fit || ':' || text ELSE chr(10) || fit || ':' END
            FROM (SELECT *, CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END AS fit FROM replay WHERE i <= length(audit)) p
            LEFT JOIN faulty f ON f.id = p.id AND f.k = p.k + 1
        ), repaired AS (SELECT id, sha256(arg_max(said, i)[2:]) AS repaired_sha256 FROM replay GROUP BY id),
        counted AS (
            SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                   count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY id
        ), ids AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS id FROM conversations)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, cost, audit, repaired_sha256
        FROM ids JOIN best USING (id) JOIN repaired USING (id) LEFT JOIN counted USING (id)"""


ORACLE_SQL: dict[str, str] = {
    "op11_repair": _repair_sql(),
    # n_turns, digests and lengths follow from the turns themselves; formatted_chars from the template's lengths.
    "op6_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), p AS (
            SELECT *, 11 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\e')) + 2
                      + length(replace(replace(text, '\', '\b'), '<', '\l')) + 9 AS chars,
                   row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        ), q AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM p)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
               CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM q GROUP BY conv_id""",
}
