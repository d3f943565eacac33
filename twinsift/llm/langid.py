"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An
n-gram vector binds (multiplies) the letters' vectors, each rotated by its
distance from the n-gram's end. A document vector bundles (adds) the vectors of
all its n-grams; a language prototype bundles the unit document vectors of the
language. A document gets the language of the prototype with the largest cosine.

Letters are lower-cased; every run of other characters is one space. Prototypes
come from at most ``MAX_TRAINING`` documents (chosen by a hash of the id), as sums
of integers, so they don't depend on the order of rows. Prediction reads every
whole text and nothing else.

Null text, and text without a letter, is ``und`` with score 0; so is every text if
nothing was learned. Ties go to the first language in alphabetical order. Repeated
rows teach as often as they occur, and each gets the prediction of its text; an
empty table gives no rows. Only the named columns are used, so other columns may
have any name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from twinsift.plans.storage import arrow_rows

DIMENSIONS = 1024
NGRAM = 3
MAX_TRAINING = 20_000
SEED = 20_011
#: N-gram vectors that a worker keeps; beyond, it starts anew.
TABLE_ROWS = 24_576
#: Unit vectors are added up as integers of this scale.
_SCALE = 1 << 20
_SPACE = 32
PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@lru_cache(maxsize=8192)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def ngram_vector(codes: tuple[int, ...]) -> np.ndarray:
    out = np.ones(DIMENSIONS, np.int8)
    for distance, code in enumerate(reversed(codes)):
        out *= np.roll(letter_vector(code), distance)
    return out


class Table(dict):
    """N-gram key to row of a growing matrix of n-gram vectors."""

    def __init__(self):
        self.rows = np.empty((TABLE_ROWS, DIMENSIONS), np.int8)

    def __missing__(self, key: int) -> int:
        row = len(self)
        self.rows[row] = ngram_vector((key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF))
        self[key] = row
        return row


@lru_cache(maxsize=1)
def _table() -> Table:
    return Table()


def document_vector(text: str | None) -> np.ndarray | None:
    """Bundle of the text's n-grams, or None for text without a letter."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = codes[(codes != _SPACE) | np.r_[True, codes[:-1] != _SPACE]].astype(np.int64)
    if len(codes) < NGRAM:
        return None
    keys, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
    table, out = _table(), np.zeros(DIMENSIONS, np.float32)
    step = TABLE_ROWS // 2
    for at in range(0, len(keys), step):
        part = keys[at : at + step].tolist()
        if len(table) + len(part) > TABLE_ROWS:
            table.clear()
        rows = [table[k] for k in part]
        out += counts[at : at + step].astype(np.float32) @ table.rows[rows].astype(np.float32)
    return out


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_training: int = MAX_TRAINING) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from the rows whose text and language are not null."""
    arrow_rows(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    there = {r["l"]: r["count"] for r in rows.where("l IS NOT NULL AND t IS NOT NULL").groupBy("l").count().collect()}
    if sum(there.values()) > max_training:
        quota = max_training / len(there)  # a language below its quota keeps all its rows
        parts = [(lang, 1_000_000 if n <= quota else max(1, int(1_000_000 * 0.95 * quota / n))) for lang, n in there.items()]
        kept = F.broadcast(df.sparkSession.createDataFrame(parts, "l string, part long"))
        rows = rows.join(kept, "l").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("part")).select("id", "t", "l")

    def bundle(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vector = document_vector(text)
                if vector is not None:
                    unit = np.rint(vector * (_SCALE / max(np.linalg.norm(vector), 1e-9))).astype(np.int64)
                    sums[lang] = sums.get(lang, 0) + unit
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["l", "v"])

    parts = rows.where("l IS NOT NULL AND t IS NOT NULL").select("t", "l").mapInArrow(bundle, "l string, v array<long>")
    added = parts.select("l", F.posexplode("v").alias("d", "x")).groupBy("l", "d").agg(F.sum("x").alias("x")).toArrow()
    langs = sorted(set(added.column("l").to_pylist()))
    out = np.zeros((len(langs), DIMENSIONS))
    place = {lang: k for k, lang in enumerate(langs)}
    out[[place[x] for x in added.column("l").to_pylist()], added.column("d").to_numpy()] = added.column("x").to_numpy()
    return langs, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict_text(text: str | None, langs: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    vector = document_vector(text) if langs else None
    if vector is None:
        return "und", 0.0
    cosines = prototypes @ (vector / max(np.linalg.norm(vector), 1e-9))
    best = int(cosines.argmax())
    return langs[best], float(np.clip(cosines[best], 0, 1))


def predict(text: Column, langs: list[str], prototypes: np.ndarray) -> Column:
    """Struct column ``(lang_pred, score)`` of each whole text."""

    @F.arrow_udf(PREDICTION)
    def language(texts):
        import pyarrow as pa

        found = [predict_text(t, langs, prototypes) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return language(text)
