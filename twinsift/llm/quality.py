"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled 1 over one labelled 0) teach a linear
document score by logistic loss on the difference of the two feature vectors.
The score that cuts off the training sample's share of label 0 (a score
quantile) is the threshold; a logistic map sends it to ``CUT`` so that
``score >= CUT`` is the decision. Features come from the text alone: counts of how
it is written, the shares of its distinct words in ``WORD_BUCKETS`` hash buckets,
and those of its runs of three bytes in ``GRAM_BUCKETS``. All are standardised, and the
ridge alone holds weights back: where counts separate the labels they decide, and
words do where counts cannot.

Learning takes a sample of at most ``MAX_LABELLED`` labelled documents, chosen by
a hash of the id, whose features go to the driver (``16 + WORD_BUCKETS +
GRAM_BUCKETS`` numbers a document). Scoring runs over every whole text.

Null text is the empty text and gets the score of empty text. Without labels of
both kinds every score is 0.5. Documents with several labels count once, with
label 1 if at least half of their labels are 1; null labels are skipped. Repeated
rows of a labelled id count once, with the least text; when scored, each row gets
the score of its own text. An empty table gives no rows. Working columns of
``learn`` come from the named columns alone, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from twinsift.plans.storage import arrow_rows

#: Upper bound of the labelled sample.
MAX_LABELLED = 20_000
#: Preference pairs drawn from the sample.
PAIRS = 60_000
CUT = 0.3
WORD_BUCKETS, GRAM_BUCKETS = 128, 128
#: The threshold lies midway between the score quantiles this far below and above the share of label 0.
MARGIN = 0.01
_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LOWER = (_ASCII >= 97) & (_ASCII <= 122)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SPACE = np.isin(_ASCII, [9, 10, 11, 12, 13, 32])
_PROSE = np.isin(_ASCII, [ord(c) for c in ".,;:'\"-?()"])
_SYMBOL = (_ASCII < 128) & ~(_UPPER | _LOWER | _DIGIT | _SPACE | _PROSE)


def hashed(data: np.ndarray, distinct: set[str]) -> np.ndarray:
    """Shares of distinct words, then of runs of three bytes, by hash bucket."""
    words = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in distinct] or [0], minlength=WORD_BUCKETS)
    x = data.astype(np.uint32)
    grams = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    return np.concatenate([words / max(len(distinct), 1), np.bincount(grams % GRAM_BUCKETS, minlength=GRAM_BUCKETS) / max(len(grams), 1)])


def features(text: str | None) -> np.ndarray:
    """Counts of how a text is written, and its hashed words and runs of three bytes."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    raw = np.bincount(data, minlength=256)
    size, words, lines = max(int(raw.sum()), 1), text.split(), text.split("\n")
    n = max(len(words), 1)
    distinct = set(words)
    kinds = len(distinct)
    again = sum(map(str.__eq__, words, words[1:]))
    letters = max(int(raw[_UPPER | _LOWER].sum() + raw[128:].sum()), 1)
    counted = [
        np.log1p(size),
        raw[_UPPER].sum() / letters,
        raw[_DIGIT].sum() / size,
        raw[_SYMBOL].sum() / n,
        raw[ord("|")] / n,
        raw[ord("!")] / n,
        raw[_PROSE].sum() / n,
        raw[ord(".")] / n,
        raw[_SPACE].sum() / size,
        kinds / n,
        np.log1p(kinds) / np.log1p(n),
        again / n,
        len(set(lines)) / len(lines),
        len(lines) / n,
        (size - raw[_SPACE].sum()) / n,
        sum(len(w) <= 3 for w in words) / n,
    ]
    return np.concatenate([counted, hashed(data, distinct)]).astype(np.float32)


def _spread(x: np.ndarray, model: dict) -> np.ndarray:
    """Standardised, clipped features, and the squares of those that are counts."""
    z = np.clip((x - model["mean"]) / model["scale"], -4, 4)
    counted = z[:, : x.shape[1] - WORD_BUCKETS - GRAM_BUCKETS]
    return np.concatenate([counted, counted * counted, z[:, counted.shape[1] :]], axis=1).astype(np.float32)


def _solve(product, right: np.ndarray, steps: int = 60) -> np.ndarray:
    """Conjugate gradients for a positive definite ``product``."""
    out, left = np.zeros_like(right), right.copy()
    way, size = left.copy(), float(left @ left)
    goal = 1e-8 * size
    for _ in range(steps):
        if size <= goal:
            break
        turned = product(way)
        step = size / float(way @ turned)
        out += step * way
        left -= step * turned
        size, last = float(left @ left), size
        way = left + size / last * way
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> dict:
    """Weights by Newton steps on the pairwise logistic loss, and the logistic map of scores.

    Differences of pairs are never stored: sums over pairs become sums over documents.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {}
    model = {"mean": x.mean(0, dtype=float), "scale": np.maximum(x.std(0, dtype=float), 1e-6)}
    z, pick = _spread(x, model), np.random.default_rng(seed)
    better, worse = pick.choice(good, pairs), pick.choice(bad, pairs)

    def summed(weight: np.ndarray) -> np.ndarray:
        """Sum over pairs of weight times the difference of features."""
        by_doc = np.bincount(better, weight, len(z)) - np.bincount(worse, weight, len(z))
        return (by_doc.astype(np.float32) @ z).astype(float)

    def differences(w: np.ndarray) -> np.ndarray:
        s = z @ w.astype(np.float32)
        return (s[better] - s[worse]).astype(float)

    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(differences(w), -30, 30)))
        curve = p * (1 - p) / pairs
        step = _solve(lambda v: summed(curve * differences(v)) + (ridge + 1e-6) * v, summed(p) / pairs - ridge * w)  # noqa: B023
        w += step
        if np.abs(step).max() < 1e-4:
            break
    s, share = z @ w, len(bad) / len(y)
    model |= {"w": w, "at": float(np.quantile(s, [max(share - MARGIN, 0), min(share + MARGIN, 1)]).mean()), "slope": 4 / max(float(np.median(s[good]) - np.median(s[bad])), 1e-6)}
    return model


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; the threshold of the model lies at ``CUT``."""
    if not model or not len(x):
        return np.full(len(x), 0.5)
    s = _spread(x, model) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (s - model["at"]) + np.log(CUT / (1 - CUT)), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """Model from at most ``max_labelled`` of the labelled documents.

    The sampled labels are bounded, so they are broadcast to the scan of the
    documents; only sampled texts are read into features.
    """
    arrow_rows(docs.sparkSession)
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).alias("labelled_text")).join(F.broadcast(chosen), "labelled_id")
    rows = texts.groupBy("labelled_id").agg(F.min("labelled_text").alias("labelled_text"), F.first("label").alias("label")).select("labelled_id", "labelled_text", "label")

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["id", "label", "x"])

    found = rows.mapInArrow(describe, "id long, label int, x binary").toArrow()
    if not found.num_rows:
        return {}
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(order), -1)[order]
    return fit(x, found.column("label").to_numpy()[order])


def score(text: Column, model: dict) -> Column:
    """Score of each whole text."""

    @F.arrow_udf(DoubleType())
    def quality_score(texts):
        import pyarrow as pa

        return pa.array(apply(model, np.array([features(t) for t in texts.to_pylist()], np.float32).reshape(len(texts), -1)), pa.float64())

    return quality_score(text)
