"""Secret scans: fixed patterns and a battery of randomness tests.

Patterns find assignments, access keys and long hex runs (``base`` spans). The
battery looks at every maximal run of key characters (letters, digits, ``+/_-``),
wherever it stands and whatever its length. For each it infers the narrowest
encoding whose alphabet holds the run and tests three things: chi-squared
uniformity over the alphabet, Wald-Wolfowitz runs about the alphabet's middle, and
lag-1 serial correlation. A run that fails any test (Bonferroni-adjusted) is not
random and so no key.

Uniformity counts every symbol of an alphabet of k if the run has at least ten
characters and n * n >= 10 k (Koehler and Larntz's rule for equal shares), with
k - 1 degrees of freedom; shorter runs are counted by the classes of
``_CLASSES``, with one degree less than classes.

Length-aware false-discovery control. Under text the chi-squared value of a run
follows a noncentral chi-squared law whose noncentrality is the run's length times
``sum((q - s)^2 / s)``, with s the uniform share of a symbol and q its share among
all key characters of the corpus (``symbol_counts``, over all texts). Its lower
tail is the run's p: a short run can never look convincing. Benjamini-Hochberg
runs by itself within every stratum of lengths (powers of two), so that the many
short words do not hide the few long runs. A run that fails the battery counts as
a test with p = 1. A run whose p is above the rate is only counted, as no cut of
Benjamini-Hochberg is above the rate: this loses nothing, and the other two tests
are made for the rest only.

The cuts come from counts of tests by stratum and a histogram of p-values, of
bounded size whatever the corpus. Positions are code points, ends exclusive. Spans
of the battery stand beside base spans and may overlap them. Null text is the
empty text and has no spans. Ties in position are ordered by kind as listed in
``KINDS``. Repeated rows are scanned, and counted, as often as they occur; an
empty table gives no rows. Other columns are left alone; ``redact`` keeps its
working columns apart from columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from twinsift.plans.storage import arrow_rows, free_name, materialize

KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
RANDOM_AT = 0.001
#: Bins of minus log10 of p, of width 1 / BINS_PER_DECADE.
BINS_PER_DECADE, DECADES = 20, 30
#: Strata of run lengths: stratum j holds lengths from 2^j on.
STRATA = 40
#: Characters scored at once; a longer text is cut at characters that no run holds.
PIECE = 1 << 20
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same as runs of any length of which those under 20 are dropped
_HEX = re.compile(r"[0-9a-f]{24,}")
_BREAK = re.compile(r"[^A-Za-z0-9+/_-]")
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets of the encodings, narrowest first. Runs of one case are read in lower case but for base32.
ENCODINGS = {"decimal": "0123456789", "hex": "0123456789abcdef", "letters": _LETTERS, "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": _LETTERS + "0123456789", "base64": _BASE64}
#: Classes that count short runs.
_CLASSES = {
    "decimal": ("01234", "56789"), "hex": ("0123456789", "abcdef"), "letters": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "234567"), "base36": (_LETTERS, "0123456789"), "base64": (_LETTERS.upper(), _LETTERS, "0123456789", "+/"),
}
_NAMES = tuple(ENCODINGS)
_LOWER, _UPPER, _DIGIT, _NOT32, _NOT16, _OTHER = 1, 2, 4, 8, 16, 32


def _flag(c: str) -> int:
    if c.isdigit():
        return _DIGIT | (_NOT32 if c in "0189" else 0)
    if c.isalpha():
        return (_LOWER if c.islower() else _UPPER) | (_NOT16 if c.lower() > "f" else 0)
    return _OTHER


#: Per byte: what it says about the encoding (0: no key character).
_FLAGS = np.zeros(256, np.uint8)
for _c in _BASE64 + "-_":
    _FLAGS[ord(_c)] = _flag(_c)


def _encoding_of_flags(f: np.ndarray) -> np.ndarray:
    """Index of the narrowest encoding for the joined flags of a run."""
    one_case = (f & _OTHER == 0) & ((f & _LOWER == 0) | (f & _UPPER == 0))
    choices = [
        (f & (_LOWER | _UPPER | _OTHER)) == 0,
        one_case & (f & _NOT16 == 0),
        one_case & (f & _DIGIT == 0),
        one_case & (f & _LOWER == 0) & (f & _NOT32 == 0),
        one_case,
    ]
    return np.select(choices, range(5), 5)


def _byte_table(places: dict[str, int], folded: bool) -> np.ndarray:
    """Per byte its place by ``places``, for either case if ``folded``; ``-`` and ``_`` are ``+`` and ``/``."""
    out = np.zeros(256, np.uint8)
    for c, i in places.items():
        out[ord(c)] = i
        if folded:
            out[ord(c.upper())] = i
        if c in "+/":
            out[ord("-" if c == "+" else "_")] = i
    return out


@lru_cache(maxsize=1)
def _countings() -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """By encoding and whether every symbol counts: table of groups by byte, and uniform shares of the groups."""
    out = {}
    for e, (name, alphabet) in enumerate(ENCODINGS.items()):
        folded = name not in ("base32", "base64")
        out[e, True] = _byte_table({c: i for i, c in enumerate(alphabet)}, folded), np.full(len(alphabet), 1 / len(alphabet))
        classes = _CLASSES[name]
        out[e, False] = _byte_table({c: i for i, part in enumerate(classes) for c in part}, folded), np.array([len(part) / len(alphabet) for part in classes])
    return out


def noncentralities(counts: np.ndarray) -> dict[tuple[int, bool], float]:
    """Noncentrality of text per character for each way of counting, from the corpus's counts of bytes."""
    out = {}
    for key, (table, shares) in _countings().items():
        letters = [c for c in range(256) if _FLAGS[c] and (chr(c) in ENCODINGS[_NAMES[key[0]]] or chr(c).lower() in ENCODINGS[_NAMES[key[0]]] or (key[0] == 5))]
        q = np.bincount(table[letters], np.asarray(counts, float)[letters], len(shares))
        out[key] = float((((q / q.sum()) - shares) ** 2 / shares).sum()) if q.sum() else 0.0
    return out


def counts_all(n: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether runs of length n in encoding e are counted by every symbol."""
    k = np.array([len(a) for a in ENCODINGS.values()])[e]
    return (n >= 10) & (n * n >= 10 * k)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of kind, end)`` of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_upper(x: float, d: int) -> float:
    """Wilson-Hilferty's normal approximation."""
    return 0.5 * math.erfc((((x / d) ** (1 / 3)) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)) / math.sqrt(2))


def _chi(counts: np.ndarray, n, shares: np.ndarray, whole: bool):
    """Chi-squared values of rows of counts, moved by half of a step towards text, as counts are whole numbers."""
    if whole:
        return (counts * counts).sum(-1) * len(shares) / n - n + len(shares) / n
    want = np.multiply.outer(n, shares)
    return ((np.abs(counts - want) + 0.5) ** 2 / want).sum(-1)


def _least_chi(n, shares: np.ndarray, whole: bool):
    """No run of n characters has a smaller value of ``_chi``."""
    k = len(shares)
    if whole:
        return (k * (n // k) ** 2 + n % k * (2 * (n // k) + 1)) * k / n - n + k / n
    return (0.25 / shares).sum() / n


def _noncentral_z(x, d, away):
    """Normal score of the lower tail of a noncentral chi-squared law, by Sankaran's approximation; large is unlikely."""
    h = 1 - 2 * (d + away) * (d + 3 * away) / (3 * (d + 2 * away) ** 2)
    p = (d + 2 * away) / (d + away) ** 2
    m = (h - 1) * (1 - 3 * h)
    return -((np.maximum(x, 1e-12) / (d + away)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * np.sqrt(2 * p) * (1 + 0.5 * m * p))


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=4)
def _score_at(rate: float) -> float:
    """Normal score whose upper tail is a little more than ``rate``; tails are compared exactly afterwards."""
    lo, hi = 0.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _upper(mid) > rate else (lo, mid)
    return lo - 1e-9


def battery(run: str, away: dict[tuple[int, bool], float]) -> tuple[float, float]:
    """Adjusted p of randomness, and p under text, of one run."""
    raw = np.frombuffer(run.encode("ascii"), np.uint8)
    e = int(_encoding_of_flags(np.bitwise_or.reduce(_FLAGS[raw])[None])[0])
    n, key = len(raw), (e, bool(counts_all(np.array(len(raw)), e)))
    table, shares = _countings()[key]
    counts = np.bincount(table[raw], minlength=len(shares))
    plain = float(((counts - n * shares) ** 2 / (n * shares)).sum())
    chi = float(_chi(counts, n, shares, key[1]))
    at, k = _countings()[e, True][0][raw].astype(float), len(ENCODINGS[_NAMES[e]])
    high = at >= k // 2
    above = int(high.sum())
    below = n - above
    runs = 1 + int((high[1:] != high[:-1]).sum())
    expected = 1 + 2 * above * below / n
    spread = (expected - 1) * (expected - 2) / (n - 1) if n > 1 else 0.0
    p_runs = _two_sided((runs - expected) / math.sqrt(spread)) if spread > 0 else 0.0
    off = at - at.mean()
    energy = float(off @ off)
    p_serial = _two_sided(float(off[1:] @ off[:-1]) / energy * math.sqrt(n)) if energy else 0.0
    return min(1.0, 3 * min(_chi_squared_upper(plain, len(shares) - 1), p_runs, p_serial)), _upper(float(_noncentral_z(chi, len(shares) - 1, away[key] * n)))


@lru_cache(maxsize=4)
def shortest(away: tuple[tuple[tuple[int, bool], float], ...], rate: float) -> int:
    """Least length from which a perfectly even run has a p under text of at most ``rate`` in some encoding."""
    known, n = dict(away), np.arange(1, 4096)
    found = [4096]
    for e, name in enumerate(_NAMES):
        whole = counts_all(n, np.full(len(n), e))
        for key in ((e, True), (e, False)):
            mine = n[whole == key[1]]
            shares = _countings()[key][1]
            even = mine[_noncentral_z(_least_chi(mine, shares, key[1]), len(shares) - 1, known[key] * mine) >= _score_at(rate)]
            found += even[:1].tolist()
    return min(found)


def score_runs(raw: np.ndarray, away: dict[tuple[int, bool], float], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs in ``raw``, and which of them have a p under text of at most ``rate``."""
    flags = _FLAGS[raw]
    edges = np.flatnonzero(np.diff(flags > 0, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    unlikely = np.zeros(len(starts), bool)
    # shorter runs have no p of at most the rate in any encoding, so theirs need not be found
    long = np.flatnonzero(ends - starts >= shortest(tuple(sorted(away.items())), rate))
    if not len(long):
        return starts, ends, unlikely
    begin, n = starts[long], (ends - starts)[long]
    e = _encoding_of_flags(np.bitwise_or.reduceat(np.append(flags, np.uint8(0)), np.stack([begin, begin + n], 1).ravel())[::2])
    whole, limit = counts_all(n, e), _score_at(rate)
    for key, (table, shares) in _countings().items():
        mine = np.flatnonzero((e == key[0]) & (whole == key[1]))
        d, a = len(shares) - 1, away[key]
        # even a perfectly even run of this length may be likely under text
        mine = mine[_noncentral_z(_least_chi(n[mine], shares, key[1]), d, a * n[mine]) >= limit]
        if not len(mine):
            continue
        size = n[mine]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(begin[mine] - first, size)
        counts = np.bincount(np.repeat(np.arange(len(mine)) * (d + 1), size) + table[raw[at]], minlength=len(mine) * (d + 1)).reshape(-1, d + 1)
        unlikely[long[mine]] = _noncentral_z(_chi(counts, size, shares, key[1]), d, a * size) >= limit
    return starts, ends, unlikely


def _blocks(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined pieces of about ``PIECE`` characters, one byte a code point: bytes, and per piece its place, text and offset in the text."""
    held: list[tuple[str, int, int]] = []
    size = 0

    def settled():
        lengths = [len(t) + 1 for t, _, _ in held]
        return "\n".join([t for t, _, _ in held]).encode("latin-1", "replace"), np.cumsum([0, *lengths[:-1]]), np.array([r for _, r, _ in held]), np.array([o for _, _, o in held])

    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + PIECE, len(text))
            if end < len(text):
                found = _BREAK.search(text, end)
                end = found.start() if found else len(text)
            held.append((text[at:end], row, at))
            size += end - at
            at = end
            if size >= PIECE:
                yield settled()
                held, size = [], 0
    if held:
        yield settled()


def random_runs(texts: list[str], away: dict[tuple[int, bool], float], rate: float = FDR) -> tuple[list[list[tuple[int, int, int, float]]], np.ndarray]:
    """Per text its runs that pass the battery with a p of at most ``rate``, ``(start, rank, end, p)``, and its number of runs by stratum."""
    out: list[list] = [[] for _ in texts]
    tested = np.zeros((len(texts), STRATA), np.int64)
    for data, places, rows, offsets in _blocks(texts):
        starts, ends, unlikely = score_runs(np.frombuffer(data, np.uint8), away, rate)
        piece = np.searchsorted(places, starts, side="right") - 1
        stratum = np.log2(ends - starts + 0.5).astype(int) if len(starts) else starts
        tested += np.bincount(rows[piece] * STRATA + stratum, minlength=tested.size).reshape(tested.shape)
        for i in np.flatnonzero(unlikely).tolist():
            random, p = battery(data[starts[i] : ends[i]].decode("ascii"), away)
            if random >= RANDOM_AT and p <= rate:
                shift = int(offsets[piece[i]] - places[piece[i]])
                out[rows[piece[i]]].append((int(starts[i]) + shift, 3, int(ends[i]) + shift, p))
    return out, tested


def scan_texts(texts: list[str | None], away: dict[tuple[int, bool], float], rate: float = FDR) -> tuple[list[list[tuple]], np.ndarray]:
    """Per text all spans ``(start, rank, end, p)`` in order (p is None for base spans), and its number of runs by stratum."""
    whole = [t or "" for t in texts]
    found, tested = random_runs(whole, away, rate)
    return [sorted([(*b, None) for b in base_spans(t)] + own, key=lambda x: x[:3]) for t, own in zip(whole, found, strict=True)], tested


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("rank", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("p", DoubleType())]))
SCANNED = StructType([StructField("found", SPANS), StructField("tested", ArrayType(LongType()))])


def symbol_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all bytes below 128 over all texts (null: empty); other bytes stay zero."""

    def counted(batches):
        import pyarrow as pa

        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_string()).drop_null().to_pylist():
                total += np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(128), pa.int32()), pa.array(total[:128])], ["symbol", "n"])

    rows = df.select(F.col(text_col).cast("string")).mapInArrow(counted, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256, np.int64)
    for r in rows:
        out[r["symbol"]] = r["n"]
    return out


def scanned(text: Column, away: dict[tuple[int, bool], float], rate: float = FDR) -> Column:
    """Struct column: ``found``, all base spans and the runs that pass the battery with their p, and ``tested``, numbers of runs by stratum."""

    @F.arrow_udf(SCANNED)
    def scan_texts_of(texts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        spans, tested = scan_texts(texts.to_pylist(), away, rate)
        named = [[{"start": s, "rank": r, "end": e, "kind": KINDS[r], "p": p} for s, r, e, p in own] for own in spans]
        return pa.StructArray.from_arrays([pa.array(named, to_arrow_type(SPANS)), pa.array(tested.tolist(), pa.list_(pa.int64()))], ["found", "tested"])

    # not deterministic for the optimiser: it must not scan again for each use of the spans
    return scan_texts_of.asNondeterministic()(text)


def scan(df: DataFrame, text_col: str = "text", column: str = "scanned", rate: float = FDR, keep_text: bool = True) -> DataFrame:
    """``df`` with the struct column ``column`` of ``scanned``, stored; without the texts unless ``keep_text``."""
    arrow_rows(df.sparkSession)
    spans = scanned(F.col(text_col), noncentralities(symbol_counts(df, text_col)), rate)
    return materialize(df.select(*[F.col(c) for c in df.columns if keep_text or c != text_col], spans.alias(column)), "secrets")


def cuts_of(tests: dict[int, int], bins: dict[int, dict[int, int]], rate: float = FDR) -> list[float]:
    """By stratum the largest p that Benjamini-Hochberg accepts; a bin counts with its upper edge."""
    out = [0.0] * STRATA
    for stratum, own in bins.items():
        below = 0
        for b in sorted(own, reverse=True):
            below += own[b]
            edge = 10.0 ** (-b / BINS_PER_DECADE)
            if edge * tests[stratum] <= rate * below:
                out[stratum] = edge
    return out


def thresholds(stored: DataFrame, column: str = "scanned", rate: float = FDR) -> list[float]:
    """Cuts by stratum over the whole stored table."""
    tests = stored.select(F.posexplode(f"{column}.tested").alias("stratum", "n")).groupBy("stratum").agg(F.sum("n").alias("n")).collect()
    f = F.col("f")
    p = stored.select(F.explode(f"{column}.found").alias("f")).where("f.p IS NOT NULL").select(_stratum(f).alias("stratum"), f["p"].alias("p"))
    binned = F.least(F.lit(BINS_PER_DECADE * DECADES), F.floor(-F.log10(F.greatest("p", F.lit(10.0**-DECADES))) * BINS_PER_DECADE))
    bins: dict[int, dict[int, int]] = {}
    for r in p.groupBy("stratum", binned.cast("int").alias("b")).count().collect():
        bins.setdefault(r["stratum"], {})[r["b"]] = r["count"]
    return cuts_of({r["stratum"]: r["n"] for r in tests}, bins, rate)


def _stratum(span: Column) -> Column:
    return F.floor(F.log2(span["end"] - span["start"] + F.lit(0.5))).cast("int")


def accepted(found: Column, cuts: list[float]) -> Column:
    """Base spans and those random runs whose p is at most the cut of their stratum."""
    at = F.array(*[F.lit(c) for c in cuts])
    return F.filter(found, lambda f: f["p"].isNull() | (f["p"] <= F.get(at, _stratum(f))))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: float = FDR) -> DataFrame:
    """Per row: ``doc_id`` and its ``spans`` under false-discovery control over the whole table."""
    stored = scan(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rate=rate, keep_text=False)
    return stored.select("doc_id", accepted(F.col("scanned.found"), thresholds(stored, rate=rate)).alias("spans"))


def redact_text(text: str, spans: list[dict], mark: str) -> str:
    """``text`` with its spans, in order of their starts, replaced by ``mark``; overlapping ones become one mark."""
    out, done = [], 0
    for span in spans:
        if span["end"] > done:
            if span["start"] >= done:
                out += [text[done : span["start"]], mark]
            done = span["end"]
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", rate: float = FDR) -> DataFrame:
    """``df`` with every accepted span of the text replaced by ``mark``; null text stays null.

    Each text is scanned once: rows are stored with their spans and read again with the cuts.
    """
    column = free_name(df, "scanned")
    stored = scan(df, text_col, column, rate)

    @F.arrow_udf(StringType())
    def redacted(texts, spans):
        import pyarrow as pa

        return pa.array([t if t is None or not s else redact_text(t, s, mark) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return stored.withColumn(text_col, redacted(F.col(text_col), accepted(F.col(f"{column}.found"), thresholds(stored, column, rate)))).select(*df.columns)
