"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import pin

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Score bins, and the longest length with a class of its own (in powers of the square root of 2).
BINS, BANDS = 60, 24

#: Encodings in the order they are tried: what fits, and the alphabet's symbols in order.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (re.compile(r"[0-9]+"), "0123456789"),
    (re.compile(r"[0-9a-f]+"), "0123456789abcdef"),
    (re.compile(r"[0-9A-F]+"), "0123456789ABCDEF"),
    (re.compile(r"[A-Z2-7]+"), _LETTERS + "234567"),
    (re.compile(r"[A-Za-z0-9+/_-]+"), _LETTERS + _LETTERS.lower() + "0123456789+/"),
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def symbols(token: str) -> tuple[np.ndarray, int]:
    """The token's symbol numbers under the smallest encoding that fits, and the alphabet's size."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/").replace("=", "")
    for fits, alphabet in ENCODINGS:
        if fits.fullmatch(body):
            order = {c: i for i, c in enumerate(alphabet)}
            return np.array([order[c] for c in body]), len(alphabet)
    return np.zeros(0, np.int64), 1


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> float:
    """How random the token looks: the smallest p-value of three tests, times three.

    The hypothesis of all tests is a uniform random string of the inferred encoding. Chi-squared compares symbol counts
    with uniform ones (through the cube-root normal approximation, which holds for few symbols), the runs test counts runs
    above and below the middle of the alphabet, and serial correlation compares each symbol with the next.
    """
    codes, k = symbols(token)
    n = len(codes)
    if n < 8 or k < 2:
        return 0.0
    chi = float((np.bincount(codes, minlength=k) ** 2).sum()) * k / n - n
    d = k - 1
    uniform = normal_tail(((max(chi, 0.0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    high = codes >= k / 2
    a = int(high.sum())
    b = n - a
    if not a or not b:
        return 0.0
    mean, runs = 2 * a * b / n + 1, 1 + int((high[1:] != high[:-1]).sum())
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    z = codes - codes.mean()
    serial = float((z[1:] * z[:-1]).sum() / max((z * z).sum(), 1e-9))
    both = [2 * normal_tail(abs(runs - mean) / spread), 2 * normal_tail(abs(serial + 1 / n) * math.sqrt(n))]
    return min(1.0, 3 * min(uniform, *both))


def length_band(n: int) -> int:
    return min(BANDS - 1, int(2 * math.log2(n)) - 8)


def score_bin(p: float) -> int:
    """Higher is more random; bins are even in the logarithm of the p-value, down to 10**-15."""
    return max(0, min(BINS - 1, int(BINS * (1 + math.log10(max(p, 1e-15)) / 15))))


def natural(token: str) -> bool:
    """Letters in the case of ordinary words or names: the sample of what is not a secret."""
    parts = re.split(r"[-_/+=]", token)
    return all(x.isalpha() and (x.islower() or x.isupper() or x.istitle()) for x in parts if x)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool, int]]]:
    """Fixed spans, and candidates (start, end, cell, natural, hash) that overlap none of them; a cell is length band and bin."""
    import xxhash

    base, tokens = base_spans(text), []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in base):
            continue
        token = m.group()
        if token.isdigit() and len(token) < 32:
            continue  # account and card numbers are no keys
        tokens.append((a, b, length_band(b - a) * BINS + score_bin(battery(token)), natural(token), xxhash.xxh64_intdigest(token) - (1 << 63)))
    return base, tokens


def discoveries(counts: dict[tuple[int, bool], int], rate: float) -> list[int]:
    """Cells whose candidates are declared secrets at a false-discovery rate of at most ``rate``.

    A candidate's p-value is the share of natural tokens that look at least as random, among those of its own length band
    and shorter ones. The tests gain power with length, so shorter tokens make that share too large, never too small,
    and short candidates have to do better than long ones. Step-up control runs over the bounded table of cells.

    Counts are of distinct tokens. Where the natural sample is too small for any share to reach ``rate``, the battery's own
    hypothesis decides: candidates pass unless it rejects that they are uniform random strings at level ``rate``.
    """
    cells, unresolved, plain = [], [], [0] * BINS
    for band in range(BANDS):
        plain = [n + counts.get((band * BINS + i, True), 0) for i, n in enumerate(plain)]
        total, above = sum(plain), 0
        for i in reversed(range(BINS)):
            above += plain[i]
            if n := counts.get((band * BINS + i, False), 0):
                if (total + 1) * rate >= 1:
                    cells.append(((above + 1) / (total + 1), band * BINS + i, n))
                elif 10 ** (15 * (i / BINS - 1)) >= 0.999 * rate:
                    unresolved.append(band * BINS + i)
    cells.sort()
    tested, passed, keep = sum(n for *_, n in cells), 0, 0
    for j, (p, _, n) in enumerate(cells):
        passed += n
        if p * tested <= rate * passed:
            keep = j + 1
    return unresolved + [cell for _, cell, _ in cells[:keep]]


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Fixed patterns always stay. Other long tokens go through ``battery``; natural words of the whole corpus calibrate it by
    length and candidates pass at a false-discovery rate of ``rate``. Every distinct token counts once, however often it
    is copied. The counts that decide are a table of at most 24 length bands by 60 bins by 2, whatever the corpus.

    Null and empty texts have no spans. Null ids stay null, repeated rows are scanned each, an empty table gives no rows
    and other columns are not read. Long texts are scanned whole.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan(t) for t in batch["text"].fillna("")]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").array,
                "base": [[x for s in b for x in s] for b, _ in found],
                "tokens": [[x for s in t for x in (s[0], s[1], 2 * s[2] + s[3], s[4])] for _, t in found],
            })

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = pin(source.mapInPandas(first, "doc_id long, base array<long>, tokens array<long>"), "secrets")
    places = F.sequence(F.lit(2), F.size("tokens") - 2, F.lit(4))
    pairs = F.transform(places, lambda i: F.struct(F.get("tokens", i).alias("cell"), F.get("tokens", i + 1).alias("hash")))
    distinct = rows.where(F.size("tokens") > 0).select(F.explode(pairs).alias("t")).select("t.*").distinct()
    counted = distinct.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    random = frozenset(discoveries({(r["cell"] // 2, bool(r["cell"] % 2)): r["n"] for r in counted}, rate))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            out = []
            for doc, flat, tokens in zip(batch["doc_id"].astype("Int64"), batch["base"], batch["tokens"], strict=True):
                base = [tuple(int(v) for v in flat[i : i + 3]) for i in range(0, len(flat), 3)]
                more = [(int(tokens[i]), 3, int(tokens[i + 1])) for i in range(0, len(tokens), 4) if not tokens[i + 2] % 2 and tokens[i + 2] // 2 in random]
                kinds = [s[1] for s in base]
                sha = hashlib.sha256(spans_text(base).encode()).hexdigest()
                out.append((doc, kinds.count(0), kinds.count(1), kinds.count(2), sha, spans_text(sorted(base + more)), len(more)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(last, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
