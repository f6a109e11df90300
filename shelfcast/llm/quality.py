"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import SPACES
from shelfcast.session import pin

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_shouts", "n_distinct",
)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a run of ``width`` words found twice or more, the first occurrence included."""
    runs = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(runs)) == len(runs):
        return 0
    often, total, upto = Counter(runs), 0, 0
    for i, r in enumerate(runs):
        if often[r] > 1:
            total += i + width - max(i, upto)
            upto = i + width
    return total


def measures(text: str) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    letters = sum(map(raw.count, _LETTERS)) if len(raw) == len(text) else sum(map(str.isalpha, text))
    upper = sum(map(raw.count, _UPPER)) if len(raw) == len(text) else sum(map(str.isupper, text))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(raw.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), letters, upper, raw.count(b"!"), len(set(words)),
    )


_SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_UPPER = [bytes([c]) for c in range(65, 91)]
_LETTERS = _UPPER + [bytes([c]) for c in range(97, 123)]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, MEASURES...) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measures(t) for t in batch["text"].fillna("")], columns=list(MEASURES), dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInPandas(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def rules() -> tuple[dict[str, Column], dict[str, Column]]:
    """Rules over ``MEASURES`` that vote bad, and rules that vote good, where they hold; elsewhere they abstain.

    A rule against a document looks at one trait. A rule for it asks for several ordinary traits at once, so that
    different kinds of junk have in common what they lack.
    """
    c = {m: F.col(m).cast("double") for m in MEASURES}
    words, letters = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_letters"], F.lit(1.0))
    mean, share = c["word_chars"] / words, c["n_repeat_words"] / words
    symbols, shouts, upper = c["n_symbols"] / words, c["n_shouts"] / words, c["n_upper"] / letters
    alphabetic, lines = c["n_letters"] / F.greatest(c["word_chars"], F.lit(1.0)), c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0))
    variety = c["n_distinct"] / words
    bad = {
        "short": c["n_words"] < 5,
        "word_length": (mean < 2) | (mean > 15),
        "symbols": symbols > 0.2,
        "repeats": share > 0.3,
        "lines": lines > 0.5,
        "capitals": upper > 0.5,
        "shouting": shouts > 0.2,
        "letters": alphabetic < 0.4,
        "variety": (variety < 0.15) & (c["n_words"] >= 20),
    }
    calm = (symbols < 0.1) & (shouts < 0.1)
    good = {
        "prose": calm & (alphabetic > 0.5) & (upper < 0.3) & (mean >= 3) & (mean <= 12),
        "flow": calm & (variety > 0.35) & (share < 0.1) & (lines < 0.1) & (c["n_words"] >= 10),
        "size": c["n_words"] >= 50,
    }
    return bad, good


def estimate(fired: np.ndarray, weight: np.ndarray, against: np.ndarray, rounds: int = 1000) -> tuple[float, np.ndarray, np.ndarray]:
    """Log odds of quality: a constant, what each rule adds where it votes, and where it abstains.

    ``fired`` holds the distinct rows of votes (1 or 0), ``weight`` how often each occurs, ``against`` which rules vote
    bad. Expectation-maximisation starts from the balance of votes and estimates how often each rule votes in either
    class, with one pseudo document that votes and one that abstains; a vote never counts for the opposite of what it
    says.
    """
    rules = len(against)
    if not len(fired):
        return 0.0, np.zeros(rules), np.zeros(rules)
    balance = fired[:, ~against].sum(axis=1) - 3.0 * fired[:, against].sum(axis=1)
    good, constant, votes, silent = 1 / (1 + np.exp(-(1 + balance))), 0.0, np.zeros(rules), np.zeros(rules)
    for _ in range(rounds):
        high, low = weight * good, weight * (1 - good)
        p, q = (high @ fired + 1) / (high.sum() + 2), (low @ fired + 1) / (low.sum() + 2)
        wrong = np.where(against, p > q, p < q)
        votes = np.where(wrong, 0, np.log(p) - np.log(q))
        silent = np.where(wrong, 0, np.log(1 - p) - np.log(1 - q))
        constant = math.log((high.sum() + 1) / (low.sum() + 1))
        new = 1 / (1 + np.exp(-np.clip(constant + fired @ votes + (1 - fired) @ silent, -500, 500)))
        moved = np.abs(new - good).max()
        good = new
        if moved < 1e-9:
            break
    return constant, votes, silent


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, posterior and kept.

    Rules vote good or bad or abstain. The distinct rows of votes are counted over all documents (at most two to the
    number of rules, whatever the corpus) and expectation-maximisation estimates how reliable each rule is;
    ``posterior`` is the probability of quality given all votes. A document is kept unless it fails the base rule or
    its posterior is below ``threshold``.

    Null and empty texts have no words and fail the base rule. Null ids stay null, repeated rows are judged alike, an
    empty table gives no rows, other columns are not read. A very long text is measured whole in one call.
    """
    bad, good = rules()
    names = [f"vote_{n}" for n in (*bad, *good)]
    rows = pin(measured(docs).select("*", *[F.when(r, 1).otherwise(0).alias(f"vote_{n}") for n, r in (bad | good).items()]), "quality-votes")
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    fired = np.array([[r[n] for n in names] for r in counted], dtype=float).reshape(-1, len(names))
    against = np.arange(len(names)) < len(bad)
    constant, votes, silent = estimate(fired, np.array([r["n"] for r in counted], dtype=float), against)
    parts = [F.when(F.col(n) == 1, float(v)).otherwise(float(s)) for n, v, s in zip(names, votes, silent, strict=True)]
    odds = reduce(lambda a, b: a + b, parts, F.lit(float(constant)))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return rows.select("doc_id", *MEASURES, failed.alias("base_failed"), posterior.alias("posterior")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )
