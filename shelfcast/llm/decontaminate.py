"""Benchmark overlap by winnowing: fingerprints of word runs, joined between corpus and benchmark, extended and compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.common import small_batches, spread_join
from shelfcast.llm.tokens import slices
from shelfcast.session import pin

#: Words of a window, and of the run that a fingerprint is the hash of. Every SPAN words hold SPAN - RUN + 1 runs, and
#: the least of their hashes is a fingerprint, so whatever shares SPAN words shares a fingerprint.
SPAN, RUN = 10, 5
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
_POWERS = np.ones(1, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16) - 1, _FACTOR, np.uint64))])
    return _POWERS[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts, A-Z in lower case: where each begins and ends in ``raw``, its text and a hash."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "replace").lower() for t in texts]
        self.raw = b"\n".join(parts)
        is_word = np.concatenate([[False], _WORD_BYTE[np.frombuffer(self.raw, np.uint8)], [False]])
        edge = np.flatnonzero(is_word[1:] != is_word[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        # Words of text i are numbers bounds[i] to bounds[i + 1].
        self.bounds = np.concatenate([np.searchsorted(self.start, first), [len(self.start)]])
        # A word's hash is the sum of its bytes times powers of an odd number, counted from its own beginning.
        data = np.frombuffer(self.raw, np.uint8).astype(np.uint64) + np.uint64(1)
        power = _powers(len(data) + 1)
        summed = np.concatenate([[np.uint64(0)], np.cumsum(data * power[:-1], dtype=np.uint64)])
        back = self._inverse(self.start)
        self.hash = _mixed((summed[self.end] - summed[self.start]) * back + (self.end - self.start).astype(np.uint64))

    @staticmethod
    def _inverse(at: np.ndarray) -> np.ndarray:
        """Powers of the inverse factor, by squaring."""
        out, base, left = np.ones(len(at), np.uint64), _INVERSE, at.astype(np.uint64)
        while left.any():
            np.multiply(out, np.uint64(base), out=out, where=(left & np.uint64(1)).astype(bool))
            left >>= np.uint64(1)
            base = base * base % (1 << 64)
        return out

    def runs(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; the last k - 1 of the batch have none."""
        n = max(0, len(self.hash) - k + 1)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        return _mixed(out)

    def words(self, a: int, b: int) -> list[str]:
        return [self.raw[s:e].decode() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def within(bounds: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of ``n`` runs of ``k`` words, whether it lies within one text."""
    inside = np.ones(n, bool)
    for b in bounds[1:-1]:
        inside[max(0, b - k + 1) : b] = False
    return inside


def winnow(words: Words, span: int = SPAN, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of the fingerprints: of every ``span - run + 1`` runs in a row the least, the last of equals.

    Texts of fewer than ``span`` words have none.
    """
    hashes, wide = words.runs(run), span - run + 1
    n = len(hashes) - wide + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, wide):
        lower = hashes[j : j + n] <= least
        least = np.where(lower, hashes[j : j + n], least)
        at = np.where(lower, np.arange(j, j + n), at)
    at = np.unique(at[within(words.bounds, n, span)])
    return at, hashes[at]


def keys(words: Words, short: list[int], span: int, run: int) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
    """(whole item, words in the run, word numbers, hashes): fingerprints, and all runs as long as a short item."""
    yield False, run, *winnow(words, span, run)
    for k in short:
        hashes = words.runs(k)
        at = np.flatnonzero(within(words.bounds, len(hashes), k))
        yield True, k, at, hashes[at]


class Sift:
    """A bitmap of the benchmark's hashes: what it does not know is not there. 512 bits for each hash, 16 MB at most."""

    def __init__(self, runs: DataFrame):
        self.depth = min(27, max(16, (512 * runs.count()).bit_length()))
        segment = F.shiftrightunsigned("hash", 64 - (self.depth - 6))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("hash", 64 - self.depth).bitwiseAND(F.lit(63)).cast("int"))
        held = runs.groupBy(segment.alias("segment")).agg(F.bit_or(bit).alias("bits")).toPandas()
        self.words = np.zeros(1 << (self.depth - 6), np.int64)
        self.words[held["segment"].to_numpy()] = held["bits"].to_numpy()
        self.words = self.words.view(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.depth)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


#: A run: whether it is a whole item, its words and their hash, its text, and words of its text on either side, nearest first.
CONTEXT = ["whole", "k", "hash", "run", "before", "after"]
CONTEXT_TYPES = "whole boolean, k int, hash long, run string, before array<string>, after array<string>"


def around(words: Words, at: int, k: int, low: int, high: int, reach: int) -> tuple[str, list[str], list[str]]:
    """The run at word ``at``, and up to ``reach`` words on either side within words ``low`` to ``high``."""
    a, b = max(low, at - reach), min(high, at + k + reach)
    every = words.words(a, b)
    return " ".join(every[at - a : at - a + k]), every[: at - a][::-1], every[at - a + k :]


def benchmark_runs(items: DataFrame, span: int = SPAN, run: int = RUN) -> DataFrame:
    """(item_id, CONTEXT): fingerprints of every item; an item of fewer than ``span`` words is one run."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].fillna("").tolist(), batch["item_id"].astype("Int64").tolist()
            for a, b in slices(texts, 500_000):
                words, out = Words(texts[a:b]), []
                sizes, first = np.diff(words.bounds), words.bounds
                short = sorted({int(n) for n in sizes if 0 < n < span})
                for whole, k, at, hashes in keys(words, short, span, run):
                    place = np.searchsorted(first, at, side="right") - 1
                    fits = (sizes[place] == k) if whole else np.ones(len(at), bool)
                    for i, h, t in zip(at[fits].tolist(), hashes[fits].view(np.int64).tolist(), place[fits].tolist(), strict=True):
                        out.append((ids[a + t], whole, k, h, *around(words, i, k, first[t], first[t + 1], 0 if whole else span - run)))
                frame = pd.DataFrame(out, columns=["item_id", *CONTEXT])
                frame["item_id"] = frame["item_id"].astype("Int64")
                yield frame

    source = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return source.mapInPandas(cut, f"item_id long, {CONTEXT_TYPES}").distinct()


def corpus_runs(docs: DataFrame, sift: Sift, short: list[int], span: int = SPAN, run: int = RUN) -> DataFrame:
    """(row, doc_id, n_words, hits): every document with those of its runs that may be in the benchmark."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows, ids = batch["text"].fillna("").tolist(), batch["row"].array, batch["doc_id"].astype("Int64").array
            for a, b in slices(texts, 1_000_000):
                words = Words(texts[a:b])
                first, hits = words.bounds, [[] for _ in range(b - a)]
                for whole, k, at, hashes in keys(words, short, span, run):
                    known = sift(hashes)
                    at, hashes = at[known], hashes[known].view(np.int64)
                    place = np.searchsorted(first, at, side="right") - 1
                    for i, h, t in zip(at.tolist(), hashes.tolist(), place.tolist(), strict=True):
                        hits[t].append((i - int(first[t]), whole, k, h, *around(words, i, k, first[t], first[t + 1], 0 if whole else span - run)))
                yield pd.DataFrame({"row": rows[a:b], "doc_id": ids[a:b], "n_words": np.diff(first), "hits": hits})

    source = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit = ",".join(x.strip().replace(" ", ":", 1) for x in f"at int, {CONTEXT_TYPES}".split(","))
    return source.mapInPandas(cut, f"row long, doc_id long, n_words long, hits array<struct<{hit}>>")


def agreeing(a: str, b: str, most: int) -> Column:
    """How many first elements two arrays of up to ``most`` have in common."""
    return sum(((F.size(a) >= i) & (F.size(b) >= i) & (F.slice(a, 1, i) == F.slice(b, 1, i))).cast("int") for i in range(1, most + 1))


def shared_spans(found: DataFrame, contexts: DataFrame, span: int = SPAN, run: int = RUN) -> DataFrame:
    """(row, context, a, z): words a to z (exclusive) of a document that are a window, or windows, of a benchmark context.

    Runs with equal hashes are compared word by word and extended on both sides, as far as a window that holds the run can
    reach. A run that half of all documents hold is dealt over many tasks.
    """
    hits = pin(found.select("row", F.explode("hits").alias("h")).select("row", "h.*"), "overlap-hits")
    side = contexts.select("context", "whole", "k", "hash", *[F.col(c).alias(f"i_{c}") for c in ("run", "before", "after")])
    both = spread_join(hits, side, ["whole", "k", "hash"]).where(F.col("run") == F.col("i_run"))
    reach = span - run
    both = both.withColumn("left", agreeing("before", "i_before", reach)).withColumn("right", agreeing("after", "i_after", reach))
    full = both.where(F.col("whole") | (F.col("left") + F.col("k") + F.col("right") >= span))
    return full.select("row", "context", (F.col("at") - F.col("left")).alias("a"), (F.col("at") + F.col("k") + F.col("right")).alias("z"))


def merged(spans: DataFrame) -> DataFrame:
    """(row, n_hit, spans): overlapping and touching spans of a document as one, in order, and the words in them."""
    order = Window.partitionBy("row").orderBy("a", "z")
    apart = F.col("a") > F.coalesce(F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = spans.select("row", "a", "z").distinct().withColumn("new", apart.cast("int"))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = island.groupBy("row", "island").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return one.groupBy("row").agg(F.sum(F.col("z") - F.col("a")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("a", "z"))).alias("spans"))


def overlaps(docs: DataFrame, items: DataFrame, span: int = SPAN, run: int = RUN) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, items, spans, contaminated).

    A word is a run of letters, digits and characters beyond ASCII, A-Z in lower case. A window is ``span`` words of an
    item, or the whole of a shorter item. ``spans`` are the document's words (from, to exclusive) inside windows, ``n_hit``
    their number, ``items`` the ids of items with a window in the document, as sorted strings.

    Every shared window holds a fingerprint that both sides pick, so none is missed; hits are compared word by word. Only
    runs whose hash the benchmark may have leave the scan of the documents. Null texts have no words. A null doc_id
    stays null; a null item_id counts as an item with an empty id; items with the same id are one. Repeated documents have
    a row each. Empty tables on either side give no hits; other columns are not read.
    """
    runs = pin(benchmark_runs(items, span, run), "benchmark-runs")
    contexts = pin(runs.select(*CONTEXT).distinct().withColumn("context", F.monotonically_increasing_id()), "benchmark-contexts")
    short = sorted(r["k"] for r in runs.where("whole").select("k").distinct().collect())
    found = pin(corpus_runs(docs, Sift(runs.select("hash").distinct()), short, span, run), "corpus-runs")
    spans = pin(shared_spans(found, contexts, span, run), "overlap-spans")
    # Arrays of one item's context name it exactly: hash, run and neighbours.
    owners = runs.join(contexts, CONTEXT).select("context", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    named = spread_join(pin(spans.select("row", "context").distinct(), "overlap-contexts"), owners, ["context"]).select("row", "item").distinct()
    listed = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = found.select("row", "doc_id", "n_words").join(merged(spans), "row", "left").join(listed, "row", "left")
    none = F.array()
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none.cast("array<string>")).alias("items"),
        F.coalesce("spans", none.cast("array<struct<a:int,z:int>>")).alias("spans"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
