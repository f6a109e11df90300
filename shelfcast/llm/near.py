"""Near copies by similarity of word runs: MinHash buckets, bit-sliced SimHash and exact checks inside, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import small_batches
from shelfcast.llm.components import connected
from shelfcast.llm.simhash import close_pairs, close_to, forest, shingle_hashes
from shelfcast.llm.tokens import slices
from shelfcast.session import pin

#: A row's key: rows without a doc_id come last, equal ids are told apart by a hash of the row.
KEY = ("no_id", "id", "hash")

#: Bands of a signature and minima in each: a pair at similarity s shares a band with probability 1 - (1 - s**DEEP)**BANDS,
#: at 0.8 all but about one in 10**7.
BANDS, DEEP = 40, 5


def signatures(texts: list[str], words: int) -> tuple[list[bytes], list[int], list[np.ndarray]]:
    """Digest and size of every text's set of shingle hashes, and its band keys; no bands without words."""
    import xxhash

    hashes = [np.unique(shingle_hashes(t, words)) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    keys = np.empty((len(texts), 0), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        rng = np.random.default_rng(5)
        flat, starts = np.concatenate(hashes), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        mixed = np.empty((len(full), BANDS), np.uint64)
        for band in range(BANDS):
            x = np.full(len(full), band + 1, np.uint64)
            for mask, factor in rng.integers(1, 2**64, (DEEP, 2), np.uint64):
                least = np.minimum.reduceat((flat ^ mask) * (factor | np.uint64(1)), starts)
                x = (x ^ least) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
            mixed[:, band] = x
        keys = mixed.view(np.int64)
    place = np.cumsum(sizes > 0) - 1
    bands = [keys[place[i]] if sizes[i] else np.empty(0, np.int64) for i in range(len(texts))]
    return [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], sizes.tolist(), bands


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as one column ``row``, their text, and KEY."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    number = F.col("doc_id").cast("long")
    return docs.select(
        F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"),
        number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(*columns).alias("hash"),
    )


def print_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes, as a signed number: the bits that over half of them set."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 100_000):
        votes += np.unpackbits(hashes[a : a + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, print, runs) of the wanted nodes: SimHash and sorted set of their shingle hashes."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts, 2_000_000):
                sets = [np.unique(shingle_hashes(t, words)) for t in texts[a:b]]
                prints = [print_of(h) for h in sets]
                yield pd.DataFrame({"node": batch["node"].iloc[a:b].array, "print": prints, "runs": [h.view(np.int64) for h in sets]})

    named = nodes.join(wanted, "node", "left_semi").select("node", "first.*")
    found = rows.select(*KEY, "text").join(named, list(KEY)).dropDuplicates(["node"]).select("node", "text")
    return small_batches(found).mapInPandas(shingles, "node binary, print long, runs array<long>")


def close_star(star: DataFrame, sets: DataFrame, radius: int, salts: int = 64) -> DataFrame:
    """The pairs (u, v) of ``star`` whose fingerprints are within ``radius`` bits, compared bit-sliced: v with 64 of its u at once."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = batch["v"].to_numpy(object)
            starts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
            own, hub = (batch[c].to_numpy().view(np.uint64) for c in ("own", "hub"))
            yield batch[["u", "v"]].iloc[close_to(hub[starts], own, np.diff(np.append(starts, len(batch))), radius)]

    prints = sets.select("node", "print")
    both = star.join(prints.select(F.col("node").alias("u"), F.col("print").alias("own")), "u")
    both = both.join(prints.select(F.col("node").alias("v"), F.col("print").alias("hub")), "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)))
    dealt = both.repartition("v", "salt").sortWithinPartitions("v").select("u", "v", "own", "hub")
    return dealt.mapInPandas(compare, "u binary, v binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least ``similarity`` in common, measured exactly."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("runs").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("runs").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v")


def overlaps(sets: list[np.ndarray], often: int = 16, width: int = 4096) -> np.ndarray:
    """Matrix of the common elements of every two sets.

    Elements of at least ``often`` sets are columns of 0 and 1 that are multiplied ``width`` at a time; rarer ones are
    counted pair by pair.
    """
    common = np.zeros((len(sets), len(sets)))
    _, element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rare = np.flatnonzero((counts[element] > 1) & (counts[element] < often))
    rare = rare[np.argsort(element[rare], kind="stable")]
    for step in range(1, often - 1):
        same = np.flatnonzero(element[rare[:-step]] == element[rare[step:]])
        np.add.at(common, (owner[rare[same]], owner[rare[same + step]]), 1)
    common += common.T
    column = np.cumsum(counts >= often) - 1
    shared = np.flatnonzero(counts[element] >= often)
    shared = shared[np.argsort(column[element[shared]], kind="stable")]
    place = column[element[shared]]
    for a in range(0, int((counts >= often).sum()), width):
        low, high = np.searchsorted(place, [a, a + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[shared[low:high]], place[low:high] - a] = 1
        common += x @ x.T
    return common


def tile_links(similarity: float, radius: int):
    """Partition function: rows sorted by tile pair in, links (u > v) between roots that have similar nodes there out."""
    by = ["bucket", "low", "high"]

    def links(block: pd.DataFrame) -> pd.DataFrame:
        names, group = np.unique(block["root"].to_numpy(object), return_inverse=True)
        n = block["runs"].map(len).to_numpy()
        wanted = np.zeros((len(block), len(block)), bool)
        for i, j in close_pairs(block["print"].to_numpy().view(np.uint64), np.array([len(block)]), radius):
            fits = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
            wanted[i[fits], j[fits]] = True
        take = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
        if not len(take):
            return pd.DataFrame({"u": [], "v": []}, dtype=object)
        common = overlaps(block["runs"].iloc[take].tolist())
        alike = common / (n[take, None] + n[take] - common) >= similarity
        i, j = np.nonzero(alike & wanted[np.ix_(take, take)])
        label = forest(len(names), group[take[i]], group[take[j]])
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"u": names[moved], "v": names[label[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = (held[by].to_numpy()[1:] != held[by].to_numpy()[:-1]).any(axis=1)
            starts = [0, *(np.flatnonzero(new) + 1)]
            # Rows of the last tile pair wait for the next batch.
            for a, b in itertools.pairwise(starts):
                yield links(held.iloc[a:b])
            held = held.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield links(held)

    return run


def tiled(placed: DataFrame, sets: DataFrame, most: int, tile: int) -> DataFrame:
    """(bucket, low, high, node, root, print, runs): every two tiles of the buckets that lie in several components.

    A tile holds about ``tile`` nodes and ``most`` shingles at most, a longer text alone.
    """
    open_ = placed.groupBy("bucket").agg(
        F.min("root").alias("least"), F.max("root").alias("last"), F.ceil(F.greatest(F.sum("n") / most, F.count(F.lit(1)) / tile)).alias("tiles"),
    ).where("least < last")
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    rest = placed.join(open_.select("bucket", "tiles"), "bucket").withColumn("own", own)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return rest.select(
        "bucket", F.least("own", "other").cast("long").alias("low"), F.greatest("own", "other").cast("long").alias("high"), "node", "root"
    ).join(sets, "node").select("bucket", "low", "high", "node", "root", "print", "runs")


def components(
    rows: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 30, most: int = 500_000, tile: int = 1024
) -> DataFrame:
    """(no_id, id, hash, root): the component of every row of ``keyed``; rows with the same shingles are one node.

    Two nodes are linked when the Jaccard similarity of their shingle sets is at least ``similarity``. Buckets are nodes that
    share a band. Every link is a pair of a bucket that a bit-sliced comparison of SimHash fingerprints finds within ``radius``
    bits and an exact comparison then confirms. Each bucket's nodes are first compared with its smallest node. Buckets that
    are not in one component after that are cut into tiles, and every two tiles meet in a task, which compares their pairs
    exactly where they are. Only links leave the task, at most one for each component in it. At 0.8, texts of four and five
    runs differ in the most bits, 12 on average: the default radius misses less than one in 10**7 of them.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts, 500_000):
                node, n, bands = signatures(texts[a:b], words)
                yield pd.DataFrame({**{k: batch[k].iloc[a:b].array for k in KEY}, "node": node, "n": n, "bands": bands})

    prints = pin(small_batches(rows).select(*KEY, "text").mapInPandas(measure, "no_id boolean, id long, hash long, node binary, n int, bands array<long>"), "near-prints")
    nodes = pin(prints.groupBy("node").agg(F.min(F.struct(*KEY)).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-nodes")
    laid = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    least = laid.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = pin(laid.join(least.select("bucket", "least"), "bucket"), "near-buckets")
    sets = pin(shingle_sets(shared.select("node").distinct(), nodes, rows, words), "near-sets")
    fits = F.least("n", "least.n") >= similarity * F.greatest("n", "least.n") - 1e-6
    star = shared.where(F.col("node") != F.col("least.node")).where(fits).select(F.col("node").alias("u"), F.col("least.node").alias("v")).distinct()
    links = pin(similar(close_star(star, sets, radius), sets, similarity), "near-links")
    placed = shared.select("bucket", "node", "n").join(connected(links), shared["node"] == F.col("u"), "left")
    placed = placed.select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    by = ["bucket", "low", "high"]
    dealt = small_batches(tiled(placed, sets, most, tile).repartition(*by).sortWithinPartitions(*by, "node"))
    more = pin(dealt.mapInPandas(tile_links(similarity, radius), "u binary, v binary"), "near-more")
    roots = connected(links.union(more))
    named = prints.select(*KEY, "node").join(roots, prints["node"] == roots["u"], "left")
    return named.select(*KEY, F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` with one row of every component: the smallest doc_id, a row without one only if no row of the group has any.

    Null and empty texts count as copies of each other; texts of fewer than ``words`` words are one shingle. Rows that
    share a doc_id are told apart by a hash of the row, equal rows are one. An empty table gives no rows; extra
    columns are kept.
    """
    rows = keyed(docs)
    firsts = components(rows, similarity, words).groupBy("root").agg(F.min(F.struct(*KEY)).alias("first")).select("first.*")
    return rows.select("row", *KEY).join(firsts, list(KEY), "left_semi").dropDuplicates(list(KEY)).select("row.*")
