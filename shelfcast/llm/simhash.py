"""SimHash near-dedup: fingerprints, bit-sliced comparison inside blocks, and components of close fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.components import connected
from shelfcast.llm.tokens import slices
from shelfcast.session import pin

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words of the A-Z lower-cased text, repeats included."""
    import xxhash

    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(r, 42) for r in runs], dtype=np.uint64)


def fingerprint(texts: list[str], words: int = 4) -> np.ndarray:
    """One 64-bit fingerprint per text: a bit is set if it is set in over half the shingle hashes; 0 without words."""
    hashes = [shingle_hashes(t, words) for t in texts]
    counts = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * votes > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed 64-bit number."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].fillna("").tolist(), batch["doc_id"].astype("Int64")
            for a, b in slices(texts, 2_000_000):
                yield pd.DataFrame({"doc_id": ids.iloc[a:b].array, "print": fingerprint(texts[a:b], words).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(measure, "doc_id long, print long")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes of prints laid out in words of 64 lanes: (words, 64 lanes) to (64 planes, words)."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).reshape(len(prints), 64).T)


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``; counters are bit-sliced, lowest bit first."""
    more, equal = over.copy(), np.full_like(over, ONES)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def close_lanes(prints: np.ndarray, planes: np.ndarray, word: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every job (one print against one word of 64 lanes): the lanes of ``mask`` within ``radius`` bits.

    Planes enter three at a time through a carry-save adder into bit-sliced counters, so one operation moves 64
    distances. After every six planes each job whose lanes are all beyond the radius is abandoned.
    Returns the surviving jobs' numbers and lane masks.
    """
    jobs = np.arange(len(prints))
    depth = max(2, int(radius).bit_length())
    counters = [np.zeros(len(prints), np.uint64) for _ in range(depth)]
    over = np.zeros(len(prints), np.uint64)
    one = np.uint64(1)
    for k in range(0, 64, 3):
        x = [planes[i][word] ^ (np.uint64(0) - ((prints >> np.uint64(i)) & one)) for i in range(k, min(k + 3, 64))]
        while len(x) < 3:
            x.append(np.zeros(len(prints), np.uint64))
        half = x[0] ^ x[1]
        single, double = half ^ x[2], (x[0] & x[1]) | (half & x[2])
        carry = counters[0] & single
        counters[0] ^= single
        half = counters[1] ^ carry
        carry, counters[1] = (counters[1] & carry) | (half & double), half ^ double
        for c in counters[2:]:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if k % 6 == 3 or k + 3 >= 64:
            near = ~beyond(counters, over, radius) & mask
            alive = np.flatnonzero(near)
            if len(alive) < len(jobs) or k + 3 >= 64:
                jobs, prints, word, mask, over = jobs[alive], prints[alive], word[alive], mask[alive], over[alive]
                counters = [c[alive] for c in counters]
                near = near[alive]
                if not len(jobs):
                    break
    return (jobs, near) if len(jobs) else (jobs, np.empty(0, np.uint64))


def lanes_of(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive groups of prints laid out in words of 64 lanes, a group from a word of its own on.

    Returns the lane of each print, the row number in each lane (-1: none), and masks of used lanes and bit planes by word.
    """
    words = -(-sizes // 64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane_at = (np.cumsum(words) - words)[group] * 64 + np.arange(len(prints)) - (np.cumsum(sizes) - sizes)[group]
    laid = np.zeros(int(words.sum()) * 64, np.uint64)
    laid[lane_at] = prints
    row_of = np.full(len(laid), -1, np.int64)
    row_of[lane_at] = np.arange(len(prints))
    valid = np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    return lane_at, row_of, valid, planes_of(laid.reshape(-1, 64))


def close_to(centres: np.ndarray, prints: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Row numbers of the prints close to the centre of their group; groups are consecutive and have the given sizes."""
    _, row_of, valid, planes = lanes_of(prints, sizes)
    jobs, near = close_lanes(np.repeat(centres, -(-sizes // 64)), planes, np.arange(len(valid)), valid, radius)
    if not len(jobs):
        return jobs
    hit, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row_of[jobs[hit] * 64 + bit]


def close_pairs(prints: np.ndarray, sizes: np.ndarray, radius: int, most_jobs: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i < j) of close prints within consecutive groups of the given sizes."""
    words = -(-sizes // 64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane_at, row_of, valid, planes = lanes_of(prints, sizes)
    own_word, lane = lane_at // 64, (lane_at % 64).astype(np.uint64)
    # A row meets its own word, from the next lane on, and the later words of its group.
    reach = np.cumsum(words)[group] - own_word
    ends = np.cumsum(reach)
    done = 0
    while done < len(prints):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most_jobs, side="right")))
        rows = np.repeat(np.arange(done, upto), reach[done:upto])
        word = own_word[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(reach[done:upto]) - reach[done:upto], reach[done:upto])
        later = np.where(lane[rows] == 63, np.uint64(0), ONES << (lane[rows] + np.uint64(1)) % np.uint64(64))
        mask = valid[word] & np.where(word == own_word[rows], later, ONES)
        some = np.flatnonzero(mask)
        jobs, near = close_lanes(prints[rows[some]], planes, word[some], mask[some], radius)
        if len(jobs):
            hit, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            picked = some[jobs[hit]]
            yield rows[picked], row_of[word[picked] * 64 + bit]
        done = upto


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row number of each row's component, by pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def block_links(radius: int):
    """Partition function: rows sorted by block in, links (u > v) to the first print of each close cluster out."""

    def links(block: pd.DataFrame) -> pd.DataFrame:
        prints = block["print"].to_numpy()
        new = (block[["combo", "key", "low", "high"]].to_numpy()[1:] != block[["combo", "key", "low", "high"]].to_numpy()[:-1]).any(axis=1)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        sizes = np.diff(np.concatenate([starts, [len(prints)]]))
        found = list(close_pairs(prints.view(np.uint64), sizes, radius))
        if not found:
            return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        label = forest(len(prints), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        moved = np.flatnonzero(label != np.arange(len(prints)))
        a, b = prints[moved], prints[label[moved]]
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = held[["combo", "key", "low", "high"]]
            # Rows of the last block wait for the next batch.
            open_from = int((keys == keys.iloc[-1]).all(axis=1).to_numpy().argmax()) if len(held) else 0
            if open_from:
                yield links(held.iloc[:open_from].reset_index(drop=True))
                held = held.iloc[open_from:].reset_index(drop=True)
        if held is not None and len(held):
            yield links(held)

    return run


def print_links(distinct: DataFrame, radius: int = 4, bands: int = 6, tile: int = 2048) -> DataFrame:
    """(u, v): links that connect exactly the prints (column ``print``, distinct) within ``radius`` bits of each other.

    64 bits are cut into ``bands``; two prints that differ in ``radius`` bits agree on at least ``bands - radius`` whole
    bands, so blocks of equal bits in every choice of that many bands miss no pair. More bands make smaller
    blocks and more copies of a print: 6 bands give 15 blocks on 21 bits, 8 bands 70 blocks on 32 bits. A block larger than
    ``tile`` is cut into tiles by hash and every two tiles meet in a task of their own, so no task holds a large
    block. Inside a task, comparison is bit-sliced. Links within a block are reduced to one per print.
    """
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    band = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    masks = [sum(band[i] for i in c) for c in itertools.combinations(range(bands), bands - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    keyed = distinct.select("print", F.explode(keys).alias("k")).select("k.combo", "k.key", "print")
    counts = keyed.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile)
    own = F.pmod(F.xxhash64("print"), tiles)
    shared = keyed.join(counts, ["combo", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    dealt = shared.select(
        "combo", "key", F.least("own", "other").cast("int").alias("low"), F.greatest("own", "other").cast("int").alias("high"), "print"
    )
    by = ["combo", "key", "low", "high"]
    return dealt.repartition(*by).sortWithinPartitions(*by, "print").mapInPandas(block_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, bands: int = 6, words: int = 4) -> DataFrame:
    """One row per document: (doc_id, print, component_id).

    Documents are linked when their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id
    of the connected component. Copies share a fingerprint and count as one node. Null and empty texts have fingerprint
    0 and are linked like any other. A null doc_id keeps its row and takes part in linking, but is a component_id
    only where the component has no other. Repeated rows stay. An empty table gives no rows; extra columns are not read.
    """
    prints = pin(fingerprints(docs, words), "prints")
    nodes = pin(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "print-nodes")
    roots = connected(print_links(nodes.select("print"), radius, bands))
    rooted = nodes.join(roots, nodes["print"] == roots["u"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, bands: int = 6, words: int = 4) -> DataFrame:
    """``docs`` with one row of every component, the smallest doc_id; rows without a doc_id stay."""
    firsts = near_duplicates(docs, radius, bands, words).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
