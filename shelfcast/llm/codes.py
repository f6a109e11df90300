"""Vector codes: every part of a vector becomes the number of its nearest codebook entry, found along a trie of parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import spread_join
from shelfcast.session import pin

#: Scaled components beyond this are held at it, so that squared distances of up to 64 components fit a long.
MOST = 1 << 27


def scaled(vectors: DataFrame, scale: int = 4096, parts: int = 8) -> DataFrame:
    """(vec_id, label, v): usable vectors as integers, floor(scale * x).

    A row is left out if its vector is null, empty, holds a null or non-finite component, or cannot be cut into
    ``parts`` equal parts. Components beyond MOST are held at it.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # floor of a double too large for a long is held by the bounds before the cast.
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double"), F.lit(-1e15)), F.lit(1e15)) * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    fits = (F.size(x) > 0) & (F.size(x) % parts == 0)
    kept = vectors.where(x.isNotNull()).where(fits & sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v"))


def nearest(leaves: np.ndarray, entries: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest entry (ties to the lower) for each part, in the order given.

    Parts are leaves of a trie whose levels are the dimensions. They are visited depth first, a block of leaves at a
    time: a node's vector of accumulated distances to all entries is its parent's plus one dimension, computed once for
    all leaves below it, and the vectors on the path to the last leaf carry over into the next block. Lexicographic
    order shares the most; any order gives the same result.
    """
    n, dims = leaves.shape
    code, far = np.empty(n, np.int64), np.empty(n, np.int64)
    path: list[np.ndarray] = []
    for a in range(0, n, block):
        part = leaves[a : a + block]
        split = np.zeros(len(part), np.int64)  # first dimension in which a leaf leaves the path of the one before it
        differs = part[1:] != part[:-1]
        split[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), dims)
        if a:
            other = np.flatnonzero(part[0] != leaves[a - 1])
            split[0] = other[0] if len(other) else dims
        above, carried = None, path
        path = []
        for j in range(dims):
            new = split <= j
            shared = not new[0]
            new[0] = True
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            gap = part[first, j, None] - entries[None, :, j]
            held = gap * gap
            if above is not None:
                held += above[1][above[0][first]]
            if shared:
                held[0] = carried[j]
            above = node, held
            path.append(held[node[-1]])
        leaf, held = above
        best = held.argmin(axis=1)
        code[a : a + block] = best[leaf]
        far[a : a + block] = held[np.arange(len(held)), best][leaf]
    return code, far


def distinct_parts(vectors: DataFrame, parts: int) -> DataFrame:
    """(part, leaf, n): the distinct parts with their counts, laid out in lexicographic slices."""
    size = (F.size("v") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("v", i * size + 1, size))
    counted = vectors.select(F.posexplode(cut).alias("part", "leaf")).groupBy("part", "leaf").agg(F.count(F.lit(1)).alias("n"))
    return pin(counted.repartitionByRange("part", "leaf").sortWithinPartitions("part", "leaf"), "parts")


def summed(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): weighted sums of the parts nearest to each entry, one row per batch that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            out = []
            number, leaves, n = batch["part"].to_numpy(), np.stack(batch["leaf"].to_list()).astype(np.int64), batch["n"].to_numpy()
            for p in np.unique(number):
                here = number == p
                code, _ = nearest(leaves[here], books[p])
                for e in np.unique(code):
                    mine = code == e
                    weight = n[here][mine]
                    out.append((p, e, weight.sum(), (leaves[here][mine] * weight[:, None]).sum(axis=0)))
            yield pd.DataFrame(out, columns=["part", "entry", "n", "sums"])

    return parts.mapInPandas(run, "part int, entry int, n long, sums array<long>")


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """Codebooks (part, entry, dimension) of ``scaled`` vectors of one length; None without vectors.

    They start as the parts of the ``entries`` smallest vec_ids (a null id last, equal ids by their vectors); each round
    gives every part to its nearest entry and moves an entry to the floor of its parts' mean; an entry without parts
    stays. Only the codebooks reach the driver. Copies are one leaf with a weight, so a vector that a third of all rows
    share costs one visit.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    size = len(first[0]["v"]) // parts
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    leaves = distinct_parts(vectors, parts)
    for _ in range(rounds):
        each = summed(leaves, books).select("part", "entry", "n", F.posexplode("sums").alias("dim", "x"))
        for r in each.groupBy("part", "entry", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["dim"]] = r["x"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and dimension, as decimals between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, codes array<int>, error long): numbers of the nearest entries of ``scaled`` vectors."""
    parts, _, size = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max(1, 4_000_000 // (parts * size))
        for batch in (whole.iloc[a : a + most] for whole in batches for a in range(0, len(whole), most)):
            v = np.stack(batch["v"].to_list()).astype(np.int64).reshape(len(batch), parts, size)
            codes, error = np.empty((len(batch), parts), np.int32), np.zeros(len(batch), np.int64)
            for p in range(parts):
                leaves, row = np.unique(v[:, p], axis=0, return_inverse=True)
                code, far = nearest(leaves, books[p])
                codes[:, p] = code[row.ravel()]
                error += far[row.ravel()]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "codes": list(codes), "error": error})

    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, codes array<int>, error long"
    return vectors.mapInPandas(run, schema)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector (column ``embedding``).

    code has two hex digits for each part; error is the squared distance to the chosen entries; label_error its sum over
    rows of the same label, null labels together. Rows that ``scaled`` leaves out have no result, and neither have
    vectors of another length than that of the smallest kept vec_id. A null vec_id keeps its row. Repeated rows are coded
    each. Fewer vectors than ``entries`` make fewer entries. An empty table gives no rows; other columns are not read.
    """
    usable = scaled(vectors, scale, parts)
    head = usable.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("width")).collect()
    width = head[0]["width"] if head else 0
    usable = usable.where(F.size("v") == width)
    books = fit(usable, parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)
    coded = pin(encode(usable, books), "codes")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = spread_join(coded, sums, ["label"])
    return out.select("vec_id", "label", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
