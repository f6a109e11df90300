"""Packing token ids into windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import small_batches
from shelfcast.llm.tokens import encoder, slices
from shelfcast.session import pin

#: Ids handed on at a time.
FRAME_BYTES = 1 << 20
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "row long, start long, sequence_id long, offset long"


class TightestWindow:
    """A segment tree over remaining capacity: finds the open window with the least room that still fits.

    ``count[node]`` is the number of open windows in a node's range of capacities.
    """

    def __init__(self, width: int):
        self.size = 1
        while self.size <= width:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, by: int) -> None:
        node, count = room + self.size, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for ``need``, removed from the tree; None if there is none."""
        node, count = need + self.size, self.count
        if not count[node]:
            # Up to the first ancestor with open windows to the right of the path, then down to its smallest capacity.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece (all at most ``width`` long), taken longest first."""
    tree, window, offset, opened = TightestWindow(width), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found = width, opened
            opened += 1
        room, at = found
        window[i], offset[i] = at, width - room
        if room > need:
            tree.put(room - need, at)
    return window, offset


def pieces(docs: DataFrame, vocabulary: str, width: int, end_id: int, with_ids: bool) -> DataFrame:
    """Every document's ids plus ``end_id``, cut into full windows and one rest."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, ids, texts = batch["row"].tolist(), batch["doc_id"].tolist(), batch["text"].fillna("").tolist()
            out, held = [], 0

            def frame(out: list[tuple]) -> pd.DataFrame:
                made = pd.DataFrame(out, columns=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                made["doc_id"] = made["doc_id"].astype("Int64")
                return made

            for a, b in slices(texts):
                for row, doc, data in zip(rows[a:b], ids[a:b], enc.encode(texts[a:b]), strict=True):
                    data += end
                    total = len(data) // 4
                    for start in range(0, total, width):
                        part = data[4 * start : 4 * (start + width)]
                        out.append((row, doc, start, len(part) // 4, zlib.crc32(part), total, part if with_ids else None))
                        held += len(part) if with_ids else 100
                        if held > FRAME_BYTES:
                            yield frame(out)
                            out, held = [], 0
            if out:
                yield frame(out)

    source = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInPandas(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, width: int = 2048, end_id: int = 1, shard_docs: int = 4096, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its ids and ``end_id``; documents longer than ``width`` are first cut into full windows and a rest. A full
    window is a sequence of its own. Rests are dealt by a hash of row number and start into shards of about ``shard_docs``,
    whatever their ids or sources, and each shard packs its rests best-fit decreasing: longest first, each into the open
    window with the least room that fits, found in a segment tree over capacities. A shard's padding is at most a few
    windows, so a bounded shard costs next to nothing against packing all at once. A shard sees lengths only, which its
    places are joined back to by row number and start. ``sequence_id`` is unique over shards and full windows.

    A null text is empty: its document is ``end_id`` alone. A null doc_id stays null. Repeated rows are packed each. An
    empty table gives no rows. Extra columns are not read. ``ids`` are little-endian 32-bit, null unless ``with_ids``.
    """
    cut = pin(pieces(docs, vocabulary, width, end_id, with_ids), "pieces")
    rests = cut.where(F.col("length") < width)
    shards = max(1, -(-rests.count() // shard_docs))

    def place(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        window, offset = best_fit_decreasing(part["length"].to_numpy(), width)
        part["sequence_id"], part["offset"] = (int(key[0]) << 32) + window, offset
        return part[["row", "start", "sequence_id", "offset"]]

    shard = F.pmod(F.xxhash64("row", "start"), F.lit(shards)).alias("shard")
    places = rests.select(shard, "row", "start", "length").groupBy("shard").applyInPandas(place, PLACED)
    placed = rests.join(places, ["row", "start"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    # Numbers of full windows lie above those of all shards; the stored table fixes them.
    own = (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id")
    full = cut.where(F.col("length") == width).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", own, F.lit(0).cast("long").alias("offset"), "ids")
    return full.unionByName(placed)
