"""Token ids of whole texts, and the exact length histogram that answers every context limit."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.common import small_batches
from shelfcast.session import pin

#: Bytes of words and ids kept per Python worker, as Python holds them, and the longest word kept.
CACHE_BYTES, LONGEST = 64 << 20, 48
_ENTRY = 200
_MARKS = re.compile(rb"[.,;:!?](?<=[a-z0-9].)")
#: Words of Latin-1 letters, digits and marks that no rule of the vocabulary treats alone, and their pieces in lower case.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@[-`{-~]+")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts under a vocabulary that drops white space, as the tokenizer itself gives them.

    Pieces never cross white space, nor the border between a letter or digit and a mark, so a text's ids are those of
    its words in turn; each word is encoded once per worker and then looked up. Upper case is folded first because the
    vocabulary does the same, except where a text may spell a special token. Latin words are cut into pieces here, which the
    vocabulary's merges then turn into ids; its own normalizer and splitter, which take most of the time, see the rest.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.tokenizer.model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        single, cut, rest = [], {}, []
        for w in words:
            if w.isalpha() and w.islower():
                single.append(w)
            elif _LATIN.fullmatch(text := w.decode()):
                cut[w] = [p.encode() for p in _PIECES.findall(text.lower())]
            else:
                rest.append(w)
        pieces = set().union(*cut.values())
        ids = {p: self.known.get(p) or self.older[p] for p in pieces if p in self.known or p in self.older}
        ids |= self.merged(single + list(pieces.difference(ids, single)))
        out = self.whole(rest)
        out.update((w, ids[w]) for w in single)
        out.update((w, b"".join([ids[p] for p in cut[w]])) for w in cut)
        return out

    def merged(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces by the vocabulary's merges; its last id shows where a piece ends."""
        out = {}
        for a, b in slices(pieces, 20_000):
            joined = b" ".join(pieces[a:b]).decode()
            ids = np.asarray(self.merger.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
            buf = ids.tobytes()
            out.update(zip(pieces[a:b], [buf[i:j] for i, j in itertools.pairwise(cuts)], strict=True))
        return out

    def whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words by the tokenizer with all its steps."""
        if not words:
            return {}
        enc = self.tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        buf = np.asarray(enc.ids, dtype="<u4").tobytes()
        cuts = (np.searchsorted(np.asarray(enc.word_ids, dtype=np.int64), np.arange(len(words) + 1)) * 4).tolist()
        return {w: buf[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = []
        for text in texts:
            raw = text.encode("utf-8", "replace")
            parts.append((raw if b"<|" in raw else _MARKS.sub(rb" \g<0>", raw.lower())).split())
        known, older = self.known, self.older
        new = set().union(*parts).difference(known)
        fresh = {w: older[w] for w in new if w in older}
        fresh |= self.learn(list(new.difference(fresh)))
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for w in [w for w in fresh if len(w) > LONGEST]:
            del known[w], fresh[w]
        self.held += _ENTRY * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if self.held > CACHE_BYTES // 2:
            # Words that are met again come back from the older half, the others go with it.
            self.known, self.older, self.held = {}, known, 0
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` characters together, or a single longer text."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def encoded_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(length) of every row's text in ids; null and empty texts have 0."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in slices(texts):
                yield pd.DataFrame({"length": [len(x) // 4 for x in enc.encode(texts[a:b])]}, dtype="int64")

    return small_batches(docs).select("text").mapInPandas(measure, "length long")


def length_histogram(docs: DataFrame, vocabulary: str, block: int = 1024) -> DataFrame:
    """One row per encoded length that occurs: counts, and sums from both ends that answer any context limit.

    Columns: length; n_docs and n_tokens at that length; docs_upto, tokens_upto (up to and with it); docs_over,
    tokens_over (beyond it); truncated, the total when every document is cut to ``length`` ids; docs, tokens of all.

    Lengths are counted before the shuffle, so the table has a row per distinct length whatever the corpus, and a length
    that a third of all documents share is one row. Suffix sums run per block of ``block`` lengths, then over the block
    totals, so no task sees more than a block or one row per block. Null and empty texts count as length 0; an empty
    table gives no rows; other columns are not read.
    """
    counts = pin(encoded_lengths(docs, vocabulary).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    counts = counts.withColumn("n_tokens", F.col("n_docs") * F.col("length")).withColumn("block", F.floor(F.col("length") / block))
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = counts.select("*", F.sum("n_docs").over(upto).alias("d_in"), F.sum("n_tokens").over(upto).alias("t_in"))
    whole = Window.partitionBy()
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = within.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).select(
        "block", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("d_before"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t_before"),
        F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("tokens"),
    )
    out = within.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", (F.col("d_in") + F.col("d_before")).alias("docs_upto"), (F.col("t_in") + F.col("t_before")).alias("tokens_upto"),
        "docs", "tokens",
    )
    over = out.withColumn("docs_over", F.col("docs") - F.col("docs_upto")).withColumn("tokens_over", F.col("tokens") - F.col("tokens_upto"))
    return over.withColumn("truncated", F.col("tokens_upto") + F.col("docs_over") * F.col("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row (total): ids left when every document is cut to ``limit`` ids; null for an empty histogram."""
    kept = F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs"))
    return histogram.agg(kept.alias("total"))


def quantile(histogram: DataFrame, p: float) -> DataFrame:
    """One row (length): the smallest length that at least a share ``p`` of documents does not exceed."""
    return histogram.where(F.col("docs_upto") >= F.lit(p) * F.col("docs")).agg(F.min("length").alias("length"))
