"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import small_batches
from shelfcast.llm.tokens import slices

#: Words kept per Python worker, and the longest word kept.
CACHE_WORDS, CACHE_BYTES = 200_000, 48
#: Tokens of whole documents that the fit holds marginals of at a time.
PART = 100_000
_EDGE = b".,;:!?\"'()[]{}<>*#%&$|"


def word_key(word: bytes) -> bytes:
    """A word in lower case without marks around it."""
    return word.strip(_EDGE).decode("utf-8", "ignore").lower().encode()


def features(word: bytes) -> list[str]:
    """Features of a word: itself, its beginnings of 3 to 6 letters, its ending, and one that all words have."""
    key = word_key(word).decode()
    return [f"w{key}", *(f"{n}{key[:n]}" for n in (3, 4, 5, 6) if len(key) >= n), f"s{key[-3:]}", "all"]


def signals(word: bytes) -> list[str]:
    """Readable features from which token labels are drawn: the word, and beginnings of 4 to 6 letters."""
    key = word_key(word).decode()
    return [f"w{key}", *(f"p{key[:n]}" for n in (4, 5, 6) if len(key) > n)] if key else []


def chain_products(step: np.ndarray) -> np.ndarray:
    """Normalised row vectors v_t = v_(t-1) M_t along a chain that starts from (1, 1).

    ``step`` is (4, n): the entries 00, 01, 10, 11 of each M_t. Where both rows of M_t are the same, v_t does not depend
    on what came before, so many documents make one chain. Products inside blocks run side by side, then block ends
    are chained: n steps take about the square root of n array operations. Returns (2, n).
    """
    n = step.shape[1]
    block = max(1, int(math.sqrt(n)))
    count = -(-n // block)
    m = np.zeros((4, count * block))
    m[:, :n] = step
    m[0, n:] = m[3, n:] = 1.0
    m = np.ascontiguousarray(m.reshape(4, count, block).transpose(2, 0, 1))
    run = np.zeros((4, count))
    run[0] = run[3] = 1.0
    inside = np.empty_like(m)
    for k in range(block):
        x, new = m[k], inside[k]
        new[0], new[1] = run[0] * x[0] + run[1] * x[2], run[0] * x[1] + run[1] * x[3]
        new[2], new[3] = run[2] * x[0] + run[3] * x[2], run[2] * x[1] + run[3] * x[3]
        new /= new[0] + new[1] + new[2] + new[3]
        run = new
    start, a, b = np.empty((2, count)), 0.5, 0.5
    for i, (p, q, r, s) in enumerate(inside[-1].T.tolist()):
        start[0, i], start[1, i] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    out = np.stack([start[0] * inside[:, 0] + start[1] * inside[:, 2], start[0] * inside[:, 1] + start[1] * inside[:, 3]])
    out /= out[0] + out[1]
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def potentials(emission: np.ndarray) -> np.ndarray:
    """(2, n) weights of labels 0 and 1 of every token, the larger one being 1."""
    e = np.clip(emission, -30, 30)
    return np.stack([np.exp(np.minimum(-e, 0)), np.exp(np.minimum(e, 0))])


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages (2, n) and the marginal of label 1 for every token.

    ``emission`` are log odds of label 1, ``first`` marks the first token of each document, ``trans`` (2, 2) are log
    potentials and ``begin`` the log odds of starting with label 1.
    """
    w, t = potentials(emission), np.exp(trans)
    forward = np.stack([t[0, 0] * w[0], t[0, 1] * w[1], t[1, 0] * w[0], t[1, 1] * w[1]])
    opening = np.stack([w[0, first], math.exp(begin) * w[1, first]])
    forward[:, first] = np.concatenate([opening, opening])
    alpha = chain_products(forward)
    # Backward, in reverse: beta_t = T (weight * beta)_(t+1), and ones at the last token of a document.
    back = np.ones((4, len(emission)))
    back[:, :-1] = np.stack([t[0, 0] * w[0, 1:], t[1, 0] * w[0, 1:], t[0, 1] * w[1, 1:], t[1, 1] * w[1, 1:]])
    back[:, np.append(first[1:], True)] = 1.0
    beta = chain_products(back[:, ::-1])[:, ::-1]
    both = alpha * beta
    return alpha, beta, both[1] / (both[0] + both[1])


@dataclass
class Tagger:
    """Weights of the chain, and of the logistic map from a document's marginals to its score."""

    weights: dict[str, float]
    trans: np.ndarray
    begin: float
    scale: np.ndarray
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, weight, found = self.known, self.weights.get, {}
        for x in set(words):
            e = known.get(x)
            if e is None:
                e = sum(weight(f, 0.0) for f in features(x))
                if len(x) <= CACHE_BYTES:
                    known[x] = e
            found[x] = e
        return np.fromiter(map(found.__getitem__, words), float, len(words))

    def tag(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Marginals of every token of every document."""
        counts = np.array([len(d) for d in docs], dtype=np.int64)
        if not counts.sum():
            return [np.empty(0) for _ in docs]
        first = np.zeros(int(counts.sum()), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        p = marginals(self.emissions([w for d in docs for w in d]), first, self.trans, self.begin)[2]
        return np.split(p, np.cumsum(counts)[:-1])

    def summary(self, p: np.ndarray) -> tuple[float, float]:
        """What a document's score sees: log odds of its most toxic token, and the log of expected toxic tokens."""
        top = float(np.clip(p.max(), 1e-3, 1 - 1e-3)) if len(p) else 1e-3
        return math.log(top / (1 - top)), math.log1p(float(p[p > 0.05].sum()) if len(p) else 0.0)

    def score(self, p: np.ndarray) -> float:
        a, b = self.summary(p)
        return 1 / (1 + math.exp(-float(np.clip(self.scale @ [1.0, a, b], -50, 50))))


def token_labels(docs: list[list[bytes]], toxic: np.ndarray, least: int = 4, share: float = 0.01, ratio: float = 30.0) -> list[np.ndarray | None]:
    """Token labels from document labels: in a toxic document, tokens with a signal that toxic documents own.

    A signal counts if toxic documents have it between enough different neighbours (so that copies of a passage count
    once): ``least`` documents and pairs of neighbours and a ``share`` of the number of toxic documents, at a rate ``ratio`` times that
    of the others' documents. A toxic document without such a token is left out (None), since where it is toxic isn't
    known.
    """
    n_in, n_out = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    bad, clean = [d for d, x in zip(docs, toxic, strict=True) if x], [d for d, x in zip(docs, toxic, strict=True) if not x]
    inside = Counter()
    for d in bad:
        inside.update({s for w in set(d) for s in signals(w)})
    strong = {s for s, n in inside.items() if n >= max(least, share * n_in)}
    outside = Counter()
    for d in clean:
        outside.update({s for w in set(d) for s in signals(w) if s in strong})
    need = {s: max(least, share * n_in, ratio * n_in * (outside[s] + 0.5) / n_out) for s in strong}
    strong = {s for s in strong if inside[s] >= need[s]}
    places = {s: set() for s in strong}
    for d in bad:
        for before, w, after in zip([b"", *d], d, [*d[1:], b""], strict=False):
            for s in signals(w):
                if s in strong:
                    places[s].add(hash((before, after)))
    strong = {s for s in strong if len(places[s]) >= need[s]}
    out = []
    for d, x in zip(docs, toxic, strict=True):
        y = np.array([any(s in strong for s in signals(w)) for w in d], dtype=float) if x else np.zeros(len(d))
        out.append(None if x and not y.any() else y)
    return out


def fit(texts: list[str], toxic: list[int], rounds: int = 25, rate: float = 0.5, l2: float = 1e-6, clean: int = 1000) -> Tagger:
    """Fit the chain by adaptive gradient steps on its log-likelihood, then the document score by logistic regression.

    All texts decide which tokens count as toxic and how scores are scaled; the chain itself is fitted on the toxic ones
    and the first ``clean`` others.
    """
    docs, flags = [t.encode("utf-8", "replace").split() for t in texts], np.array(toxic, dtype=bool)
    tagger = Tagger({"all": -8.0}, np.zeros((2, 2)), -3.0, np.array([-3.0, 1.0, 0.0]))
    labels = token_labels(docs, flags)
    spare = np.cumsum(~flags) > clean
    used = [(d, y) for d, y, f, skip in zip(docs, labels, flags, spare, strict=True) if y is not None and len(d) and (f or not skip)]
    if not flags.any() or not any(y.any() for _, y in used):
        return tagger
    words = [w for d, _ in used for w in d]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    token = np.fromiter((names[w] for w in words), np.int64, len(words))
    number: dict[str, int] = {}
    word_of, feature = array("l"), array("l")
    for i, word in enumerate(names):
        for f in features(word):
            word_of.append(i)
            feature.append(number.setdefault(f, len(number)))
    word_of, feature = np.frombuffer(word_of, np.int64), np.frombuffer(feature, np.int64)
    # Features of fewer than three tokens say nothing.
    often = np.bincount(feature, weights=np.bincount(token, minlength=len(names))[word_of], minlength=len(number)) >= 3
    order = np.cumsum(often) - 1
    keep = often[feature]
    word_of, feature, size = word_of[keep], order[feature[keep]], int(often.sum())
    number = {f: int(order[i]) for f, i in number.items() if often[i]}
    word_count = len(names)
    del words, names
    y = np.concatenate([y for _, y in used])
    counts = np.array([len(d) for d, _ in used])
    first = np.zeros(len(y), bool)
    first[np.cumsum(counts) - counts] = True
    inner = np.flatnonzero(~first)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    del inner
    trans, begin, w = np.zeros((2, 2)), -3.0, np.zeros(size)
    w[number["all"]] = math.log((y.sum() + 1) / (len(y) + 1))
    seen_w, seen_t, seen_b = np.full(size, 1e-8), np.full((2, 2), 1e-8), 1e-8
    # Chains are independent, so whole documents go through in parts and only sums stay.
    ends = np.cumsum(counts)
    borders = [0, *ends[np.flatnonzero(np.diff(ends // PART))].tolist(), len(y)]
    for _ in range(rounds):
        score = np.bincount(word_of, weights=w[feature], minlength=word_count)
        grad_word, joint, grad_b = np.zeros(word_count), np.zeros((2, 2)), 0.0
        for low, high in zip(borders, borders[1:], strict=False):
            if low == high:
                continue
            emission, start = score[token[low:high]], first[low:high]
            alpha, beta, p = marginals(emission, start, trans, begin)
            grad_word += np.bincount(token[low:high], weights=y[low:high] - p, minlength=word_count)
            inner = np.flatnonzero(~start)
            after = potentials(emission[inner]) * beta[:, inner]
            both = alpha[:, None, inner - 1] * np.exp(trans)[:, :, None] * after[None]
            joint += (both / both.sum(axis=(0, 1))).sum(axis=2)
            grad_b += float((y[low:high][start] - p[start]).sum())
        grad = np.bincount(feature, weights=grad_word[word_of], minlength=size) - l2 * len(y) * w
        grad_t = pairs - joint
        seen_w, seen_t, seen_b = seen_w + grad**2, seen_t + grad_t**2, seen_b + grad_b**2
        w = w + rate * grad / np.sqrt(seen_w)
        trans = trans + rate * grad_t / np.sqrt(seen_t)
        begin += rate * grad_b / math.sqrt(seen_b)
    tagger.weights = {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}
    tagger.trans, tagger.begin = trans, begin
    x = np.array([[1.0, *tagger.summary(p)] for i in range(0, len(docs), 200) for p in tagger.tag(docs[i : i + 200])])
    tagger.scale, tagger.known = logistic(x, flags), {}
    return tagger


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression whose columns after the first may only count in favour of 1."""
    held = list(range(x.shape[1]))
    while True:
        z, w = x[:, held], np.zeros(len(held))
        penalty = ridge * len(x) * np.array([1e-3] + [1.0] * (len(held) - 1))
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (q * (1 - q) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - q) - penalty * w)
            w = w + np.clip(step, -2, 2)
        if len(held) == 1 or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[held] = w
            return out
        held.pop(1 + int(w[1:].argmin()))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, longest: int) -> DataFrame:
    """(text, toxic): at most ``most`` toxic and twice as many other rows outside fold 0, in order of a hash of the id.

    Only labelled rows with a text in ``docs`` are drawn. Texts of more than ``longest`` characters come after all
    others. The characters of a kind are bounded by ``longest`` for each row it may have: whole texts are taken while
    they fit and the first that does not fit is cut there. The sampled ids, at most three times ``most``, are the side that is broadcast.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = docs.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n")).join(known.where(fold() != 0), "doc_id")
    usable = sizes.groupBy("doc_id").agg(F.min("n").alias("n"), F.first("toxic").alias("toxic"))
    order, picked = (F.col("n") > longest, F.xxhash64("doc_id"), "doc_id"), []
    for toxic, rows in ((1, most), (0, 2 * most)):
        left = rows * longest
        for r in usable.where(F.col("toxic") == toxic).orderBy(*order).limit(rows).collect():
            if left <= 0:
                break
            picked.append((r["doc_id"], toxic, min(r["n"], left)))
            left -= r["n"]
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("toxic", T.IntegerType()), T.StructField("take", T.IntegerType())])
    sample = docs.sparkSession.createDataFrame(picked, kind)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    first = F.min(F.struct(F.length("text").alias("n"), F.expr("substring(text, 1, take)").alias("text"), "toxic")).alias("x")
    return found.groupBy("doc_id").agg(first).orderBy("doc_id").limit(3 * most).select("x.text", "x.toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = 1000, longest: int = 6000) -> Tagger:
    """A tagger fitted on the bounded sample of ``training_rows``; rows of fold 0 are never used."""
    rows = training_rows(docs, labels, most, longest).collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def offsets(text: str, p: np.ndarray, threshold: float) -> str:
    """Code point spans of runs of toxic tokens: start:end, comma-joined."""
    spans = []
    for m, q in zip(re.finditer(r"[^\x20\x09-\x0D]+", text), p, strict=True):
        if q >= threshold:
            if spans and text[spans[-1][1] : m.start()].strip(" ") == "":
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
    return ",".join(f"{a}:{b}" for a, b in spans)


def scorer(tagger: Tagger, threshold: float = 0.5):
    """A column function: text to (score, spans)."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.StringType())])

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.DataFrame:
        texts, out = column.fillna("").tolist(), []
        for a, b in slices(texts, 500_000):
            docs = [t.encode("utf-8", "replace").split() for t in texts[a:b]]
            for text, p in zip(texts[a:b], tagger.tag(docs), strict=True):
                out.append((tagger.score(p), offsets(text, p, threshold) if len(p) and p.max() >= threshold else ""))
        return pd.DataFrame(out, columns=["score", "spans"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, most: int = 1000, longest: int = 6000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.

    The chain tags words as toxic or not from features of the word; its transitions carry context. Token labels
    are drawn from document labels of the training folds. A document's score is a logistic function of its tokens'
    forward-backward marginals, its spans are the runs of tokens at 0.5 or more.

    Null and empty texts get the score of a document without toxic tokens. A null id is held out with an empty id.
    Without any toxic training row all scores are low. Duplicate labels of an id count as toxic if any does. Repeated
    rows score alike, an empty table gives no rows, other columns are not read, long texts are scored whole.
    """
    tagger = train(small_batches(docs), labels, most, longest)
    held = fold() == 0
    out = docs.select("doc_id", held.alias("held_out"), scorer(tagger)("text").alias("tox"))
    return out.select("doc_id", "held_out", F.col("tox.score").alias("score"), F.when(F.col("tox.score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("tox.spans").alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = 1000, longest: int = 6000) -> DataFrame:
    """``docs`` without the rows that ``score_documents`` predicts to be toxic."""
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scorer(train(small_batches(docs), labels, most, longest))("text").alias("tox"))
    return scored.where(F.col("tox.score") < 0.5).select("row.*")
