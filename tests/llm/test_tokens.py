import random

import pytest
from tokenizers import Tokenizer

from shelfcast.llm import packing, tokens
from shelfcast.llm.common import small_batches
from shelfcast.llm.queries import vocabulary
from tests.llm.fixtures import awkward, frame

TRICKY = [
    "", " ", "a", "Don't STOP!!! it's I'LL", "x.y,z;:!? ...end.", "<|endoftext|> in <|startoftext|>, <|ENDOFTEXT|>", "ÀÉÎ ß İstanbul ΣΑΣ",
    "é combininǵ Å", "日本語 テスト 中文", "emoji 😀😀 ok", "tab\tnew\nline\x0b\x0c\r x", "nbsp here there\u0085", "\x1c\x1d odd",
    "12345 6.7.8 1st 2nd", "a.b.c. (x). [y], {z}!", "'s't're 've", "http://example.com/a?b=c&d=e#f", "a" * 500, "word" * 200 + ".", " sep　",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(vocabulary())


def test_encoder_equals_the_tokenizer(whole):
    rng = random.Random(5)
    alphabet = "abcXYZ019 .,;:!?'\"<|>()-_é ßÀ\n\t日😀́"
    texts = TRICKY + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + [t or "" for _, t, _ in awkward()]
    enc = tokens.WordEncoder(vocabulary())
    for text, data in zip(texts, enc.encode(texts), strict=True):
        assert [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)] == whole.encode(text, add_special_tokens=False).ids, text


def test_latin_words_need_merges_only(whole):
    rng = random.Random(6)
    letters, marks = "abcxyzABCXYZàéßöøÿÀÉÞ0189", "!\"#$%&()*+,-./:;=>?@[]^_`{|}~"
    words = sorted({"".join(rng.choices(letters + marks, k=rng.randint(1, 12))).encode() for _ in range(3000)})
    enc, others = tokens.WordEncoder(vocabulary()), []
    by_tokenizer = enc.whole
    enc.whole = lambda rest: others.extend(rest) or by_tokenizer(rest)
    odd = ["don't", "x<|endoftext|>", "日本", "ª", "e\u0301", "=\u0338", "µm", "a÷b"]
    got = enc.learn(words + [w.encode() for w in odd])
    assert sorted(others) == sorted(w.encode() for w in odd) and set(got) == set(words) | set(others)
    for w, ids in got.items():
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == whole.encode(w.decode(), add_special_tokens=False).ids, w


def test_histogram(spark, whole):
    rows = awkward() + [(500 + i, t, "a") for i, t in enumerate(TRICKY)]
    lengths = [len(whole.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    hist = tokens.length_histogram(frame(spark, rows), vocabulary(), block=16)
    got = hist.collect()
    assert sorted(r["length"] for r in got) == sorted(set(lengths))
    for r in got:
        n = r["length"]
        assert r["n_docs"] == lengths.count(n) and r["n_tokens"] == n * lengths.count(n)
        assert r["docs_upto"] == sum(x <= n for x in lengths) and r["tokens_upto"] == sum(x for x in lengths if x <= n)
        assert r["docs_over"] == sum(x > n for x in lengths) and r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["truncated"] == sum(min(x, n) for x in lengths) and (r["docs"], r["tokens"]) == (len(lengths), sum(lengths))
    for limit in (0, 1, 17, 40, 2048, 10**6):
        assert tokens.truncated_total(hist, limit).first()["total"] == sum(min(x, limit) for x in lengths)
    for p in (0.1, 0.5, 0.9, 1.0):
        want = min(x for x in lengths if sum(y <= x for y in lengths) >= p * len(lengths))
        assert tokens.quantile(hist, p).first()["length"] == want


def test_empty_histogram(spark):
    hist = tokens.length_histogram(frame(spark, []), vocabulary())
    assert hist.count() == 0 and tokens.truncated_total(hist, 10).first()["total"] is None and tokens.quantile(hist, 0.5).first()["length"] is None


def test_best_fit_decreasing_equals_a_plain_search():
    import numpy as np

    rng = random.Random(7)
    for width in (1, 7, 64, 100):
        lengths = np.array([rng.randint(1, width) for _ in range(400)])
        room, want = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[i]]
            best = min(fits) if fits else width
            if fits:
                room.remove(best)
            want[i] = best
            if best > lengths[i]:
                room.append(best - int(lengths[i]))
        window, offset = packing.best_fit_decreasing(lengths, width)
        assert all(width - offset[i] == want[i] for i in range(len(lengths)))
        for w in set(window):
            parts = sorted((offset[i], lengths[i]) for i in np.flatnonzero(window == w))
            assert sum(n for _, n in parts) <= width and all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts))


def test_packing_round_trip(spark, whole):
    import zlib
    from collections import Counter, defaultdict

    rows = awkward()
    got = packing.pack(frame(spark, rows), vocabulary(), width=64, shard_docs=30).collect()
    windows, texts = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"]].append(r)
    for parts in windows.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 64
    want = defaultdict(Counter)
    for i, t, _ in rows:
        want[i][tuple(whole.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    for i, docs in want.items():
        if len(docs) == 1 and sum(docs.values()) == 1:
            pieces = sorted(texts[i], key=lambda r: r["start"])
            data = b"".join(r["ids"] for r in pieces)
            assert tuple(int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)) in docs
            assert all(r["doc_tokens"] == len(data) // 4 for r in pieces)
    assert sum(r["length"] for r in got) == sum(len(d) * n for docs in want.values() for d, n in docs.items())
    plain = packing.pack(frame(spark, rows), vocabulary(), width=64, shard_docs=30, with_ids=False)
    assert plain.where("ids is not null").count() == 0 and plain.count() == len(got)
    assert packing.pack(frame(spark, []), vocabulary()).count() == 0


def test_batches_for_python_are_bounded_in_bytes(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]

    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=batch["text"].str.len().sum()).loc[:0, ["n"]]

    try:
        spark.conf.unset(names[0])
        spark.conf.set(names[1], "64m")
        rows = spark.range(400, numPartitions=1).selectExpr("repeat('x', 50000) as text")
        got = [r["n"] for r in small_batches(rows).mapInPandas(sizes, "n long").collect()]
        assert sum(got) == 400 * 50000 and max(got) <= (1 << 20) + 50000
        spark.conf.set(names[1], "64k")
        small_batches(rows)
        assert spark.conf.get(names[1]) == "64k"
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_shards_are_packed_without_their_ids(spark):
    made = packing.pack(frame(spark, awkward()), vocabulary(), width=64, shard_docs=30)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    (grouped,) = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert "sequence_id" in grouped and "ids#" not in grouped.replace("ids_crc32#", "")
    keys = [(r["doc_id"], r["sequence_id"], r["offset"]) for r in made.collect()]
    assert len({k[1:] for k in keys}) == len(keys)
