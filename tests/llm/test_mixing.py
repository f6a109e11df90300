from collections import Counter

from shelfcast.llm import mixing
from shelfcast.llm.common import text_of, word_count
from tests.llm.fixtures import awkward, frame


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Sharing by rounds, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(limit * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        out = {s: limit * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if out[s] > limit * sizes[s]}
        if not over:
            return out
        capped |= over


def test_plan(spark):
    rows = awkward()
    plan = mixing.mix_plan(frame(spark, rows), word_count(text_of())).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(plan) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken, largest = Counter(), Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    again = mixing.mix_plan(frame(spark, rows[::-1]), word_count(text_of())).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_rows_and_columns(spark):
    docs = frame(spark, awkward())
    out = mixing.mix(docs)
    assert out.schema.names == docs.schema.names
    plan = Counter()
    for r in mixing.mix_plan(docs, word_count(text_of())).select("doc_id", "copies").collect():
        plan[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({k: v for k, v in plan.items() if v})


def test_empty_and_wordless(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).count() == 0


def test_one_source_with_most_rows(spark):
    rows = [(i, "w " * (i % 9), "big" if i % 3 else f"s{i % 6}") for i in range(3000)]
    plan = mixing.mix_plan(frame(spark, rows), word_count(text_of())).groupBy("source").agg({"target": "max", "size": "sum"}).count()
    assert plan == 3
