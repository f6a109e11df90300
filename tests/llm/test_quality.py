import re

import numpy as np

from shelfcast.llm import quality
from tests.llm.fixtures import awkward, frame, prose


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = set()
    for i, r in enumerate(runs):
        if runs.count(r) > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
        len(lines), sum(c.isalpha() for c in text), sum(c.isupper() for c in text), text.count("!"), len(set(w)),
    )


def junk(n):
    import random

    rng = random.Random(n)
    kind = n % 3
    text = prose(rng, 60)
    if kind == 0:
        return " ".join(x + "!!" for x in text.upper().split())
    if kind == 1:
        return " ".join(x + "###" for x in text.split())
    return "same words again and again here " * 20


def test_measures():
    texts = [t for _, t, _ in awkward() if len(t or "") < 5000] + [junk(i) for i in range(6)] + ["a b c d e f a b c d e", "x\nx\n\n \nx y", "a a a a a a a", "é#É b |<>"]
    for t in texts:
        assert quality.measures(t or "") == brute(t)


def test_verdicts(spark):
    rows = awkward() + [(1000 + i, junk(i), "j") for i in range(30)]
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        n = len((t or "").split())
        r = got[(i, n)]
        assert r["base_failed"] == (n < 10 or 100 * r["n_repeat_words"] > 20 * n) and not (r["base_failed"] and r["kept"])
        if i is not None and i >= 1000:
            assert not r["kept"]
        elif n >= 20 and not r["base_failed"] and i not in (204, 205):  # few stems for its length; hardly any letters
            assert r["kept"], (i, r)


def test_estimates_recover_planted_rules():
    rng = np.random.default_rng(0)
    good = rng.random(40000) < 0.8
    bad_rates, good_rates = [(0.4, 0.01), (0.3, 0.02), (0.3, 0.29)], [(0.05, 0.8), (0.1, 0.7)]
    fired = np.stack([rng.random(40000) < np.where(good, g, b) for b, g in bad_rates + good_rates], axis=1)
    seen, n = np.unique(fired, axis=0, return_counts=True)
    constant, votes, silent = quality.estimate(seen.astype(float), n.astype(float), np.array([True] * 3 + [False] * 2))
    odds = constant + fired @ votes + ~fired @ silent
    rates = np.array(bad_rates + good_rates)
    true = np.log(0.8 / 0.2) + fired @ np.log(rates[:, 1] / rates[:, 0]) + ~fired @ np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
    assert np.mean((odds >= 0) == good) > np.mean((true >= 0) == good) - 0.01 and abs(constant - np.log(4)) < 0.2
    assert votes[0] < votes[1] < votes[2] <= 0 and votes[2] > -0.7 and votes[3] > 1


def test_empty_table(spark):
    assert quality.judge(frame(spark, [])).count() == 0
