import hashlib
import random
import re
import zlib

import pytest

from shelfcast.llm import repair as rp

SHAPE = re.compile(r"(s?(ua)+)?\Z")
WORD = re.compile(r"[^\x20\x09-\x0d]")


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        chars = WORD.findall(text)
        out.append("b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def brute(initials, faults):
    """Cheapest (cost, audit) by relaxing whole strings over (row, state) until nothing changes."""
    best = {(0, ""): (0, "")}
    queue = [(0, "")]
    while queue:
        row, tail = queue.pop()
        cost, audit = best[(row, tail)]
        steps = []
        if row < len(initials):
            steps.append((row + 1, None, 4, "D"))
            if faults[row] not in "bd":
                stay = 3 if faults[row] == "t" else 0
                steps += [(row + 1, initials[row], stay, "K"), (row + 1, "u", stay + 3, "R"), (row + 1, "a", stay + 3, "R")]
        steps += [(row, "u", 3, "I"), (row, "a", 3, "I")]
        for to, emit, extra, edit in steps:
            if emit is not None and (tail, emit) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                continue
            node, value = (to, tail if emit is None else emit), (cost + extra, audit + edit)
            if value[0] <= 7 * len(initials) + 9 and (node not in best or value < best[node]):
                best[node] = value
                queue.append(node)
    return min(best[n] for n in ((len(initials), ""), (len(initials), "a")) if n in best)


def expected(rows, conversations):
    out = []
    for conv in {r[0] for r in conversations}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults, initials = faults_of(mine), [r[2][:1] for r in mine]
        cost, audit = brute(initials, faults)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        at, roles, texts = 0, [], []
        for e in audit:
            tail = roles[-1][:1] if roles else ""
            if e in "KRI":
                roles.append(mine[at][2] if e == "K" else "assistant" if tail == "u" else "user")
                texts.append("" if e == "I" else mine[at][3])
            at += e != "I"
        assert SHAPE.match("".join(r[:1] for r in roles))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, text string, seg int, audit string, last boolean")


def result(spark, rows):
    source = frame(spark, rows)
    return sorted((tuple(r) for r in rp.repair(rp.damaged(source), source).collect()), key=str)


def conversations(seed=6, many=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \n", "", None, "a longer answer.  ", "end.\t", "日本。", "same."]
    rows = []
    for conv in range(many):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, f"{turn} " + (rng.choice(texts) or "") if rng.random() < 0.6 else rng.choice(texts)))
    rows += [(None, t, r, "null conversation.") for t, r in ((0, "user"), (1, "assistant"), (None, "user"))]
    rows += [rows[3], rows[3], (900, None, None, None), (901, 5, "user", "x" * 50000 + ".")]
    return rows


def test_against_brute_force(spark):
    rows = conversations()
    gone = [c for c in range(2000, 2200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows += [(c, 0, "user", "dropped.") for c in gone]
    got = result(spark, rows)
    assert got == sorted(expected(hurt(rows), rows), key=str)
    assert {r for r in got if r[0] in gone} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}


def test_long_conversations_in_segments(spark, monkeypatch):
    monkeypatch.setattr(rp, "SEGMENT", 4)
    rng = random.Random(9)
    rows = []
    for conv in range(12):
        for turn in range(rng.choice([3, 4, 5, 8, 9, 40])):
            rows.append((conv if conv else None, turn, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["same.", f"{turn}.", f"{turn} cut", ""])))
    rows += [(50, t, "user", "again.") for t in range(30)]
    assert result(spark, rows) == sorted(expected(hurt(rows), rows), key=str)
    source = frame(spark, rows)
    pieces, _ = rp.repaired_pieces(rp.damaged(source))
    turns = sorted((r for r in rp.repaired_turns(pieces).collect() if r["conv_id"] == 5), key=lambda r: (r["seg"], r["nth"]))
    assert SHAPE.match("".join(r["role"][:1] for r in turns))


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_auction_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n = rng.randint(1, 9)
        initials, faults = "".join(rng.choices("suax", k=n)), "".join(rng.choices("---bdt", k=n))
        grid = rp.Lattice(initials, faults, rp.END, True)
        audit, _ = grid.trace(rp.NOTHING)
        assert (grid.price[rp.NOTHING], audit) == brute(initials, faults)
        for node, arcs in enumerate(grid.arcs):
            assert all(grid.price[node] <= c + grid.price[j] for _, c, j in arcs)


def test_tables_of_segments_chain():
    rng = random.Random(3)
    for _ in range(60):
        initials, faults = "".join(rng.choices("suax", k=12)), "".join(rng.choices("---bdt", k=12))
        behind = rp.END
        for a in (8, 4, 0):
            table = rp.transfer(initials[a : a + 4], faults[a : a + 4], a == 8)
            behind = [min(table[4 * q + r] + behind[r] for r in range(4)) for q in range(4)]
        assert behind[0] == brute(initials, faults)[0]
