import hashlib
import random
import re

from shelfcast.llm import pii
from tests.llm.fixtures import awkward, frame, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_x@d.e", "a@b.c@d.e f@g", "x@y.z.w-v..q", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.256 001.002.003.0255 0.0.0.0", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "12 34-56", "+1 (383) 555-6083 +12 +44 20 7946 0958.", "+1-2-3-4-5-6-7-8-9-0 + 5555555555", "4111 1111 1111 1111 1111 1111", "ip 10.0.0.1,10.0.0.2;10.0.0.3",
    "é@x.yz ö.name@mail.org 日1.2.3.4本", "a%b+c@d-e.f-g", "5" * 400, "+1" + "2" * 300, "@@.@ a@.b @a.b", "\n1.2.3.4\n5.6.7.8\n", "x" * 5000 + "@", "1." * 3000,
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (name, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d or "1"), "phone": 10 <= len(d) <= 15}
            if good[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(row, text):
    base = brute(text)
    assert row["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest(), (text, listed(base), row["spans"])
    assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for _, x, _ in base) for k in range(4)]
    assert set(filter(None, listed(base).split(","))) <= set(row["spans"].split(","))


def test_base_against_plain_patterns(spark):
    rng = random.Random(9)
    many = " ".join(f"10.{i % 256}.{i // 256}.7 m{i}@x.org" for i in range(1200))
    noise = ["".join(rng.choices("0123456789.@+- ()abé", k=rng.randint(0, 80))) for _ in range(800)]
    texts = TRICKY + noise + [many]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in pii.find_personal(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        check(got[i], t)


def test_contexts_find_unknown_identifiers(spark):
    rng = random.Random(11)
    rows = [(i, f"{prose(rng, 8)} reach me at +1 (212) 555-{1000 + i} {prose(rng, 5)}", "a") for i in range(30)]
    rows += [(100 + i, f"{prose(rng, 8)} version 20{10 + i}x4471 {prose(rng, 5)}", "a") for i in range(30)]
    rows += [(900, "please reach me at 555x7788x99. soon", "a"), (901, "part number 555x7788x98 here", "a")]
    got = {r["doc_id"]: r for r in pii.find_personal(frame(spark, rows)).collect()}
    assert got[900]["spans"] == "phone:19:30" and got[901]["spans"] == ""
    assert all(got[100 + i]["spans"] == "" for i in range(30))
    for i, t, _ in rows:
        check(got[i], t)


def test_awkward_and_empty(spark):
    assert pii.find_personal(frame(spark, awkward())).count() == len(awkward())
    assert pii.find_personal(frame(spark, [])).count() == 0
