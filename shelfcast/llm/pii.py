"""Personal data by fixed patterns and bootstrapped contexts, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import text_of
from shelfcast.session import pin

KINDS = ("email", "ip", "card", "phone")

#: The fixed patterns. Runs are possessive, and a start inside a run counts only right after the match before
#: (\G), which gives the leftmost matches of the plain patterns in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: A word with a digit, the shape of identifiers the fixed patterns don't know.
MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_BLOCK = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        # Leading zeros aside, a part above 255 has four digits or a value beyond it.
        part = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def cut_up(df: DataFrame, patterns: dict[str, str], needs: dict[str, str]) -> DataFrame:
    """``df`` with, per pattern, the gaps before its matches and the matches; both empty where nothing can match.

    The last gap runs to the end of the text, with an empty match.
    """
    none = F.array().cast("array<string>")
    out = []
    for name, pattern in patterns.items():
        full, may = F.lit(rf"(?s)(.*?)({pattern}|\z)"), F.col("text").rlike(needs[name])
        for part, group in (("gaps", 1), ("hits", 2)):
            out.append(F.when(may, F.regexp_extract_all("text", full, F.lit(group))).otherwise(none).alias(f"{part}_{name}"))
    return df.select("*", *out)


def measure(df: DataFrame, names) -> DataFrame:
    """Adds, per pattern, the lengths of gap and match together, and their sums over blocks."""
    df = df.select("*", *[F.zip_with(f"gaps_{n}", f"hits_{n}", lambda g, h: F.length(g) + F.length(h)).alias(f"lens_{n}") for n in names])

    def sums(n: str) -> Column:
        lens = F.col(f"lens_{n}")
        at = F.when(F.size(lens) > 0, F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda s, x: s + x)).alias(f"sums_{n}")

    return df.select("*", *[sums(n) for n in names])


def placed(name: str) -> Column:
    """Array of (start, end, hit) of a pattern's matches, in code points."""
    gaps, hits, lens, sums = (F.col(f"{x}_{name}") for x in ("gaps", "hits", "lens", "sums"))

    def place(h: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        add = lambda s, x: s + x
        far = F.when(F.size(sums) > 1, F.aggregate(F.slice(sums, F.lit(1), block), F.lit(0), add)).otherwise(F.lit(0))
        start = far + F.aggregate(F.slice(lens, block * _BLOCK + 1, i % _BLOCK), F.lit(0), add) + F.length(F.element_at(gaps, i + 1))
        return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"))

    return F.filter(F.transform(hits, place), lambda s: s["hit"] != "")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds ``base``: the fixed patterns' spans (start, kind number, end), in order."""
    df = measure(cut_up(df, PATTERNS, NEEDS), PATTERNS)

    def spans(k: int, name: str) -> Column:
        good = F.filter(placed(name), lambda s: valid(name, s["hit"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    found = [spans(k, name) for k, name in enumerate(KINDS)]
    return df.select("row", "doc_id", "text", F.array_sort(F.concat(*found)).alias("base"))


def context(text: Column, start: Column, end: Column) -> Column:
    """Patterns around a span: the word before it, the two words before it, and the words before and after it."""
    left = F.lower(F.substring(text, F.greatest(start - 47, F.lit(1)), F.least(start, F.lit(48))))
    one = F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    two = F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    right = F.regexp_extract(F.lower(F.substring(text, end + 1, F.lit(32))), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    names = F.array(
        F.when(one != "", F.concat(F.lit("a "), one)), F.when(two != "", F.concat(F.lit("b "), two)),
        F.when((one != "") & (right != ""), F.concat(F.lit("c "), one, F.lit(" _ "), right)),
    )
    return F.filter(F.transform(names, lambda p: F.regexp_replace(p, "[0-9]+", "0")), lambda p: p.isNotNull())


def mentions(df: DataFrame) -> DataFrame:
    """Adds ``seen``: base spans with kind and context, and unknown identifier-like words (kind -1) outside them."""
    df = measure(cut_up(df, {"mention": MENTION}, {"mention": "[0-9]"}), ["mention"])
    known = F.lit("|".join(f"(?:{PATTERNS[k]})" for k in ("email", "ip")))
    trimmed = F.transform(
        placed("mention"),
        lambda s: F.struct(
            (s["start"] + F.length(F.regexp_extract(s["hit"], r"^[\"'(\[{<]*", 0))).alias("start"),
            (s["end"] - F.length(F.regexp_extract(s["hit"], r"[\"'.,;:!?)\]}>]*$", 0))).alias("end"), s["hit"].alias("hit"),
        ),
    )
    shaped = F.filter(trimmed, lambda s: (s["end"] - s["start"] >= 6) & (F.length(F.regexp_replace(s["hit"], "[^0-9]", "")) >= 4) & ~F.rlike(s["hit"], known))
    df = df.select("row", "doc_id", "text", "base", shaped.alias("words"))
    free = F.filter("words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    span = "struct<start:int,end:int,kind:int>"
    both = F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")).cast(span)),
        F.transform(free, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit(-1).alias("kind")).cast(span)),
    )
    df = df.select("row", "doc_id", "text", "base", both.alias("both"))
    seen = F.transform(
        "both",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
            F.xxhash64(F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))).alias("instance"),
            context(F.col("text"), s["start"], s["end"]).alias("patterns"),
        ),
    )
    return df.select("row", "doc_id", "base", seen.alias("seen"))


def _shares(prefix: str, weight: Column, of: Column) -> list[Column]:
    return [(F.sum(weight * F.col(f"{prefix}{k}")) / of).alias(f"c{k}") for k in range(len(KINDS))]


def bootstrap(edges: DataFrame, rounds: int, trust: float, support: int) -> tuple[DataFrame, DataFrame]:
    """Confidence per kind of patterns (trusted ones only) and of instances, spread over the graph in ``rounds`` rounds.

    ``edges`` has (pattern, instance, kind, n). Seeds keep confidence 1 in their kind. A pattern's confidence in a kind is
    the mean confidence of the instances it was seen with, plus one unknown instance; an unknown instance takes the mean
    of its patterns. A pattern is trusted from ``support`` distinct seeds and confidence ``trust`` on.
    """
    kinds = range(len(KINDS))
    seeds = edges.groupBy("instance").agg(F.max("kind").alias("kind"))
    instances = pin(seeds.select("instance", "kind", *[F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(f"i{k}") for k in kinds]), "pii-instances")
    for _ in range(rounds):
        seen = edges.select("pattern", "instance", "n").join(instances, "instance")
        # Each instance counts once per pattern, however often it is copied.
        patterns = pin(
            seen.groupBy("pattern").agg(*_shares("i", F.lit(1.0), F.count(F.lit(1)) + 1), F.sum(F.when(F.col("kind") >= 0, 1).otherwise(0)).alias("support")),
            "pii-patterns",
        )
        spread = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg(
            *[F.avg(f"c{k}").alias(f"a{k}") for k in kinds]
        )
        instances = pin(
            instances.join(spread, "instance").select(
                "instance", "kind", *[F.when(F.col("kind") >= 0, F.col(f"i{k}")).otherwise(F.col(f"a{k}")).alias(f"i{k}") for k in kinds]
            ),
            "pii-instances",
        )
    trusted = patterns.where((F.col("support") >= support) & (F.greatest(*[F.col(f"c{k}") for k in kinds]) >= trust))
    return trusted, instances


def find_personal(docs: DataFrame, rounds: int = 3, trust: float = 0.8, support: int = 5, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Matches of the fixed patterns are seeds. The words around them are patterns; patterns and all identifier-like words
    they occur with form a graph on which confidence spreads in a fixed number of rounds. A word that no fixed pattern
    knows is added as the kind of a trusted pattern around it when its own confidence in that kind is at least ``least``.

    Everything is counted over all documents by distinct pattern and instance, so copies of a passage count once, and a
    frequent context is summed before the shuffle. Null and empty texts have no spans. Null ids stay null, repeated rows
    are searched each, an empty table gives no rows, other columns are not read. Long texts are searched whole.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    rows = pin(mentions(base_spans(source)), "pii")
    flat = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    edges = pin(
        flat.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-edges"
    )
    trusted, instances = bootstrap(edges, rounds, trust, support)
    unknown = flat.where("kind < 0").select("row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    scored = unknown.join(trusted, "pattern").join(instances.drop("kind"), "instance")
    best = F.array_max(F.array(*[F.struct(F.col(f"c{k}").alias("c"), F.col(f"i{k}").alias("i"), F.lit(k).alias("kind")) for k in range(len(KINDS))]))
    added = scored.select("row", "start", "end", best.alias("b")).where(F.col("b.i") >= least).groupBy("row", "start", "end").agg(F.max("b").alias("b"))
    per_row = added.groupBy("row").agg(F.collect_list(F.struct("start", F.col("b.kind").alias("kind"), "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))

    def listed(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    out = rows.select("row", "doc_id", "base").join(per_row, "row", "left")
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"))
