"""Line dedup by a deletion-neighbourhood join, with DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.bitmap import marks, maybe
from shelfcast.operators.scale import running_totals
from shelfcast.session import pin

#: A document's key. Rows with the same id and the same text are one document; a null id sorts last.
DOC = ("doc_null", "doc_num", "doc_hash")
POS = (*DOC, "line")
_BLOCK = 256


def doc_key(text: Column) -> list[Column]:
    doc = F.col("doc_id").cast("long")
    return [doc.isNull().alias("doc_null"), F.coalesce(doc, F.lit(0).cast("long")).alias("doc_num"), F.xxhash64(text).alias("doc_hash")]


def normal(line: Column) -> Column:
    """The line's words with single spaces between them."""
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def before_each(values: Column) -> Column:
    """XOR of all earlier elements, for each element of an array; two levels keep a very long array near linear."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))

    def inside(b: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("x"))
        run = F.aggregate(
            F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), start,
            lambda s, v: F.struct(F.array_append(s["out"], s["x"]).alias("out"), s["x"].bitwiseXOR(v).alias("x")),
        )
        return run

    runs = F.transform(blocks, inside)
    start = F.struct(F.array().cast("array<array<bigint>>").alias("out"), F.lit(0).cast("bigint").alias("x"))
    joined = F.aggregate(
        runs, start,
        lambda s, r: F.struct(
            F.array_append(s["out"], F.transform(r["out"], lambda y: y.bitwiseXOR(s["x"]))).alias("out"), s["x"].bitwiseXOR(r["x"]).alias("x")
        ),
    )
    return F.flatten(joined["out"])


def line_rows(docs: DataFrame, near_words: int) -> DataFrame:
    """One row per line with a word: its position, a 96-bit hash of its words, and keys that any near line shares.

    Two lines within one edit share either their first or their last p words, p being half the words of the shorter one.
    A line gives the keys for its own half and for that of a line one word shorter, so no near line is missed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(*doc_key(text), F.posexplode(F.split(text, "\n")).alias("line", "raw")).select(*POS, normal(F.col("raw")).alias("w")).where("w != ''")
    lines = lines.withColumn("n", F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) + 1)

    def half(side: int, less: int) -> Column:
        p = f"cast((n - {less}) div 2 as int)"
        return F.xxhash64(F.lit(side), F.expr(p), F.expr(f"substring_index(w, ' ', {p} * {side})"))

    # With an odd number of words both halves have the same length.
    keys = F.when(F.col("n") % 2 == 1, F.array(half(1, 0), half(-1, 0))).otherwise(F.array(half(1, 0), half(-1, 0), half(1, 1), half(-1, 1)))
    none = F.array().cast("array<bigint>")
    return lines.select(*POS, F.xxhash64("w").alias("h1"), F.hash("w").alias("h2"), F.when(F.col("n") >= near_words, keys).otherwise(none).alias("keys"))


def variants(lines: DataFrame) -> DataFrame:
    """Hashed keys of each line (columns rank, words) and of each line with one word left out: (rank, v, i).

    A hash is the XOR of the hashes of (word, place), so leaving out word i only needs the places before and after it.
    The number of words hashed is part of the key; ``i`` is the place left out, -1 for none.
    """
    here = F.transform("words", lambda w, j: F.xxhash64(w, j))
    shifted = F.transform("words", lambda w, j: F.xxhash64(w, j - 1))
    placed = lines.select("rank", F.size("words").alias("n"), here.alias("f"), shifted.alias("g"))
    both = placed.withColumn("c", F.zip_with("f", "g", lambda a, b: a.bitwiseXOR(b)))

    def whole(a: str) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(x))

    swept = both.select(
        "rank", "g", whole("f").bitwiseXOR(F.xxhash64("n")).alias("all_f"), whole("g").bitwiseXOR(F.xxhash64(F.col("n") - 1)).alias("all_g"),
        before_each(F.col("c")).alias("before"),
    )
    cut = F.zip_with("g", "before", lambda g, b: g.bitwiseXOR(b).bitwiseXOR(F.col("all_g")))
    every = F.concat(F.array("all_f"), cut)
    return swept.select("rank", F.posexplode(every).alias("i", "v")).withColumn("i", F.col("i") - 1)


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one word replaced, added or left out."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d)) <= 1
    longer, shorter = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    same = F.array_position(F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    rest = F.slice(longer, same + 2, F.greatest(F.size(shorter) - same, F.lit(0))) == F.slice(shorter, same + 1, F.greatest(F.size(shorter) - same, F.lit(0)))
    return F.when(F.size(a) == F.size(b), replaced).when(F.size(longer) == F.size(shorter) + 1, rest).otherwise(F.lit(False))


def candidates(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(POS..., rank): first places of distinct lines that share a key with another line, numbered in corpus order."""
    keyed = rows.select("h1", "h2", F.explode("keys").alias("key"))
    shared = pin(
        keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d"))
        .where("a < b or c < d").select("key"), "shared-keys",
    )
    found = maybe(keyed, "key", marks(shared, "key")).join(shared, "key").select("h1", "h2").distinct()
    placed = firsts.join(found, ["h1", "h2"]).select("pos.*")
    return running_totals(placed, [F.col(c) for c in POS], {"rank": F.lit(1).cast("long")})


def near_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(POS...): candidate lines that an earlier line is within one edit of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    places = docs.select(*doc_key(text), F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("at", F.xxhash64(*POS))
    spots = marks(wanted.select(F.xxhash64(*POS).alias("at")), "at")
    held = maybe(places, "at", spots).join(wanted, list(POS)).select("rank", F.split(normal(F.col("raw")), " ").alias("words"))
    # Rows with the same id and text are one document and give the same lines.
    lines = pin(held.dropDuplicates(["rank"]), "near-lines")

    keys = pin(variants(lines), "variants")
    often = pin(keys.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v"), "shared-variants")
    hits = pin(maybe(keys, "v", marks(often, "v")).join(often, "v"), "variant-hits")
    # Lines that agree after leaving out the same place are within one edit, and so is a line and one that lacks a word.
    by_place = hits.groupBy("v", "i").agg(F.min("rank").alias("first"))
    by_key = by_place.groupBy("v").agg(F.min(F.when(F.col("i") < 0, F.col("first"))).alias("full"), F.min(F.when(F.col("i") >= 0, F.col("first"))).alias("cut"))
    offer = F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("first", "full"))
    offers = by_place.join(by_key, "v").select("v", "i", offer.alias("partner"))
    pairs = hits.join(offers, ["v", "i"]).where(F.col("partner") < F.col("rank")).select("rank", "partner").distinct()
    mine, other = lines.select("rank", F.col("words").alias("a")), lines.select(F.col("rank").alias("partner"), F.col("words").alias("b"))
    found = pairs.join(mine, "rank").join(other, "partner").where(within_one(F.col("a"), F.col("b"))).select("rank").distinct()
    return found.join(wanted, "rank").select(*POS)


def dropped_lines(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """(DOC..., lines): the line numbers of each document that an earlier line of the corpus makes superfluous."""
    rows = pin(line_rows(docs, near_words), "lines")
    pos = F.struct(*POS)
    firsts = pin(rows.groupBy("h1", "h2").agg(F.min(pos).alias("pos"), F.count(F.lit(1)).alias("n")), "first-lines")
    repeated = firsts.where("n > 1").select("h1", "h2", "pos")
    copies = maybe(rows.drop("keys"), "h1", marks(repeated, "h1")).join(repeated, ["h1", "h2"]).where(pos != F.col("pos")).select(*POS)
    near = near_lines(docs, candidates(rows, firsts))
    return copies.unionByName(near).groupBy(*DOC).agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with its text less dropped lines: (row, kept_text, n_lines, n_dropped).

    Lines are split at line feeds and compared by their words. In the order of doc_id (null last) and line number, a line
    is dropped if an earlier line of any document has the same words, or if both have at least ``near_words`` words
    and differ by one word replaced, added or left out. Every such earlier line counts, dropped or not, so the result
    does not depend on the order of work. A row is never dropped: it may be left with an empty text.

    Candidates come from a lossless filter on halves of lines; candidate lines emit themselves and every variant with
    one word left out as hashed keys. Before a shuffle, rows without any partner are mostly sifted out by bitmaps of bounded
    size; the joins that follow are exact. Equal keys offer each line the earliest other line, never a pair of every two, so a
    template that a third of all lines follow gives one offer per line; each offer is verified on the words.

    Null and empty texts have no lines to drop; lines without words always stay. Rows with equal id and text are one
    document and keep the same lines. An empty table gives no rows. Other columns are carried in ``row``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, *doc_key(text)).join(dropped_lines(docs, near_words), list(DOC), "left")
    own = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n")
    kept = F.when(F.col("lines").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(
        F.array_join(F.filter(own, lambda x, i: ~F.array_contains("lines", i)), "\n")
    )
    return joined.select("row", kept.alias("kept_text"), F.size(own).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"))


def deduplicated(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """``docs`` with its own columns, dropped lines gone from text and, where there is one, n_chars to match."""
    out = dedup_lines(docs, near_words)
    fresh = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col("row").getField(c).alias(c) for c in docs.columns])
