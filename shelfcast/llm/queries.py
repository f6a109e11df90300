"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import table, text_of, word_count


def vocabulary() -> str:
    """The word vocabulary's file; ``SHELFCAST_VOCABULARY`` names another copy."""
    named = os.environ.get("SHELFCAST_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.mixing import mix_plan

    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(text_of()).alias("size"))
    plan = mix_plan(docs, F.col("size"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.toxicity import score_documents

    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.pii import find_personal

    return find_personal(table(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.secrets import find_secrets

    return find_secrets(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.quality import judge

    return judge(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.tokens import length_histogram

    return length_histogram(table(spark, folder, "documents"), vocabulary())


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.exact_dedup import deduplicate

    return deduplicate(spark, f"{folder}/documents.parquet").withColumnRenamed("digest", "text_sha256")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.col("kept_text").alias("text"))


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.packing import pack

    return pack(table(spark, folder, "documents"), vocabulary(), with_ids=False).drop("ids")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.repair import damaged, repair

    conversations = table(spark, folder, "conversations")
    return repair(damaged(conversations), conversations)


def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.decontaminate import overlaps

    found = overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, "contaminated")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    from shelfcast.llm.codes import compress

    return compress(table(spark, folder, "embeddings")).drop("label")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_personal_data": op4_personal_data,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_pack": op10_pack,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_decontaminate": op12_decontaminate,
    "op13_vector_codes": op13_vector_codes,
}

#: A word, as RE2 spells it.
_WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters, digits and characters beyond ASCII, and the letters that are lower-cased.
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def _repair_sql() -> str:
    """Damage by a CRC-32 in list functions; cheapest edits by a recursion from the last row, states as columns."""
    # Each state: (cost, audit, repaired lines). n, s, u, a: nothing yet, after system, after user, after assistant.
    follow = {"n": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
    keep = {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def way(cost: str, edit: str, to: str, line: str | None) -> str:
        lines = f"{to}.t" if line is None else f"list_prepend({line}, {to}.t)"
        return f"{{'c': {cost} + {to}.c, 'a': '{edit}' || {to}.a, 't': {lines}}}"

    def choose(options: list[str]) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    none = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    rows, first, second = [], [], []
    for q, (to, role) in follow.items():
        options = [way("4", "D", f"w.{q}", None)]
        for initial, state in keep[q].items():
            options.append(f"CASE WHEN r.stays AND r.initial = '{initial}' THEN {way('r.extra', 'K', f'w.{state}', 'r.line')} ELSE {none} END")
        other = f"'{role}:' || r.text"
        options.append(f"CASE WHEN r.stays THEN {way('r.extra + 3', 'R', f'w.{to}', other)} ELSE {none} END")
        rows.append(f"{choose(options)} AS {q}")
        insert = way("3", "I", to, f"'{role}:'")
        first.append(f"{choose([q, insert])} AS {q}")
        second.append(f"{choose([q, insert])} AS {q}")
    return rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
d AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS MATERIALIZED (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda z: CAST(ascii(z) AS BIGINT)),
  lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM d, crc),
h AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  UNNEST(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final,
  ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS nth, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM h),
f AS MATERIALIZED (SELECT *, CASE WHEN final = '' THEN 'b' WHEN nth > MIN(nth) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
  LAG(initial) OVER (PARTITION BY conv_id ORDER BY nth) || initial AS pair FROM o),
r AS MATERIALIZED (SELECT conv_id, nth, n, initial, text, role || ':' || text AS line, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM f),
z AS (SELECT {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS n, {none} AS s, {none} AS u, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS a),
z1 AS (SELECT {", ".join(first)} FROM z), z2 AS (SELECT {", ".join(second)} FROM z1),
w AS (SELECT conv_id, many + 1 AS nth, n, s, u, a FROM (SELECT DISTINCT conv_id, n AS many FROM r), z2
  UNION ALL SELECT conv_id, nth, {", ".join(second)} FROM (SELECT conv_id, nth, {", ".join(first)} FROM (
    SELECT w.conv_id, r.nth, {", ".join(rows)} FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.nth = w.nth - 1))),
e AS (SELECT conv_id, n.c AS cost, n.a AS audit, sha256(array_to_string(n.t, chr(10))) AS repaired_sha256 FROM w WHERE nth = 1),
g AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'b') AS blank,
  COUNT(*) FILTER (WHERE fault = 'd') AS duplicate, COUNT(*) FILTER (WHERE fault = 't') AS truncated, COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
  COALESCE(illegal, 0) AS illegal, CAST(COALESCE(cost, 0) AS BIGINT) AS cost, COALESCE(audit, '') AS audit, COALESCE(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _codes_sql(rounds: int = 6) -> str:
    """Codebooks and codes; every round is two tables: nearest entries, and entries moved to the mean of their parts."""
    dist = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        near = f"SELECT p.part, p.x, p.n, arg_min(b.entry, ({dist}, b.entry)) AS entry, MIN({dist}) AS far FROM p JOIN b{i} b USING (part) GROUP BY p.part, p.x, p.n"
        steps.append(f"n{i} AS MATERIALIZED ({near})")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT part, entry, list(c ORDER BY dim) AS c FROM (
  SELECT part, entry, dim, CAST(floor_div AS BIGINT) AS c FROM (SELECT part, entry, dim, (SUM(n * v)::HUGEINT - ((SUM(n * v)::HUGEINT % SUM(n)::HUGEINT) + SUM(n)::HUGEINT) % SUM(n)::HUGEINT) // SUM(n)::HUGEINT AS floor_div
  FROM (SELECT part, entry, n, UNNEST(x) AS v, UNNEST(range(1, len(x) + 1)) AS dim FROM n{i}) GROUP BY ALL)) GROUP BY part, entry)""")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, v, UNNEST(range(0, 8)) AS part FROM k),
q AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS x FROM e),
p AS MATERIALIZED (SELECT part, x, COUNT(*) AS n FROM q GROUP BY part, x),
s AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id, v) - 1 AS entry FROM k),
b0 AS MATERIALIZED (SELECT q.part, s.entry, q.x AS c FROM s JOIN q USING (vec_id) WHERE s.entry < 16),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT q.vec_id, q.label, string_agg(printf('%02x', n.entry), '' ORDER BY q.part) AS code, CAST(SUM(n.far) AS BIGINT) AS error
  FROM q JOIN n{rounds} n ON n.part = q.part AND n.x = q.x GROUP BY q.vec_id, q.label)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h
"""


ORACLES = {
    "op1_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
  source_size * CAST(2.0 AS DOUBLE) AS most FROM t),
r AS (SELECT *, CAST(SUM(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total,
  COALESCE(SUM(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  SUM(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
l AS (SELECT *, (total - before) / CAST(w_left AS DOUBLE) AS level, most <= (total - before) / CAST(w_left AS DOUBLE) * w AS capped FROM r),
f AS (SELECT *, (SELECT MIN_BY(level, before) FROM l WHERE NOT capped) AS open_level FROM l),
g AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE open_level * w END AS target,
  CAST('0x' || substr(md5('1:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' END || COALESCE(source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u FROM f),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
  ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(LEAST(floor(n * rate + u) - floor((n - 1) * rate + u), ceil(rate)) AS BIGINT) AS copies FROM k)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(COALESCE(text, '')) AS size, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT *, FIRST_VALUE(doc_id) OVER (PARTITION BY t ORDER BY size DESC, doc_id) AS keep_id, COUNT(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
""",
    "op9_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, UNNEST(range(1, len(ls) + 1)) AS line, UNNEST(ls) AS raw FROM d),
l AS (SELECT *, regexp_extract_all(raw, '{_WORD}') AS w, ROW_NUMBER() OVER (ORDER BY doc_id, line) AS pos FROM x),
u AS (SELECT w, len(w) AS n, MIN(pos) AS pos FROM l WHERE len(w) > 0 GROUP BY w),
p AS (SELECT pos, w, n, UNNEST(range(0, n + 1)) AS i FROM u WHERE n >= 8),
v AS (SELECT pos, i, CASE WHEN i = 0 THEN w ELSE list_concat(w[1:i - 1], w[i + 1:]) END AS v FROM p),
near AS (SELECT DISTINCT b.pos FROM v a JOIN v b ON a.v = b.v AND a.pos < b.pos AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
f AS (SELECT l.*, len(w) > 0 AND (pos NOT IN (SELECT pos FROM u) OR pos IN (SELECT pos FROM near)) AS gone FROM l)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
  COALESCE(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text FROM f GROUP BY doc_id
""",
    "op11_conversation_repair": _repair_sql(),
    "op12_decontaminate": rf"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS id, doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS w FROM documents),
t AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS w FROM benchmark),
i AS (SELECT item_id, w, LEAST(len(w), 10) AS k, UNNEST(range(1, GREATEST(len(w) - 9, 1) + 1)) AS p FROM t WHERE len(w) > 0),
n AS MATERIALIZED (SELECT DISTINCT item_id, k, w[p:p + k - 1] AS g FROM i),
e AS (SELECT id, w, k, UNNEST(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k),
h AS MATERIALIZED (SELECT e.id, e.p, e.k, n.item_id FROM (SELECT id, k, p, w[p:p + k - 1] AS g FROM e) e JOIN n ON n.k = e.k AND n.g = e.g),
x AS (SELECT id, COUNT(*) AS n_hit FROM (SELECT DISTINCT id, UNNEST(range(p, p + k)) AS p FROM (SELECT DISTINCT id, p, k FROM h)) GROUP BY id),
y AS (SELECT id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, COALESCE(CAST(item_id AS VARCHAR), '') AS item FROM h) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN x USING (id) LEFT JOIN y USING (id)
""",
    "op13_vector_codes": _codes_sql(),
}
