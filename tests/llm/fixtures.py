"""Documents with every awkward case, and helpers for brute-force checks."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, pos string, line int, words string, print long, score double"


def prose(rng, words):
    stems = ["ner", "tal", "vo", "shi", "quen", "dar", "mel", "ost", "ira", "bu"]
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(words))


def awkward(seed=3, many=60):
    """(doc_id, text, source) rows: nulls, empty and blank texts, repeated rows, ties, near copies and one long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(12, 60)) for _ in range(many)]
    rows = [(i, "\n".join([base[i], base[(i * 7) % many] if i % 3 == 0 else prose(rng, 15)]), f"s{i % 4}") for i in range(many)]
    for i in range(10):
        words = base[i].split()
        words[len(words) // 2] = "changed"
        rows.append((100 + i, " ".join(words), "s0"))
        rows.append((120 + i, "  " + base[i].replace(" ", "\t") + " \n", "s1"))
        del words[3]
        rows.append((140 + i, " ".join(words), None))
    rows += [(200, None, "s0"), (201, "", "s1"), (202, " \t\n ", None), (203, "", None), (None, "no name here at all " * 3, "s2"), (None, None, None)]
    rows += [rows[5], rows[5], (204, prose(rng, 12000), "s3"), (205, "ä" * 30 + " " + "日本 語" * 20, "s3"), (206, "a", "s2"), (207, "a", "s2")]
    return rows


def frame(spark, rows):
    """The rows with the other columns of documents and columns whose names the operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), "r", 7, "p", 1, "w", 5, 0.5) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


def stored(spark, rows, folder, name="documents"):
    path = str(folder / f"{name}.parquet")
    frame(spark, rows).repartition(3).write.mode("overwrite").parquet(path)
    return path
