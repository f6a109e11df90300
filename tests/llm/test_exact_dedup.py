import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import exact_dedup
from tests.llm.fixtures import awkward, frame, stored


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            name = lambda x: None if x[1] else x[2]
            out.append((name(m), name(first), len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in rows), key=str), rows


def test_against_brute_force(spark, tmp_path):
    rows = awkward()
    found, full = got(exact_dedup.deduplicate(spark, stored(spark, rows, tmp_path)))
    assert found == brute(rows)
    assert sum(r["kept"] for r in full) == len({r["digest"] for r in full})


def test_weak_digest_gives_the_same_groups(spark, tmp_path):
    rows = awkward()
    weak = exact_dedup.deduplicate(spark, stored(spark, rows, tmp_path), digest=lambda t: (F.length(t) % 5).cast("string"))
    assert sorted((r[:3] for r in got(weak)[0]), key=str) == sorted((r[:3] for r in brute(rows)), key=str)
    assert weak.where("kept").count() == len({r[3] for r in brute(rows)})


def test_state_goes_on_with_new_files(spark, tmp_path):
    rows, state = awkward(), str(tmp_path / "state")
    path = stored(spark, rows[:40], tmp_path)
    exact_dedup.deduplicate(spark, path, state=state).count()
    frame(spark, rows[40:]).write.mode("append").parquet(path)
    assert got(exact_dedup.deduplicate(spark, path, state=state))[0] == brute(rows)


@pytest.mark.parametrize("single", [True, False])
def test_empty_table_and_single_file(spark, tmp_path, single):
    assert exact_dedup.deduplicate(spark, stored(spark, [], tmp_path)).count() == 0
    if single:
        folder = stored(spark, awkward()[:8], tmp_path, "some")
        frame(spark, awkward()[:8]).coalesce(1).write.mode("overwrite").parquet(folder)
        file = next(p for p in (tmp_path / "some.parquet").iterdir() if p.suffix == ".parquet")
        assert got(exact_dedup.deduplicate(spark, str(file)))[0] == brute(awkward()[:8])
