"""Pinned tables: a session without a named checkpoint folder, clean-up at the end, and inputs that change."""

import os
import subprocess
import sys

from shelfcast import session
from shelfcast.plans import base

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
from shelfcast.session import build_session, pin, shared_folder, work_folder
spark = build_session(master="local[1]", shuffle_partitions=1)
print("ROWS", pin(spark.range(7), "seven").count())
print("FOLDER", shared_folder(spark), work_folder(spark))
"""


def test_without_a_preset_and_nothing_left_behind(tmp_path):
    """An empty configuration folder names no checkpoint folder."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "SHELFCAST_LOCAL_MEMORY": "1g"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 7" in out.stdout, out.stderr[-2000:]
    folders = out.stdout.split("FOLDER ")[1].split()
    assert len(folders) == 2 and not any(os.path.exists(f) for f in folders)


def test_work_folder_is_below_the_shared_one(spark):
    assert session.work_folder(spark).startswith(session.shared_folder(spark)) and session.work_folder(spark) == session.work_folder(spark)


def test_changed_files_are_read_again(spark, tmp_path):
    folder = str(tmp_path / "tables")

    def write(n):
        spark.range(n).write.mode("overwrite").parquet(f"{folder}/t.parquet")

    def rows():
        return base.pinned(spark, folder, "t", lambda: spark.read.parquet(f"{folder}/t.parquet")).count()

    write(3)
    assert rows() == 3 == rows()
    write(5)
    assert rows() == 5
