"""Scratch tables and what is left of them."""

import os

from gridloom import session


def test_scratch_is_cleared(spark):
    s = session.Scratch(spark, "some")
    kept = s.keep("a", spark.range(5))
    assert kept.count() == 5 and os.path.isdir(f"{s.folder}/a")
    s.drop("a")
    assert not os.path.isdir(f"{s.folder}/a") and os.path.isdir(s.folder)
    path = session.scratch_path(spark, "other")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) >= 2 and not os.path.isdir(path) and not os.path.isdir(s.folder)
    assert session.clear_scratch(spark) == 0
