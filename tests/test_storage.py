"""Intermediate tables live in the shared folder and can be removed."""

import os

from loomkb import storage


def test_tables_are_written_and_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "_written", [])
    monkeypatch.setattr(storage, "shared_dir", lambda s: f"file://{tmp_path}")
    table = storage.materialize(spark.range(5).toDF("x"), "five")
    assert table.count() == 5 and len(os.listdir(tmp_path)) == 1
    storage.remove_scratch(spark)
    assert os.listdir(tmp_path) == []
