"""The shared folder: the session's setting, one of our own on one machine, an error elsewhere; nothing stays when the driver ends."""

import os
import subprocess
import sys

import pytest

from kinfold import shared
from kinfold.plans import catalog


@pytest.mark.parametrize("master,one", [("local", True), ("local[8]", True), ("local[*]", True), ("local[4,2]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://host:7077", False), ("k8s://https://host", False)])
def test_one_process(master, one):
    assert shared.one_process(master) is one


def test_a_session_without_the_setting_uses_a_folder_of_its_own(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shared, "configured_dir", lambda s: "")
    assert shared.shared_dir(spark).startswith("file:///") and shared.shared_dir(spark) == shared.shared_dir(spark)
    assert catalog.QUERIES["connected_clusters"](spark, sf_dir).count() == 500


def test_a_cluster_without_the_setting_raises(spark, monkeypatch):
    monkeypatch.setattr(shared, "configured_dir", lambda s: "")
    monkeypatch.setattr(shared, "one_process", lambda master: False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(spark)


def test_the_driver_leaves_no_tables(sf_dir, tmp_path):
    """A driver of its own runs a query whose result is read from written tables; after it the shared folder is empty."""
    code = f"""
from pyspark.sql import SparkSession
from kinfold.plans import catalog
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", catalog.QUERIES["tree_closure"](s, "{sf_dir}").count())
import os
print("tables", any(x.startswith("kinfold-") for x in os.listdir("{tmp_path}")))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert "rows 86" in out.stdout and "tables True" in out.stdout, out.stderr[-2000:]
    assert not [x for x in os.listdir(tmp_path) if x.startswith("kinfold-")]  # Spark makes a folder of its own there
