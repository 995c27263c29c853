from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from geotext.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Limits so low that small tables take the paths for hot keys and crowded cells."""
    from geotext.operators import blocks, skew

    monkeypatch.setattr(skew, "HOT_ROWS", 12)
    monkeypatch.setattr(blocks, "CROWDED_SITES", 3)
    monkeypatch.setattr(blocks, "PAIR_SITES", 6)
