import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablescout.functions import scale  # noqa: E402
from tablescout.operators import quantiles  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tablescout-tests")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tight(monkeypatch):
    """Limits so small that tiny tables take the paths meant for very large ones."""
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 2)
    monkeypatch.setattr(scale, "WINDOW_ROWS", 20)
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 30)
