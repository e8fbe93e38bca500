import gc
import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fieldmark.session import session

    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="module", autouse=True)
def released():
    """After each module: what its tests broadcast or cached is let go, so that one session carries the whole suite."""
    yield
    from pyspark.sql import SparkSession

    live = SparkSession.getActiveSession()
    if live is not None:
        live.catalog.clearCache()
        gc.collect()
        live.sparkContext._jvm.System.gc()
