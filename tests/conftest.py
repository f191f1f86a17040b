import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quaestor.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "tests",
        "4",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": f"file://{shared}",
            "spark.sql.warehouse.dir": f"{shared}/warehouse",
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf(request):
    return "/root/testdata/sf0.001"
