import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from erashift.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.log.level": "ERROR",
    })
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples, floats rounded."""
    def collect(df, *cols, digits=9):
        picked = df.select(*cols) if cols else df
        out = [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in picked.collect()]
        return sorted(out, key=repr)

    return collect
