import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexweave.session import build_session

    shared = tmp_path_factory.mktemp("shared").as_uri()
    session = build_session("local[8]", **{"spark.checkpoint.dir": shared, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                           "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
