import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from headerwise.settings import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="4g",
        spark__driver__bindAddress="127.0.0.1",
        spark__driver__host="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
