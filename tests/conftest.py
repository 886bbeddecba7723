import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from waymark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_corpus(spark):
    """Corpus rows from {path: text}."""

    def make(files: dict[str, str]):
        rows = [(p, c, len(c.encode()), None, None) for p, c in files.items()]
        return spark.createDataFrame(
            rows, "path string, content string, size long, mtime timestamp, ctime timestamp"
        )

    return make
