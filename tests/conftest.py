import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from filescape.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as tuples, in the frame's order."""
    return lambda df, *columns: [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture
def make_tree(tmp_path):
    """Write {relative path: bytes or text} below a fresh folder."""

    def make(files):
        for path, content in files.items():
            target = tmp_path / "tree" / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(tmp_path / "tree")

    return make
