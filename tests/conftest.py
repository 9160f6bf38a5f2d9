import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def look(v):
    """A Python cell as a grid cell (raw, kind)."""
    if v is None:
        return (None, None)
    if isinstance(v, bool):
        return ("TRUE" if v else "FALSE", "boolean")
    if isinstance(v, (int, float)):
        return (str(v), "number")
    return (v, "string")


GRID = "file_id string, sheet string, row_idx bigint, cells array<struct<raw: string, kind: string>>"
MERGES = "file_id string, sheet string, merge_idx int, start_row bigint, start_col int, end_row bigint, end_col int"


@pytest.fixture
def make_grid(spark):
    def make(*grids):
        rows = [(f"f{g}", "s", i, [look(v) for v in row]) for g, grid in enumerate(grids) for i, row in enumerate(grid)]
        return spark.createDataFrame(rows, GRID)

    return make


@pytest.fixture
def make_merges(spark):
    def make(*merges):
        return spark.createDataFrame([("f0", "s", i, *m) for i, m in enumerate(merges)], MERGES)

    return make
