import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from contest_panel.plans import fixtures as fx  # noqa: E402
from contest_panel.session import checkpoint_folder, local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    checkpoint_folder(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def season(spark):
    frame = fx.season(spark, FOLDER).cache()
    frame.count()
    return frame


@pytest.fixture(scope="session")
def parsed(spark):
    frame = fx.parsed_log(spark, FOLDER).cache()
    frame.count()
    return frame


@pytest.fixture(scope="session")
def focal(parsed):
    from contest_panel.operators import dedup, orient

    frame = orient.focal_rows(dedup.clean_first(parsed)).cache()
    frame.count()
    return frame


def as_set(frame, digits=9):
    def plain(value):
        if isinstance(value, float):
            return round(value, digits)
        if isinstance(value, (list, tuple)):
            return tuple(plain(v) for v in value)
        return value

    columns = sorted(frame.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
