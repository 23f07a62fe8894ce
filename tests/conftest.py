from __future__ import annotations

import sys
import tempfile
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from inkwell.config import local_session  # noqa: E402
from inkwell.schemas import ARTICLES_RAW  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def scratch() -> str:
    return tempfile.mkdtemp(prefix="inkwell-tests-")


@pytest.fixture(scope="session")
def spark(scratch):
    session = local_session(app="inkwell-tests", partitions=8, scratch=f"{scratch}/checkpoints")
    yield session
    session.stop()


def ts(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def raw_rows(spark, rows: list[dict]):
    """articles_raw DataFrame from partial dicts (missing keys are null)."""
    names = ARTICLES_RAW.fieldNames()
    data = []
    for r in rows:
        r = dict(r)
        for key in ("published_at", "ingested_at"):
            if isinstance(r.get(key), str):
                r[key] = ts(r[key])
        data.append(tuple(r.get(n) for n in names))
    df = spark.createDataFrame(data, ARTICLES_RAW)
    return df
