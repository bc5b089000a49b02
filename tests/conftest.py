from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from flockscan.session import local_session

    # Plans are searched for pushed filters, which are cut short by default.
    settings = {"spark.sql.maxMetadataStringLength": "1000", "spark.sql.shuffle.partitions": "3"}
    session = local_session(8, "flockscan-tests", **settings)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sentences(spark):
    # The four texts whose word graph is worked out in FIXTURES.md.
    texts = [
        "La guerre en ukraine",
        "La guerre en RDC",
        "Les élections en ukraine",
        "Les élections en RDC",
    ]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
