import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from spanwise.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session("*", shuffle_partitions=4, name="spanwise-tests", conf=shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_views_left(request):
    """Views made by one test are not there for the next one, which shares its session."""
    yield
    if "spark" in request.fixturenames:
        session = request.getfixturevalue("spark")
        for view in session.sql("SHOW VIEWS").filter("isTemporary").collect():
            session.catalog.dropTempView(view.viewName)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def table(spark):
    """`table("id long, start_date date", (1, "2001-01-01"), ...)`; ISO text becomes dates."""
    import datetime as dt

    def build(schema, *rows):
        kinds = [part.split()[-1] for part in schema.split(",")]
        fixed = [
            tuple(dt.date.fromisoformat(v) if k == "date" and isinstance(v, str) else v for k, v in zip(kinds, row))
            for row in rows
        ]
        return spark.createDataFrame(fixed, schema)

    return build


def rows(df, *cols):
    """Sorted rows as tuples of text and numbers."""
    picked = df.select(*[f"`{c}`" for c in cols]) if cols else df

    def plain(v):
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=repr)
