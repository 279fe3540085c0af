import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagewright import build_session

    session = build_session("local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pages_of(spark):
    """pages_of(html, ...) -> DataFrame(page_id, url, html)"""
    def make(*bodies, url="https://example.com/a/"):
        return spark.createDataFrame([(n, url, body) for n, body in enumerate(bodies)], "page_id long, url string, html string")

    return make
