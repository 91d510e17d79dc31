import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DOC = "id string, rev string, deleted boolean, data_json string, tags array<string>, content string"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [
        ("a", "1-x", False, '{"type":"note","rating":5,"city":"Moscow","a":[{"b":"deep"}],"geo":{"geo.hash":"u1"}}', ["Active", " blue "], "The quick brown fox"),
        ("b", "1-x", False, '{"type":"note","rating":"5","flag":true}', ["active"], "quick silver"),
        ("c", "1-x", False, '{"type":"note","rating":5.0,"nul":null}', ["BLUE", "blue", "", None], ""),
        ("d", "1-x", True, '{"type":"note","rating":6}', ["active"], "quick deleted"),
        ("e", None, False, "{broken", None, "Ёлка élan x 𝒜b"),
        ("f", "1-x", False, None, [], None),
    ]
    return spark.createDataFrame(rows, DOC)


def ids(df):
    return [r[0] for r in df.select(df.columns[0]).collect()]
