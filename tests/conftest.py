import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").appName("reviewlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def always_shuffle(monkeypatch):
    """No side is small enough to be broadcast by the size check."""
    monkeypatch.setattr("reviewlens.session.BROADCAST_LIMIT_BYTES", -1)


@pytest.fixture
def tiny_reviews(spark):
    rows = [
        (1, "a lovely warm picture with superb acting", 1),
        (2, "superb script and superb cast", 1),
        (3, "warm funny and lovely from start to end", 1),
        (4, "an excellent picture and a lovely score", 1),
        (5, "excellent cast and an excellent end", 1),
        (6, "a dull picture with wooden acting", 0),
        (7, "wooden script and a tedious cast", 0),
        (8, "tedious dull and far too long", 0),
        (9, "a dreadful score and a dreadful end", 0),
        (10, "dreadful acting in a tedious picture", 0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")
