import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from faultlens.model import LINE_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a function of the column ``text`` on some texts, in their order."""

    def run(function, texts):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
        found = rows.select("n", function(F.col("text")).alias("result")).orderBy("n").collect()
        return [row.result for row in found]

    return run


@pytest.fixture(scope="session")
def log_table(spark):
    """A table of log lines from a dict of file path to lines."""

    def build(logs):
        rows = []
        for path, lines in logs.items():
            source, _, name = path.rpartition("/")
            layer, _, node = name.rpartition(".")
            rows += [
                (source, path, name, node, layer, "", 0, n, line) for n, line in enumerate(lines)
            ]
        kinds = ["string"] * 6 + ["bigint", "bigint", "string"]
        schema = ", ".join(f"{name} {kind}" for name, kind in zip(LINE_COLUMNS, kinds))
        return spark.createDataFrame(rows, schema)

    return build
