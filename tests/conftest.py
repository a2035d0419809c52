import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SMALLEST = "/root/testdata/sf0.001"
CLASHES = ("key", "label", "text_key", "rank", "n", "row", "state", "_n", "id_", "score_", "position", "head", "value")


@pytest.fixture(scope="session")
def damaged(spark, tmp_path_factory):
    """All tables with nulls in every column, repeated rows, and columns that operators use as names."""
    source = Path(SMALLEST)
    if not source.is_dir():
        pytest.skip("no test tables here")
    folder = tmp_path_factory.mktemp("sf")
    for path in sorted(source.iterdir()):
        df = spark.read.parquet(str(path))
        columns = df.columns
        if path.stem != "events":
            for i, c in enumerate(columns):
                df = df.withColumn(c, F.when(F.pmod(F.xxhash64(*columns, F.lit(i)), F.lit(41)) != 0, F.col(c)))
            df = df.unionByName(df.limit(40))
        for c in CLASHES:
            if c not in columns:
                df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{folder}/{path.name}")
    return str(folder)
