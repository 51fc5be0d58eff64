from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    d = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{d}/shared")
        .config("spark.sql.warehouse.dir", f"{d}/warehouse")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(df):
    """Rows as sorted text, whatever their order; numbers to 12 digits."""

    def text(v):
        if v is None or v != v if isinstance(v, float) else v is None:
            return "-"
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return repr(list(v))
        return f"{v:.12g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted("|".join(text(v) for v in r) for r in df.itertuples(index=False))
