import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def project(spark, tmp_path):
    """Three models over raw_events with three rows, in the namespace analytics, without git."""
    from branchline.project import Project

    models = tmp_path / "models"
    models.mkdir()
    (tmp_path / "branchline.yml").write_text("warehouse: {namespace: analytics}\nbranching: {git_sync: false}\n")
    (models / "stg_orders.sql").write_text("select * from raw_events where amount > 15\n")
    (models / "mart_orders.sql").write_text("-- key: order_id\nselect order_id, amount * 2 as amount_doubled from stg_orders\n")
    (models / "report_daily.sql").write_text("-- kind: view\nselect order_id from mart_orders\n")
    p = Project(tmp_path, spark)
    p.store.overwrite("analytics.raw_events", spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "order_id long, amount double"))
    return p


@pytest.fixture
def add_row(project, spark):
    return lambda key, amount: project.store.append("analytics.raw_events", spark.createDataFrame([(key, amount)], "order_id long, amount double"))
