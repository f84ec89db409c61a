import pytest

from skyloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")), spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
