import pytest

import __spark_entry__
from marginalia import tables


class Cluster:
    """What ``shared_folder`` asks a session on a cluster for."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        tables.shared_folder(Cluster)


def test_a_local_session_gets_a_folder(spark):
    assert tables.settle(spark.range(3)).count() == 3


def test_every_query_with_sql_exists():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
