from unittest.mock import MagicMock

import pytest

from dealtide.llm import cluster


def session(local: bool, defined: bool) -> MagicMock:
    spark = MagicMock()
    context = spark.sparkContext._jsc.sc.return_value
    context.isLocal.return_value = local
    context.getCheckpointDir.return_value.isDefined.return_value = defined
    context.getCheckpointDir.return_value.get.return_value = "hdfs://shared"
    return spark


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.shared_folder(session(local=False, defined=False))
    assert cluster.shared_folder(session(local=False, defined=True)) == "hdfs://shared"
    alone = session(local=True, defined=False)
    cluster.shared_folder(alone)
    alone.sparkContext.setCheckpointDir.assert_called_once()
