"""Intermediates: written once, read again, deleted on demand."""

from pathlib import Path

import pytest

from lodestar import storage


def test_release(spark):
    kept = storage.durable(spark.range(5), "gone")
    assert kept.count() == 5
    path = Path(storage._WRITTEN[spark.sparkContext.applicationId][-1].removeprefix("file:"))
    assert path.is_dir() and storage.release(spark) >= 1 and not path.exists() and storage.release(spark) == 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
