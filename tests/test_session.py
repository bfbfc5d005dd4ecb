"""Where intermediate tables go."""

import os

import pytest

from lexiloom import session


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Cluster:
    """The parts of a session that the folder depends on."""

    def __init__(self, master, folder=None):
        self.conf = Conf({session.CHECKPOINT_KEY: folder} if folder else {})
        self.sparkContext = self
        self.master = master
        self.applicationId = "app"

    def getConf(self):
        return Conf({})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster(master), "x")
    assert session.shared_dir(Cluster(master, "hdfs:///shared/"), "x").startswith("hdfs:///shared/lexiloom-app/x-")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_may_use_its_own_folder(master):
    path = session.shared_dir(Cluster(master), "x")
    assert os.path.isdir(os.path.dirname(os.path.dirname(path))) and path != session.shared_dir(Cluster(master), "x")


def test_stored_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_application_folder", lambda spark: str(tmp_path / "own"))
    (tmp_path / "other").mkdir()
    assert session.stored(spark.range(5), "five").count() == 5
    assert sorted(os.listdir(tmp_path)) == ["other", "own"]
    session.drop_stored(spark)
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["other"]
