"""The shared folder: a cluster must name one."""

import pytest

from arrayflow.session import shared_dir


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), Conf(conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_cluster_must_name_a_folder(master):
    with pytest.raises(ValueError):
        shared_dir(Session(master))
    named = Session(master)
    named.conf["spark.checkpoint.dir"] = "hdfs://shared/ck"
    assert shared_dir(named) == "hdfs://shared/ck" and named.sparkContext.folder == "hdfs://shared/ck"


def test_one_machine_may_leave_it_unset():
    assert shared_dir(Session("local[4]"))
