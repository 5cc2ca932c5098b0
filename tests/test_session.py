"""Checkpoint folder rules: read the cluster's setting, never invent a
machine-local folder on a cluster."""

import pytest

from cohortlens.session import checkpoint_root


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, conf):
        self.conf = _Conf(conf)
        self.sparkContext = _Context()


def test_configured_shared_folder_is_used():
    s = _Session({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://nn/ckpt/"})
    assert checkpoint_root(s) == "hdfs://nn/ckpt"
    assert s.sparkContext.dir == "hdfs://nn/ckpt/"


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_Session({"spark.master": "yarn"}))


def test_local_without_setting_gets_a_scratch_folder():
    s = _Session({"spark.master": "local[4]"})
    root = checkpoint_root(s)
    assert root and s.conf.get("spark.checkpoint.dir") == root and s.sparkContext.dir == root
