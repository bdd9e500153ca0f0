import pytest

from strata.session import CHECKPOINT_CONF, scratch_dir, shared_root


def test_shared_root_uses_the_session_setting(spark):
    named = spark.conf.get(CHECKPOINT_CONF)
    root = shared_root(spark)
    assert root.replace("file:", "").startswith(named.replace("file:", ""))


def test_scratch_dirs_are_fresh(spark):
    a, b = scratch_dir(spark, "run"), scratch_dir(spark, "run")
    assert a != b and a.startswith(shared_root(spark).rstrip("/"))


class _Session:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.sparkContext = self.conf = self
        self.master, self.named = master, {}

    def getCheckpointDir(self):
        return self.named.get("dir")

    def setCheckpointDir(self, path):
        self.named["dir"] = path

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.named.get(key, default)

    def set(self, key, value):
        self.named[key] = value


def test_without_a_named_folder_only_local_mode_gets_one():
    assert shared_root(_Session("local[2]"))
    with pytest.raises(ValueError, match="share"):
        shared_root(_Session("spark://host:7077"))
