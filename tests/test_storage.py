"""Where intermediate tables go."""

import types

import pytest

from tidewater import storage


def session(master, **conf):
    return types.SimpleNamespace(sparkContext=types.SimpleNamespace(master=master), conf=types.SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError):
        storage.shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(session("local-cluster[2,1,1024]"))
    assert storage.shared_dir(session("spark://host:7077", spark_checkpoint_dir="hdfs:///c")) == "hdfs:///c"
    assert storage.shared_dir(session("local[4]")).startswith("file:///")
