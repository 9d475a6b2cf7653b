"""Tables in the shared folder go when they are no longer needed."""

import os

import pytest

import __spark_entry__ as entry
from tandem.llm import _common

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_link_graph_url_filter", "op11_resident_lloyd", "op12_credential_links", "op13_hilbert_zone_clusters"])
def test_nothing_is_left(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(_common, "shared_dir", lambda _: f"file://{tmp_path}")
    assert entry.queries()[name](spark, DATA).count()
    left = os.listdir(tmp_path)
    assert left and not [x for x in left if x.startswith(("owners", "mail"))]  # each round's tables are gone already
    _common.clear(spark)
    assert os.listdir(tmp_path) == []


class Session:
    """As much of a session as the choice of a folder reads."""

    def __init__(self, master, folder):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, self
        self.master, self.applicationId, self.setCheckpointDir = master, f"app-{master}", lambda _: None


def test_folder_is_the_clusters(monkeypatch):
    monkeypatch.setattr(_common, "_local", {})
    assert _common.shared_dir(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="share"):
        _common.shared_dir(Session("local-cluster[3,2,100]", None))
    own = _common.shared_dir(Session("local[2]", None))
    assert own.startswith("file://") and own == _common.shared_dir(Session("local[2]", None))
