import pytest

from ledgerlens.llm import support


class Context:
    applicationId = "app-0"

    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), conf


def test_a_cluster_needs_a_named_folder():
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            support.shared_folder(Session(master))
        assert support.shared_folder(Session(master, **{"spark.checkpoint.dir": "s3a://shared/x/"})) == "s3a://shared/x"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_one_process_takes_a_temporary_folder(master):
    assert support.shared_folder(Session(master)) == support.shared_folder(Session(master))
