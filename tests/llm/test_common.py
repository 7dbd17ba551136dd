"""Caches of Python workers between tasks, and the shared folder."""

import functools
from types import SimpleNamespace

import pytest

from convlake.llm import common


def test_caches_stay_for_their_own_kind_of_task_only():
    @functools.partial(common.lean, keeps="words")
    def own(batches):
        kept = common.CACHES.setdefault("words", {})
        for b in batches:
            kept[b] = True
            yield len(kept)

    other = common.lean(lambda batches: batches)
    assert list(own("ab")) == [1, 2]
    assert list(own("c")) == [3]
    assert list(other("xy")) == ["x", "y"]
    assert common.CACHES == {}
    assert list(own("a")) == [1]
    assert list(other([])) == []
    assert common.CACHES == {}


def test_powers_are_made_anew_after_a_release():
    before = common.powers(1000)[0][:1000].copy()
    common.release()
    assert (common.powers(1000)[0][:1000] == before).all()


def session(master: str, **conf: str):
    """The settings of a session alone."""
    own = dict(conf)
    settings = SimpleNamespace(get=lambda k, d=None: own.get(k, d), set=own.__setitem__)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=settings)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session(master))
    assert common.shared_dir(session(master, **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"


def test_local_mode_takes_a_temporary_folder_once():
    local = session("local[4]")
    assert common.shared_dir(local).startswith("file:///")
    assert common.shared_dir(local) == common.shared_dir(local)
