from pathlib import Path

import pytest

from kinfold import runtime


def test_settled_tables_are_kept_then_swept(spark):
    runtime.sweep(spark)
    a, b = runtime.settle(spark.range(5), "a"), runtime.settle(spark.createDataFrame([], "x int"), "b")
    assert a.count() == 5 and b.count() == 0 and b.columns == ["x"]
    path = Path(a._settled_at.removeprefix("file:").replace("//", "/"))
    assert path.exists() and str(path).startswith(runtime.shared_dir(spark).removeprefix("file:").replace("//", "/"))
    runtime.discard(a)
    assert not path.exists() and runtime.sweep(spark) == 1


def test_tidy_deletes_all_but_what_is_kept(spark):
    runtime.sweep(spark)
    with runtime.tidy(spark) as keep:
        runtime.settle(spark.range(2), "gone")
        kept = keep(runtime.settle(spark.range(3), "kept"))
    assert kept.count() == 3 and runtime.sweep(spark) == 1


def test_no_folder_of_its_own_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())
    for master in ("local-cluster[3,2,1024]", "yarn"):
        Context.master = master
        with pytest.raises(RuntimeError):
            runtime.shared_dir(Session())
