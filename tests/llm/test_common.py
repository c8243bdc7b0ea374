"""The shared folder, written tables, and tasks that fail once."""

import os
import subprocess
import sys

import pytest

from tessera.llm import common

ROOT = __file__.rsplit("/tests/", 1)[0]


class Session:
    """As much of a session as ``shared_dir`` asks."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})


def test_shared_folder():
    assert common.shared_dir(Session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert common.shared_dir(Session("local[8]", None)).endswith("tessera-shared")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(master, None))


def test_scratch_deletes_what_it_wrote(spark):
    with common.scratch(spark) as keep:
        inner, gone = common.written_at(spark.range(5), "inner")
        outer, stays = keep(inner, "outer")
        assert os.path.exists(gone)
    assert not os.path.exists(gone) and outer.count() == 5
    common.discard(spark, [stays])
    assert not os.path.exists(stays)
    _, last = common.written_at(spark.range(1), "last")
    common.discard(spark)
    assert not os.path.exists(last)


FAILS_ONCE = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tessera.llm import common, language_id, packing, secrets, simhash, token_counts

lean = common.lean


def failing(run):
    def once(batches):
        task = TaskContext.get()
        rows = iter(run(batches))
        for batch in rows:
            yield batch
            if task.attemptNumber() == 0 and task.partitionId() % 2 == 0:
                raise RuntimeError("a task that fails behind its first batch")
        if task.attemptNumber() == 0 and task.partitionId() % 2 == 0:
            raise RuntimeError("a task that fails")

    return lean(once)


spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
docs = spark.read.parquet(sys.argv[1] + "/documents.parquet").where("doc_id < 60").repartition(3, "doc_id")
model = language_id.train(docs)
runs = {
    "token_counts": lambda: token_counts.token_counts(docs), "packing": lambda: packing.pack(docs), "secrets": lambda: secrets.secrets(docs), "simhash": lambda: simhash.near_duplicates(docs, similarity=0.8), "languages": lambda: language_id.predict(docs, model),
}
good = {name: sorted(map(str, f().collect())) for name, f in runs.items()}
common.lean = simhash.lean = language_id.lean = failing
for name, f in runs.items():
    assert sorted(map(str, f().collect())) == good[name], name
print("equal")
"""


def test_results_are_the_same_when_tasks_fail_once(sf):
    done = subprocess.run([sys.executable, "-c", FAILS_ONCE, sf], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("equal"), done.stderr[-2000:]
