"""The word cache of a worker outlives its tasks, and tasks can be sent after one was lent."""

import subprocess
import sys

import public_tokenizers
from pyspark import cloudpickle

from snapweave.llm.tokens import WordCache

WORKER = """
import sys
from pyspark import cloudpickle
for _ in range(3):
    with open(sys.argv[1], "rb") as file:
        print(*cloudpickle.load(file)())
"""


def test_a_worker_keeps_its_cache_from_task_to_task(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")

    def task():
        with WordCache.lent(path) as cache:
            known = len(cache.place)
            return known, cache.encode(["some words here"])[0].tolist() == cache._whole(["some words here"])[0]

    assert task()[1]  # lent here as well: the driver's cache and timer must not travel
    sent = tmp_path / "task"
    sent.write_bytes(cloudpickle.dumps(task, 5))
    done = subprocess.run([sys.executable, "-c", WORKER, str(sent)], capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["0", "True", "3", "True", "3", "True"]
    WordCache.free()
    assert WordCache._kept is None
