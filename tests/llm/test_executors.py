"""Executors that have no copy of the package run every kind of operator."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys; sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from newsloom.session import build_session
spark = build_session(cpus=2, shuffle=4)
def probe(batches):
    for b in batches:
        try:
            import newsloom
            b["id"] = -1
        except ImportError:
            pass
        yield b
assert spark.range(1).mapInPandas(probe, "id long").first()[0] == 0
for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_mix", "p9_found", "story_clusters", "html_anchors"):
    assert entry.queries()[name](spark, {data!r}).count() >= 0, name
"""


def test_without_a_copy(tmp_path, data):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
