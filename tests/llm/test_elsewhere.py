import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from veilspark.llm import queries
for name in {names!r}:
    print("ROWS", name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_without_the_repository(tmp_path):
    """The driver alone has the repository on its path, and none of its workers stands in its folder."""
    names = ["op3_context_tree", "op4_kneser_ney", "op5_crf_toxicity", "op8_simhash", "op10_greedy_tiling", "op11_collision_counting", "op12_token_alignment", "op13_prefix_trie"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    (tmp_path / "run.py").write_text(SCRIPT.format(repo=str(REPO), names=names))
    run = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert [line.split()[1] for line in run.stdout.splitlines() if line.startswith("ROWS")] == names, run.stderr[-3000:]
