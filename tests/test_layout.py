"""The library stands without its llm subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evispark.functions.vectors import encode_with, hash_vectors
from evispark.operators.index import embed
from evispark.operators.retrieval import rerank
from evispark.scratch import new_path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for p in (ROOT / "evispark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M), p


def test_the_entry_works_without_llm():
    code = (
        "import sys\n"
        "sys.modules['evispark.llm'] = None\n"
        "sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "q, o = e.queries(), e.oracle_sql()\n"
        "assert len(q) > 40 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_a_missing_package_is_not_hidden():
    code = "import sys\nsys.modules['sentencepiece'] = None\nimport __spark_entry__\n"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    if (ROOT / "evispark" / "llm").exists() and (ROOT / "corpus_pipeline.py").exists():
        assert done.returncode and "sentencepiece" in done.stderr
    else:
        assert not done.returncode


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1024]", "yarn", None])
def test_a_cluster_needs_a_shared_folder(master):
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": master}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        new_path(Session(), "x")


def test_encoders_and_scorers_plug_in(spark):
    chunks = spark.createDataFrame([("a", "some text"), ("b", None)], "chunk_id string, text string")
    mine = embed(chunks, encoder=lambda c: encode_with(lambda: lambda texts: hash_vectors(texts, 8), c)).collect()
    assert [len(r.vector) for r in mine] == [8, 8]
    candidates = spark.createDataFrame([(1, "q", "long text", 1), (1, "q", "t", 2), (1, "q", "u", 3)], "query_id long, query string, text string, fused_rank int")
    top = rerank(candidates, 2, scorer=lambda q, t: -F.length(t).cast("double")).orderBy("rank").collect()
    assert [r.text for r in top] == ["t", "u"]
