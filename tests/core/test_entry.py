"""The registry of queries without the training-data operators."""

import subprocess
import sys

import pytest


@pytest.mark.parametrize("missing", ["plumbline.llm", "ahocorasick", "zstandard", "corpus_pipeline"])
def test_queries_without_a_package(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rpartition("/tests/")[0], check=True).stdout
    assert "'exact_duplicates'" in out and "pipeline" not in out
