"""The entry works with and without the optional parts."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_optional_parts(tmp_path):
    shutil.copytree(f"{REPO}/countloom", tmp_path / "countloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{REPO}/jobs", tmp_path / "jobs")
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'm10_code_length_k32' in q and 'job1_count_matrix' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120).returncode == 0


def test_without_tokenizer_files(tmp_path):
    """The rest works where the package of vocabularies is missing."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'm10_code_length_k32' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": REPO}, timeout=120).returncode == 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 3 and all(r["total_bits"] > 0 for r in rows)
