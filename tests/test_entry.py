"""The driver's contract, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["row_id", "amount", "deleted", "source_lsn"]


def test_imports_without_the_corpus_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name in ("tidemark", "__spark_entry__.py"):
            src = os.path.join(ROOT, name)
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1') or k == 'pipeline' for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "tidemark.llm" not in text.read(), f
