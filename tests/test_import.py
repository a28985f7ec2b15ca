import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, cwd=HERE):
    return subprocess.run(
        [sys.executable, "-B", "-c", code], cwd=cwd, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": cwd}
    )


def test_entry_imports_without_a_session():
    out = run("import __spark_entry__ as e; assert len(e.queries()) > 100; assert set(e.oracle_sql()) <= set(e.queries())")
    assert out.returncode == 0, out.stderr


def test_the_engine_stands_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(f"{HERE}/quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    out = run(
        "import __spark_entry__ as e; assert 'q_literal_lines' in e.queries() and not any(n.startswith('op') for n in e.queries())",
        str(tmp_path),
    )
    assert out.returncode == 0, out.stderr
