import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(k.startswith('op') or k == 'pipeline' for k in [*q, *o]), set(o) <= set(q))"


def run(folder, before=""):
    return subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, capture_output=True, text=True, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, timeout=120)


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "invoicelake"):
        src = f"{ROOT}/{name}"
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if name == "invoicelake" else shutil.copy(src, tmp_path)
    out = run(tmp_path)
    assert out.returncode == 0 and out.stdout.split()[2:] == ["False", "True"] and int(out.stdout.split()[0]) == int(out.stdout.split()[1]) > 45
    (tmp_path / "invoicelake/llm/__pycache__").mkdir(parents=True)  # what a deleted folder may leave
    assert run(tmp_path).stdout == out.stdout and "corpus" not in run(tmp_path).stderr


def test_the_rest_stands_whatever_of_the_corpus_operators_is_deleted(tmp_path):
    """The two folders alone, and with them the pipeline at the top."""
    whole = tmp_path / "repo"
    shutil.copytree(ROOT, whole, ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache"))
    assert (whole / "corpus_pipeline.py").exists() and not (whole / "tests/llm").exists()
    out = run(whole)
    assert out.returncode == 0 and out.stdout.split()[2:] == ["False", "True"] and "corpus" not in out.stderr
    (whole / "corpus_pipeline.py").unlink()
    assert run(whole).stdout == out.stdout


def test_a_missing_library_takes_no_other_query_down():
    out = run(ROOT, "import sys; sys.modules['public_tokenizers'] = None\n")
    assert out.returncode == 0 and out.stdout.split()[2] == "False"
