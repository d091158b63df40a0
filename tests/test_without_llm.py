import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    shutil.copytree(f"{REPO}/shelfmark", tmp_path / "shelfmark", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
        (tmp_path / "shelfmark/llm/__pycache__").mkdir(parents=True, exist_ok=True)  # what a deleted folder may leave
