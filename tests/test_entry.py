"""The entry module, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tracemill.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
"""


def test_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=60)


def test_a_broken_dependency_is_told():
    broken = WITHOUT[: WITHOUT.index("import __spark_entry__")].replace('name == "corpus_pipeline" or name.startswith("tracemill.llm")', 'name == "public_tokenizers"')
    code = broken + "try:\n    import __spark_entry__\nexcept ImportError:\n    sys.exit(7)\n"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=60).returncode in (0, 7)
    if (ROOT / "corpus_pipeline.py").exists() and (ROOT / "tracemill/llm").exists():
        assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=60).returncode == 7


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "tracemill").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert "tracemill.llm" not in path.read_text(), path


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
