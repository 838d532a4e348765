import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout) >= 70


def test_only_the_entry_knows_the_corpus_operators():
    for path in (ROOT / "engramma").rglob("*.py"):
        if "llm" not in path.parts:
            assert "engramma.llm" not in path.read_text(), path


def test_flagship(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.columns == ["query_id", "rank", "id", "sim", "score"] and got.count() > 0
