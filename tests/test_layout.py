"""The core stands without the llm subpackage, and the entry point offers every query."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_llm():
    for f in (ROOT / "ligature").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(encoding="utf-8"), re.M), f


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["p3_found"] and e.queries()["p4_found"]


def test_no_local_checkpoint():
    for f in (ROOT / "ligature").rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(encoding="utf-8")
