"""The entry module, with the corpus operators and without them."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    env = {**os.environ, "PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()


def test_imports_without_the_subpackage(tmp_path):
    (tmp_path / "gridloom").mkdir()
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    for p in (ROOT / "gridloom").iterdir():
        if p.name != "llm" and p.name != "__pycache__":
            (tmp_path / "gridloom" / p.name).symlink_to(p)
    own = names(tmp_path)
    assert len(own) > 50 and not any(n.startswith("op") and n[2].isdigit() for n in own) and "pipeline" not in own
    if (ROOT / "gridloom" / "llm").exists() and (ROOT / "corpus_pipeline.py").exists():
        whole = names(ROOT)
        assert set(own) < set(whole) and "pipeline" in whole
        assert all(sum(n.startswith(f"op{k}_") for n in whole) == 1 for k in range(1, 11))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() == 92 and out.columns == ["cell_id", "n_genes", "total", "pct_mt"]
