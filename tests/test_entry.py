import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

REPO = Path(__file__).resolve().parents[1]


def test_flagship_and_registries(spark):
    df = e.entry(spark)
    assert df.columns == ["recording_id", "muscle_frame_id", "behavior_frame_id", "x_pos_mm", "y_pos_mm"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_stands_without_text_operators(tmp_path):
    """As if their folder and the pipeline were deleted."""
    (tmp_path / "rigtables").mkdir()
    for p in (REPO / "rigtables").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "rigtables" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); print(len(e.queries()))"
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 60, out.stderr


def test_nothing_else_imports_the_text_operators():
    for p in (REPO / "rigtables").rglob("*.py"):
        if "llm" not in p.parts:
            assert "rigtables.llm" not in p.read_text(), p
