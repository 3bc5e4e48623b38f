import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_the_engine_does_not_import_the_corpus_operators():
    for path in (ROOT / "quarrylight").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quarrylight").parts:
            assert not re.search(r"^\s*(from|import) quarrylight\.llm", path.read_text(), re.M), path


def test_no_local_checkpoints():
    for path in ROOT.rglob("*.py"):
        if "tests" not in path.relative_to(ROOT).parts:
            assert "local" + "Checkpoint" not in path.read_text(), path
