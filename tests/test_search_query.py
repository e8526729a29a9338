from types import SimpleNamespace

from checks import queries
from sentilake.config import TrainConfig


def test_the_search_query_runs_with_the_operators_settings(monkeypatch):
    seen = {}
    jobs = SimpleNamespace(
        build_features=lambda rows, cfg: seen.update(features=cfg), train_and_select=lambda found, cfg: seen.update(train=cfg)
    )
    monkeypatch.setattr(queries, "jobs", jobs)
    monkeypatch.setattr(queries, "corpus", lambda spark, sf: None)
    queries._small_search(None, None)
    assert seen == {"features": queries.DOC_FEATURES, "train": TrainConfig()}


def test_the_entry_loads_without_the_optional_part():
    """A library that only the optional operators need, or the operators themselves, may be missing."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(queries.__file__).resolve().parents[1])
    for gone in ("zstandard", "sentilake.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'clean_text' in e.queries())"
        said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
        n, core = said.stdout.split()
        assert core == "True" and int(n) >= len(queries.QUERIES), said.stderr
        assert "left out" in said.stderr
