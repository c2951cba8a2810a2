import builtins
import importlib
import sys
import warnings

import pytest


def test_the_core_stands_without_libraries_of_the_rest(monkeypatch):
    real = builtins.__import__

    def missing(name, *args, **kw):
        if name.split(".")[0] == "tiktoken":
            raise ModuleNotFoundError("No module named 'tiktoken'", name="tiktoken")
        return real(name, *args, **kw)

    for m in [m for m in sys.modules if m == "tiktoken" or m.startswith("quaymark.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", missing)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        q = entry.queries()
    assert "p2_found" in q and "p7_ids" not in q and set(entry.oracle_sql()) <= set(q)
    monkeypatch.undo()
    importlib.reload(entry)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from quaymark import session

    class Conf:
        def get(self, key, default=None):
            return None

    class Dir:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Dir()})()})()
        getConf = lambda self: Conf()  # noqa: E731, N815

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())
