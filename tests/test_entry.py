import builtins
import importlib
import sys

import __spark_entry__


def test_queries_survive_a_missing_module(monkeypatch):
    """Without a package that only the llm part needs, all other queries stay."""
    real = builtins.__import__

    def block(name, *args, **kw):
        if name.split(".")[0] in ("ahocorasick", "tiktoken") or name.startswith("quernstone.llm"):
            raise ImportError(name)
        return real(name, *args, **kw)

    for m in [m for m in sys.modules if m.startswith("quernstone.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", block)
    monkeypatch.setattr(importlib, "import_module", lambda n: block(n) if "llm" in n else sys.modules.get(n) or real(n, fromlist=["x"]))
    assert "p1_found" in __spark_entry__.queries() and "p5_found" in __spark_entry__.oracle_sql()
    assert not any(q.startswith(("p6", "p7", "p8")) for q in __spark_entry__.queries())
