"""The entry module works without the training-data operators."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm():
    code = "import sys; sys.modules['granary.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf_top12' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "granary")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    text = f.read()
                assert ".llm" not in text and "import llm" not in text, n
