"""Write docs/API.md from the docstrings: python scripts/make_api.py"""

from __future__ import annotations

import importlib
import inspect
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

MODULES = """functions.columns sources.runs sources.listing sources.manifest sources.text sources.locators sources.catalog
sources.state operators.filters operators.runs operators.checksum operators.catalog operators.progress operators.upload
operators.scan plans.resume sinks.tables sinks.writers streaming.streams session""".split()


def first(doc: str | None) -> str:
    return " ".join((doc or "").strip().split("\n\n")[0].split())


def main() -> None:
    out = ["# API reference", "", "Generated from the docstrings (first paragraph of each public function).", ""]
    for name in MODULES:
        module = importlib.import_module(f"tidemark.{name}")
        out += [f"## `tidemark.{name}`", "", first(module.__doc__), ""]
        for k, f in sorted(vars(module).items()):
            if not k.startswith("_") and inspect.isfunction(f) and f.__module__ == module.__name__:
                out.append(f"* `{k}{inspect.signature(f)}` — {first(f.__doc__)}")
        out.append("")
    with open(os.path.join(ROOT, "docs/API.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
