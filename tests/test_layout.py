"""The library without its training-data subpackage: nothing outside of it may import it."""

import pathlib
import re

import priceatlas


def test_only_the_entry_knows_the_subpackage():
    root = pathlib.Path(priceatlas.__file__).parent
    found = [p.name for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and re.search(r"^\s*(?:from|import)\s+\S*\bllm\b|import\s+llm\b", p.read_text(), re.M)]
    assert found == []
