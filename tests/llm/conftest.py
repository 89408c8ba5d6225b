import pytest

pytest.importorskip("lodestar.llm")
