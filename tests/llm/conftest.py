import pytest

pytest.importorskip("gatescan.llm.queries")
