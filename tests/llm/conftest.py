from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))

from echograph.llm.shipping import importable  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

#: Texts every operator must take: null, empty, blank, repeated, one very long, odd characters.
ODD_TEXTS = [
    None,
    "",
    " \n\t\r\n ",
    "One two three.",
    "One two three.",
    "word",
    "naïve Éa ß 中文 😀    x\x00y\x1f.",
    "The same line of words is here.\nThe same line of words is here.\n",
    "long " * 60_000 + "end.",
    "x" * 300_000,
]


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text, source) rows, with columns whose names operators use themselves."""
    importable(spark)

    def make(rows, extra: bool = True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, schema)
        if extra:
            df = df.selectExpr("*", "'a' AS id", "1 AS size", "true AS kept", "2 AS target", "'z' AS node", "0 AS row", "'h' AS held", "3 AS n", "4 AS start")
        return df

    return make


@pytest.fixture
def odd(documents):
    """Odd texts; repeated, null and negative ids; null sources."""
    rows = [(i, t, ["a", None, "b"][i % 3]) for i, t in enumerate(ODD_TEXTS)]
    return documents([*rows, (3, "One two three.", "a"), (None, "No id here at all.", None), (None, None, None), (-7, "Minus seven.", "a")])


def plain_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
