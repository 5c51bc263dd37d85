import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to the old river bank"
#: (doc_id, text, lang, source): NULLs in every column, empty and blank texts, a very long one, copies, repeated rows.
HOSTILE = [
    (1, BASE, "en", "a"), (2, BASE, "en", None), (2, BASE, "en", None), (3, None, None, "a"), (4, None, "en", "b"),
    (5, "", "en", "b"), (6, " \t\n ", None, "b"), (7, LONG, "en", "a"), (8, LONG + " end", "en", "c"),
    (None, "a row without id", "en", "c"), (None, BASE, None, None), (9, "one", "fr", "c"), (10, "two words", "fr", "a"),
    (11, BASE.upper(), "en", "b"), (12, "▁ mark  and  spaces\x0b\x0c é 日本 😀\r\n\x00", "ja", "b"), (9, "one again", "fr", "c"),
    (-5, BASE + " again", "de", "z"), (13, "12 34 !!", "de", "é"),
]
#: Names that operators use inside or give to their results.
CLASHES = ["id", "kept", "keep_id", "row", "h1", "sha", "size", "shard", "tie", "key", "target", "n", "sig", "d1", "_part", "ids",
           "score", "quality", "component", "_often", "lang_pred", "place", "a.b", "KEPT2"]


@pytest.fixture(scope="session")
def hostile(spark):
    df = spark.createDataFrame(HOSTILE, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"v-{c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(hostile):
    return hostile.limit(0)
