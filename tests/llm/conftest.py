import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size string, ahead int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (text, lang, source) as documents with extra columns whose names clash with the operators' own."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (r, "en", "a") for r in rows]
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), True, 0.5, "x", 1) for i, (t, lang, s) in enumerate(rows)], DOCS)

    return make


ODD = [None, "", " ", "\n", "a", "a  b\n\n c ", "x" * 20000, "two words", "two words", "ünï çödé ▁ of it", "<s> </s> <|endoftext|> it's 12:30 \t\r\x0b end", "word " * 3000]


@pytest.fixture(scope="session")
def odd():
    return ODD
