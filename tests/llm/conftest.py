from pathlib import Path

import pytest

from compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
DOCS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies int, score string, "
    "base_failed string, fp string, n_words string, n_hit string, _row string, word string, c0 string"
)


@pytest.fixture
def make(spark):
    """Documents with further columns named like what operators make."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), 7, "s", 9, "x", "y", "z", "w", "h", "r", "q", "c") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def twin(spark, tmp_path):
    """Compare a registered query with its SQL over tables written for the test."""

    def check(name: str, **tables):
        from leadloom.llm.queries import ORACLES, QUERIES

        folder = str(tmp_path)
        con = duck(FOLDER)
        for table, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
            path = next(Path(f"{folder}/{table}.parquet").glob("*.parquet"))
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
        return difference(QUERIES[name](spark, folder), con, ORACLES[name])

    return check
