from __future__ import annotations

import duckdb
import pytest

TESTDATA = "/root/testdata"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")

#: Names that operators use for columns of their own.
CLASHING = (
    "doc id score kept word key n copies token _spans text_ found copy n_copies position _rank shard slot size "
    "piece start length ids sequence_id offset window letters held_out rank _sub _n crc u v m root node"
).split()


@pytest.fixture(scope="session")
def rows_of_sql():
    """``rows_of_sql(scale, sql)``: columns and rows that DuckDB gives."""

    def rows(scale: str, sql: str) -> tuple[list[str], list[tuple]]:
        with duckdb.connect() as connection:
            for name in TABLES:
                connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/sf{scale}/{name}.parquet'")
            result = connection.execute(sql)
            return [d[0] for d in result.description], result.fetchall()

    return rows


@pytest.fixture
def documents(spark):
    """A frame of (id, text) rows, with columns whose names could clash."""

    def make(rows):
        fields = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(
            f"{name} int" for name in CLASHING
        )
        return spark.createDataFrame([(i, t, "x", "en", 0, *([7] * len(CLASHING))) for i, t in rows], fields)

    return make


#: Texts that a corpus holds sooner or later.
ODD = [
    (None, "a row without an id"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "word"),
    (5, "word"),
    (6, "one two three four five six " * 20_000),
    (7, "x" * 200_000),
    (8, "Größe ñandú 東京 \U0001f600 <|endoftext|> & < >"),
]
