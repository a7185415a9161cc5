import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, band string, rep long, node long, kind string, term string, rows long, key string, n long, low string, bin int, id string"


@pytest.fixture
def table(spark):
    """A documents table of (id, text) or (id, text, lang) with columns whose names operators use inside."""

    def of(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), 1, "b", 2, 3, "k", "t", 4, "y", 5, "l", 6, "i") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "tie one two three four five"), (5, "tie one two three four five"), (None, "tie one two three four five"), (6, "Ünï côde ✓ 漢字 🎵 text"), (7, "12345 !!!")]


@pytest.fixture
def edges(table):
    return table(EDGES)
