import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size bigint, cell bigint"

WORDS = "the of and house river stone to in a light green walk over was with night"


def _texts() -> list[str | None]:
    import random

    rng = random.Random(3)
    words = WORDS.split()
    base = [" ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n)) for n in (1, 2, 3, 12, 60, 150, 400)]
    near = []
    for text in base[4:]:
        for changes in (1, 2, 4, 12):
            parts = text.split()
            for _ in range(changes):
                parts[rng.randrange(len(parts))] = "changed"
            near.append(" ".join(parts))
    odd = [None, "", "   ", "\n\n", "a", "A", "a b", "x" * 50_000, "word " * 30_000, "É é ñ ß", "don't <|endoftext|> stop", "tab\tand\x0bline", "1 2 3\n1 2 3\nz"]
    return base + base[:5] + [t.replace(" ", "  ") for t in base] + [t.upper() for t in base] + near + odd


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and long texts, copies, near copies, repeated rows and clashing extra columns."""
    rows = []
    for i, text in enumerate(_texts()):
        source = [None, "b", "a", "src", "é"][i % 5]
        rows.append((i * 3 + 1, text, [None, "en", "de", "xx"][i % 4], source, None, None, None, 7))
    rows += [rows[8], rows[20], rows[20]]
    rows += [(None, "a text without an id", "en", "a", 1, True, 1, 1), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
