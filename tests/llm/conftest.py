import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, start string, size string, component_id string, score string, fingerprint string, rank string"
LONG = "word " * 60_000


def rows_of(pairs):
    return [(i, t, lang, src, None if t is None else len(t), "a", "b", "c", "d", "e", "f") for i, t, lang, src in pairs]


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows, and columns named like results."""
    base = [(1, "The cat sat on the mat and looked at the dog.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n ", "fr", "b"), (5, LONG, "en", "a"),
            (None, "no id at all here", "en", None), (7, "Le chat est sur la table et le chien dort.", "fr", "b"), (7, "Le chat est sur la table et le chien dort.", "fr", "b"), (9, "12345 ???", None, "é"),
            (10, "the cat sat on the mat and looked at the dog.", "en", "b"), (11, "<|endoftext|> ! \x1c a  b\n\n c d", "en", "a")]
    return spark.createDataFrame(rows_of(base), DDL)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)
