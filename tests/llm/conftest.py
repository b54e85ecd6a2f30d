import pytest

#: doc_id, text, lang, source, n_chars and a column whose name operators use inside.
ODD = [
    (1, "The same text, twice.", "en", "a", 21, 0),
    (2, "the SAME text, twice.", "en", "a", 21, 0),
    (3, None, "en", None, None, 0),
    (4, "", None, "b", 0, 0),
    (5, "   \n\t ", "fr", "b", 6, 0),
    (6, "word " * 5000, "en", "c", 25000, 0),
    (7, "Déjà vu – naïve  façade\n\n it's 3rd 42 <|endoftext|>  x\x1cy", "fr", "c", 0, 0),
    (7, "Déjà vu – naïve  façade\n\n it's 3rd 42 <|endoftext|>  x\x1cy", "fr", "c", 0, 0),
    (None, "no id here, but a text", "en", "d", 22, 0),
    (8, "a b c d e f g " * 30 + "\nLine one.\nLine one.\n", "de", "d", 0, 0),
    (9, "#*$ & | <> %", "es", "é", 12, 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
