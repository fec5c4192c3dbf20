import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use themselves
          "score double, predicted int, fp long, rep long, votes long, w string, block int, uid long, component_id long, __n int, node long")
LONG = "the quick brown fox jumps over the lazy dog " * 6000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was a fine day.", "en", "a"),
    (2, "the quick  brown\tfox jumps over the lazy dog. it was a fine day.", "en", "a"),   # same words
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "fr", "b"),
    (6, "12 34 !!", "de", "b"),
    (7, LONG, "en", "c"),
    (8, "La maison est très belle, et l'été arrive.\nLa maison est très belle.\nLa maison est très belle.", "fr", None),
    (9, "Licensed under the Apache License, Version 2.0.\nAll rights reserved. CC BY", "en", "d"),
    (1, "The quick brown fox jumps over the lazy dog. It was a fine day.", "en", "a"),      # a repeated row
    (None, "a row without an id", "en", "a"),
    (10, "x" * 3000 + " <|endoftext|> y</s>[INST]", None, "e"),
    (11, "emoji 😀😀 日本語 é́ \x1c\x85  　 z", "en", "e"),
    (12, "one", "en", "e"),
    (13, "one two", "en", "e"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    return spark.createDataFrame([(*t, None if t[1] is None else len(t[1]), 0.5, 1, 1, 1, 1, "w", 1, 1, 1, 1, 1) for t in TEXTS], SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [t[1] for t in TEXTS]


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
