import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def word(rng):
    return "".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7)))


@pytest.fixture(scope="session")
def rows():
    """Small documents with copies, near copies, blanks, nulls in every column, a long text and odd characters."""
    rng = random.Random(11)
    base = [" ".join(word(rng) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts = list(base)
    texts += base[:10] + [t.replace(" ", "\n", 3) for t in base[10:15]]  # copies up to white space
    for t in base[15:30]:  # near copies
        words = t.split(" ")
        words[rng.randrange(len(words))] = word(rng)
        texts.append(" ".join(words))
    texts += ["", " ", "\t\n", None, None, "a", "A", "one two three four", "x" * 3000, "1234 !!", "  lead", "trail  ", "two  spaces"]
    texts.append(" ".join(word(rng) for _ in range(4000)))
    texts += ["it's the end. It’s <|endoftext|> here", "tab\there\r\nand\x0bthere", "\U0001f600 日本 本's ſ K \U0001dffd's"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


#: Columns with names that the operators use inside.
CLASHING = ("_h", "_row", "_text", "_tie", "_lane", "_hash", "n", "id", "token", "ids", "score", "bits", "lang_pred", "_sha", "_n", "word", "held_out", "_position", "_source", "prefix", "a.b", "tie", "comp")


@pytest.fixture(scope="session")
def clashing(docs):
    return docs.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def nameless(spark, rows):
    """Rows without an id, and an id that two rows with equal and two with different texts repeat."""
    some = [(None, rows[0][1], "en", "a", 1), (None, None, None, None, None), (7, "same words here", "en", "a", 1), (7, "same words here", "en", "a", 1)]
    return spark.createDataFrame([*some, (7, "other words", "de", "b", 1), (9, "same words here", None, None, None)], SCHEMA)


def dicts(df):
    return [r.asDict() for r in df.collect()]
