import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, id string, key string, size string"


def words(random_, n, size=400):
    return [f"w{random_.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, shared passages, null and empty fields, odd white space, ties and repeated rows."""
    r = random.Random(5)
    passage = " ".join(words(r, 70))
    texts = {}
    for i in range(40):
        texts[i] = " ".join(words(r, r.choice([3, 30, 200])))
    for i in range(40, 60):
        texts[i] = " ".join(words(r, 20)) + "\n" + passage + "  " + " ".join(words(r, 20))
    texts[60] = texts[61] = texts[5]
    texts[62] = texts[7] + " tail"
    texts[63], texts[64], texts[65], texts[66] = None, "", " \t\n", "é ñ 日本 Ünï 123 !!"
    texts[67] = "a " * 700
    texts[68] = "x" * 1000
    texts[69] = " ".join(words(r, 6000, 5000))
    langs, sources = ["en", "fr", None], ["s1", "s0", None, "s2"]
    made = [(i, t, langs[i % 3], sources[i * i % 4], len(t or "")) for i, t in texts.items()]
    made += [made[20], made[20], (None, texts[30], "en", "s1", 1), (None, None, None, None, None)]
    return [(*row, "c", "i", "k", "s") for row in made]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
