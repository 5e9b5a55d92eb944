import random
import re

import pytest
from pyspark.sql import types as T

#: Columns of documents, and others whose names the operators use inside.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("set_key", "cls", "h", "y", "rank", "part", "n_words", "grp", "seeds", "shard", "item_id", "toxic", "count", "bucket")]
)
EXTRA = len(SCHEMA) - 5


def words(text):
    """Words of ASCII and Latin texts, as the operators see them."""
    return re.findall(r"[0-9A-Za-z_À-ÖØ-öø-ɏ]+", (text or "").lower())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def make_rows():
    rng = random.Random(7)
    rows = []
    for i in range(40):
        rows.append((i, prose(rng, rng.choice([1, 2, 3, 20, 80, 200, 400]), 3000), "en", f"s{i % 3}"))
    for i in range(40, 60):  # near copies at many distances
        rows.append((i, edited(rng, rows[i - 40][1], rng.choice([0.0, 0.02, 0.05, 0.1, 0.2, 0.4])), "en", "s0"))
    passage = prose(rng, 70, 3000)
    for i in range(60, 68):  # a passage that many documents share
        rows.append((i, f"{prose(rng, 60, 3000)} {passage} {prose(rng, 60, 3000)}", "de", "hot"))
    rows += [(70, "Ä Ö Ü ß", "de", "s1"), (71, "", "en", "s1"), (72, None, "en", "s1"), (73, "?! ...", "en", None), (None, rows[5][1], "en", "s1"), (None, None, None, None), (75, "one", "en", "s1"), (76, "one", "en", "s1")]
    rows += [(77, rows[6][1], None, "s2"), (77, rows[6][1], None, "s2"), (78, prose(rng, 30000, 5000), "en", "s2"), (79, "x" * 200000, "en", "s2"), (80, "same " * 300, "en", "s2"), (81, "same " * 300, "en", "s2")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["clash"] * EXTRA) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, docs):
    schema = "doc_id long, quality int, toxic int, h string, y string, text string"
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0), "c", "c", "c") for i in range(60)] + [(None, 1, 1, None, None, None), (61, None, None, None, None, None), (62, 7, 7, "c", "c", "c")], schema)
