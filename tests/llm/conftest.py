import random

import pytest

WORDS = [a + b for a in ("tha", "on", "er", "ing", "re", "st", "ou", "le") for b in ("nd", "th", "sh", "wa", "ti", "mo", "ka", "zu")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs_rows():
    """Ordinary texts with nulls, empty ones, copies, near copies, repeated rows, odd bytes and a very long one."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(30, None), (31, ""), (32, " \t\n"), (33, base[3]), (34, base[3].replace(" ", "\t ")), (35, base[4] + " tail"), (36, prose(rng, 3000))]
    rows += [(37, rows[36][1] + " more"), (38, "x" * 5000), (39, "é ü ∑ 日本 🤦🏽‍♂️ \x00 ▁"), (40, base[5]), (40, base[5]), (None, base[6]), (None, None)]
    rows += [(41, "A line that is common enough\nother"), (42, " a LINE that is common enough \nmore"), (43, "a line that is common enough"), (44, "\n\n"), (45, base[7] + " " + base[8]), (46, base[8] + " " + base[9])]
    rows += [(47, rows[36][1][:900] + prose(rng, 40)), (48, prose(rng, 20) + rows[36][1][300:1200])]
    return [(i, t, ("s", None, "t")[k % 3], "en", k) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns named like those that operators use within."""
    from pyspark.sql import functions as F

    names = ["row", "id", "key", "h", "norm", "rep", "score", "kept", "keep_id", "size", "taken", "target", "shard", "order", "node", "component", "component_id", "spans", "body", "same", "given", "media", "_text", "token_ids", "label", "label_id", "src", "end", "t", "n"]
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def small_dir(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, none, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    none.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)
