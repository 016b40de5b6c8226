import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SF_DIR = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    """(doc_id, text) in order."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


def long_text(words):
    return " ".join(f"w{i * i % 9973}" for i in range(words))


@pytest.fixture(scope="session")
def odd_pairs():
    """Ids in order, texts that are null, empty, blank, tiny, huge, repeating and alike."""
    base = long_text(60)
    near = base.replace("w4 ", "changed ", 1)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, "One"),
        (6, base),
        (7, near),
        (8, base),
        (9, "again and " * 80),
        (10, long_text(20_000)),
        (11, "été naïve — ñandú 😀 " + base[:150]),
        (12, "12 34 ; 56"),
        (13, base.upper()),
        (14, "ha " * 23),
    ]


#: Columns with the names that operators use inside or return.
CLASHING = "gain known id mark spans score items n_words n_removed kept bucket block part tail fingerprint root center word n lang_pred _mark k1 _k1 _gain _id _sure _part _key _row start mask prefix bits".split()


@pytest.fixture(scope="session")
def odd(spark, odd_pairs):
    from pyspark.sql import functions as F

    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in odd_pairs]
    return spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="session")
def messy(odd):
    """Rows repeated whole, an id with two texts, and rows without id."""
    from pyspark.sql import functions as F

    null_id = odd.where("doc_id in (4, 6)").withColumn("doc_id", F.lit(None).cast("long"))
    other = odd.where("doc_id = 9").withColumn("doc_id", F.lit(6).cast("long"))
    return odd.union(odd.where("doc_id in (1, 6, 9)")).union(null_id).union(other)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def by_id(frame, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in frame.select("doc_id", *columns).collect()}
