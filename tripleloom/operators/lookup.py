"""Looking keys up in a dictionary without gathering a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Tasks over which the rows of one key are spread where the dictionary is too large to be sent to all executors.
SALTS = 32


def measured_bytes(frame: DataFrame) -> int:
    """Size of a frame as the optimizer knows it; of a stored table, from its files."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _sendable_bytes(frame: DataFrame) -> int:
    """Up to which size Spark sends a side of a join to all executors; -1 if never."""
    return frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def look_up(rows: DataFrame, key: Column, dictionary: DataFrame, word: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``dictionary`` but its unique ``word``; nulls where ``key`` is null or unknown.

    A dictionary that is not known to be small is stored first, so that its size is measured. Up to Spark's own threshold
    it goes to all executors, and the rows stay where they are. Beyond, each word is dealt to ``salts`` copies and each row to one of them, rows without
    a key to none: a word that a third of all rows have lies in many tasks. The rows are read once either way.
    """
    limit = _sendable_bytes(dictionary)
    known = dictionary if measured_bytes(dictionary) <= limit else stored(dictionary, "dictionary")
    names = [name for name in known.columns if name != word]
    keyed = rows.withColumn("_key", key)
    if measured_bytes(known) <= limit:
        return keyed.join(known.withColumnRenamed(word, "_word"), F.col("_key") == F.col("_word"), "left").select(*rows.columns, *names)
    # Maps have no hash.
    spread = F.xxhash64(*[field.name for field in rows.schema.fields if "map<" not in field.dataType.simpleString()])
    keyed = keyed.withColumn("_salt", F.when(F.col("_key").isNull(), spread).otherwise(F.pmod(spread, F.lit(salts))))
    copies = known.select(
        F.col(word).alias("_word"), *names, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_copy")
    )
    # A row without a key still needs one to be dealt by; no word is equal to null, so the salt only spreads it.
    dealt = keyed.withColumn("_dealt", F.coalesce("_key", F.lit("")))
    same = (F.col("_dealt") == F.col("_word")) & (F.col("_salt") == F.col("_copy")) & F.col("_key").isNotNull()
    return dealt.join(copies, same, "left").select(*rows.columns, *names)
