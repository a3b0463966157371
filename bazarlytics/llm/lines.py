"""Lines that many documents share, dropped from all of them but one.

Lines are exploded with their positions and hashed by their key: the line without white
space at its ends and with A-Z in lower case. Documents are counted per hash, and a key at
or over the threshold loses its lines everywhere but in the document with the largest id.
Only the positions to drop come back to the texts, which are put together again from the
positions that stay. All steps are built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.llm.common import computed, fresh, store

#: White space at the ends of a line, and the letters that change case.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What equal lines share. Lower-casing as a whole is quicker and the same for ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _same(*pairs: tuple[Column, Column]) -> Column:
    return reduce(lambda a, b: a & b, (left.eqNullSafe(right) for left, right in pairs))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(id, body, body2, pos, key, key2) of all lines whose key has that many characters.

    `body` and `key` with their seconds are 128-bit hashes of the text and the line's key. Rows
    with the same id and text lose the same lines, so these two tell rows apart.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(text).alias("body"), F.xxhash64(text, F.lit(1)).alias("body2"),
        F.posexplode(lines_of(F.col("text"))).alias("pos", "line"),
    ).where(F.octet_length("line") >= least_chars)
    rows = rows.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= least_chars)
    return rows.select(
        "id", "body", "body2", "pos", F.xxhash64("line").alias("key"), F.xxhash64("line", F.lit(1)).alias("key2")
    )


def repeated_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """(key, key2, last) of the keys that occur in at least that many documents; `last` is the
    largest id. Counts combine before each shuffle, so a key in every document stays cheap."""
    pairs = lines.groupBy("key", "key2", "id").agg(F.lit(1).alias("one"))
    counts = pairs.groupBy("key", "key2").agg(F.sum("one").alias("n"), F.max("id").alias("last"))
    return store(counts.where(F.col("n") >= least_docs).select("key", "key2", "last"), "repeated-lines")


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = 40, least_docs: int = 5, lines_name: str = "n_lines", dropped_name: str = "n_dropped"
) -> DataFrame:
    """All columns, with the lines dropped from text, and two more: the number of lines before
    and the number of those dropped.

    A key counts if it has at least `least_chars` characters and stands in at least `least_docs`
    documents. Documents are told apart by doc_id; rows without one count as one document, and
    its id is the smallest. Repeated rows all get the same result; rows that share the largest
    id all keep the line. A null text counts as one empty line, and stays null. An empty table
    gives no rows. New columns whose names are taken get underscores.
    """
    lines = long_lines(docs, least_chars)
    repeated = repeated_keys(lines, least_docs)
    gone = (
        lines.join(repeated, ["key", "key2"])
        .where(F.coalesce(F.col("id") < F.col("last"), F.col("last").isNotNull()))
        .groupBy("id", "body", "body2")
        .agg(F.collect_set("pos").alias("drop"))  # at most the lines of one text
    )
    names = docs.columns
    given = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, doc_id = (F.col(f"c{names.index(c)}") for c in ("text", "doc_id"))
    whole = F.coalesce(text, F.lit(""))
    rows = given.withColumns({"body": F.xxhash64(whole), "body2": F.xxhash64(whole, F.lit(1))}).alias("d")
    joined = rows.join(
        gone.alias("g"),
        (F.col("d.body") == F.col("g.body")) & (F.col("d.body2") == F.col("g.body2")) & _same((doc_id, F.col("g.id"))),
        "left",
    ).select(*given.columns, "drop")
    split = computed(joined, "lines", lines_of(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    texts = F.when(F.col("drop").isNull(), text).otherwise(kept)
    counted = fresh(lines_name, names)
    return split.select(
        *(texts.alias(n) if n == "text" else F.col(c).alias(n) for c, n in zip(given.columns, names)),
        F.size("lines").cast("long").alias(counted),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(fresh(dropped_name, [*names, counted])),
    )
