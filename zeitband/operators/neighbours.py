"""The most similar voice of the same session, by an exact index that leaves most pairs unscored.

Vectors are brought to unit length once, so a similarity is a dot product and an angle its arc cosine. About the square
root of a session's voices are pivots; each voice lies in the cell of its nearest pivot, and a cell knows the least and
largest angle between its voices and the pivot. By the triangle inequality of angles, a query at angle t from a pivot is
at least t - most and least - t away from all that its cell holds. The cell that may be nearest is scored first; of the
others only those that may hold something as similar as what that gave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zeitband.shared import stored

#: Voices of so many bytes are broadcast; more are joined in salted copies of their keys.
BROADCAST_BYTES = 16 << 20
SALTS = 32
#: Similarities are compared after rounding to six places; bounds leave room for that.
ROOM = 2e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(rows: DataFrame, name: str, made: str) -> DataFrame:
    """``rows`` with the vector ``name`` at unit length as ``made``, and its size; null for null, empty and zero vectors."""
    x = F.transform(name, lambda v: v.cast("double"))
    sized = rows.withColumn("__x", x).withColumn("__norm", F.sqrt(dot(F.col("__x"), F.col("__x"))))
    return sized.withColumn(made, F.when(F.col("__norm") > 0, F.transform("__x", lambda v: v / F.col("__norm")))).withColumn("dim", F.size(made)).drop("__x", "__norm", name)


def with_voices(queries: DataFrame, bank: DataFrame, keys: list[str], vector: str, by: str = "vec_id", how: str = "inner") -> DataFrame:
    """Each query with each voice of its keys; the bytes of the bank decide how they meet."""
    n_bytes = bank.agg(F.coalesce(F.sum(F.coalesce(F.size(vector), F.lit(0)).cast("long") * 8 + 64), F.lit(0))).first()[0]
    if n_bytes <= BROADCAST_BYTES:
        return queries.join(F.broadcast(bank), keys, how)
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    copies = bank.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return queries.withColumn("__salt", salt).join(copies, [*keys, "__salt"], how).drop("__salt")


KEYS = ["session", "dim"]


def indexed(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The voices in their cells (session, dim, cell, speaker, pending, v), and the pivots (session, dim, cell, p, least,
    most) with the angles of their cells."""
    voices = unit(bank.select("session", "speaker", "pending", "voice"), "voice", "v").filter("v is not null")
    voices = stored(voices.withColumn("h", F.xxhash64("speaker", "pending", "v")), "voices")
    counts = voices.groupBy(*KEYS).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("k"), F.min("h").alias("first"))
    marked = voices.join(F.broadcast(counts), KEYS) if counts.count() <= 100_000 else voices.join(counts, KEYS)
    pivots = marked.filter("pmod(h, k) = 0 or h = first").select(*KEYS, F.col("h").alias("cell"), F.col("v").alias("p")).dropDuplicates([*KEYS, "cell"])
    near = with_voices(voices, pivots, KEYS, "p", "h").withColumn("s", dot(F.col("v"), F.col("p")))
    home = near.groupBy(*KEYS, "h", "speaker", "pending").agg(F.max(F.struct("s", "cell")).alias("b"), F.any_value("v").alias("v"))
    cells = stored(home.select(*KEYS, F.col("b.cell").alias("cell"), "speaker", "pending", "v", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("b.s")))).alias("angle")), "cells")
    reach = cells.groupBy(*KEYS, "cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most"))
    return cells.drop("angle"), stored(pivots.join(reach, [*KEYS, "cell"]), "pivots")


def scored(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """The voices that may be most similar to each query: vec_id, similarity to six places, speaker, pending. Queries
    with null or zero vectors, or of other sizes than all voices of their session, have none."""
    cells, pivots = indexed(bank)
    asked = unit(queries.select("session", "vec_id", "embedding"), "embedding", "u").filter("u is not null")
    t = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("u"), F.col("p")))))
    near = with_voices(asked, pivots, KEYS, "p").withColumn("t", t)
    near = stored(near.select("vec_id", *KEYS, "cell", "u", F.greatest(F.lit(0.0), F.col("t") - F.col("most"), F.col("least") - F.col("t")).alias("away")), "near")
    first = near.groupBy("vec_id").agg(F.min(F.struct("away", "cell")).alias("f")).select("vec_id", F.col("f.cell").alias("first"))
    split = stored(near.join(first, "vec_id"), "near")

    def score(rows: DataFrame) -> DataFrame:
        met = with_voices(rows.select("vec_id", *KEYS, "cell", "u"), cells, [*KEYS, "cell"], "v")
        return met.select("vec_id", F.round(dot(F.col("u"), F.col("v")), 6).alias("similarity"), "speaker", "pending")

    found = stored(score(split.filter("cell = first")), "scored")
    best = found.groupBy("vec_id").agg(F.max("similarity").alias("known"))
    others = split.filter("cell <> first").join(best, "vec_id").filter(F.cos("away") >= F.col("known") - ROOM)
    return found.unionByName(score(others))
