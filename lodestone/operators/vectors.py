"""The vector table: exact nearest neighbours of a query, upsert and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (size(a) * size(b))


def check_dims(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """Fails at run time on a vector of another length."""
    if dims <= 0:
        raise ValueError("a vector table needs a positive dimension")
    fits = F.when(F.size(column) == dims, F.col(column)).otherwise(F.raise_error(F.lit(f"vector dimension is not {dims}")))
    return vectors.withColumn(column, fits)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", column: str = "embedding", metric: str = "l2") -> DataFrame:
    """``key, metadata?, distance, rank``: the k nearest rows of the query's length, ties to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    usable = vectors.where(F.size(column) == len(query))
    d = squared_l2(F.col(column), q) if metric == "l2" else 1 - cosine(F.col(column), q)
    top = usable.withColumn("distance", d).drop(column).orderBy("distance", key).limit(max(0, k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def upsert(table: DataFrame, rows: DataFrame, dims: int, key: str = "chunk_id") -> DataFrame:
    """The table with the rows put in place of those of the same keys."""
    return table.join(rows.select(key), key, "left_anti").unionByName(check_dims(rows, dims))


def delete(table: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")
