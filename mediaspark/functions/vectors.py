"""Column functions on dense vectors (arrays of float), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(_doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in [0, 2]."""
    return 1 - cosine(a, b)


def literal(vector) -> Column:
    """A vector known on the driver."""
    return F.array(*[F.lit(float(x)) for x in vector])


def mean_vector(rows, keys: list[str], vector: str = "embedding", normalize_rows: bool = True, out: str = "centroid"):
    """Per key the mean of its vectors at length 1, of normalised rows or of raw ones: two different centroids.

    Elements are averaged by position, with partial sums before the shuffle.
    """
    v = l2_normalize(F.col(vector)) if normalize_rows else _doubles(F.col(vector))
    per = rows.select(*keys, F.posexplode(v).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"))
    # As many elements as a vector has.
    return per.groupBy(*keys).agg(
        l2_normalize(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"])).alias(out)
    )


def consistency(rows, keys: list[str], vector: str = "embedding", out: str = "consistency"):
    """Per key the mean cosine of all pairs of its vectors, clipped to [0, 1]; 1 for a single vector.

    From the sum s of the n normalised vectors: (|s|^2 - sum |v|^2) / (n (n - 1)), with no pair formed.
    """
    unit = l2_normalize(F.col(vector))
    rows = rows.select(*keys, unit.alias("_v")).withColumn("_own", dot(F.col("_v"), F.col("_v")))
    own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_own").alias("_own"))
    total = (
        rows.select(*keys, F.posexplode("_v").alias("_pos", "_x"))
        .groupBy(*keys, "_pos")
        .agg(F.sum("_x").alias("_x"))
        .groupBy(*keys)
        .agg(F.sum(F.col("_x") * F.col("_x")).alias("_all"))
    )
    mean = (F.col("_all") - F.col("_own")) / (F.col("_n") * (F.col("_n") - 1))
    value = F.when(F.col("_n") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))
    return own.join(total, keys).select(*keys, F.col("_n").alias("n"), value.alias(out))


def running_centroid(old: Column, count: Column, added: Column) -> Column:
    """norm(old unit vector * its number of faces + sum of the added unit vectors)."""
    return l2_normalize(F.zip_with(l2_normalize(old), added, lambda o, a: o * count + a))
