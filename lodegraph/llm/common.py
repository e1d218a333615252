"""Shared plumbing of the corpus operators: tables, row locators, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.steps import materialize, sized

#: Tables of more bytes are never spread by a shuffle: their files make tasks enough.
SPREAD_BYTES = 256 << 20
#: Texts of more characters are left out of the labelled samples that are sent to the driver; they are scored like all.
LONGEST_SAMPLE = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; with a key, a small one whose files make fewer scan tasks than there are cores is spread over them by it."""
    where = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(where)
    cores = spark.sparkContext.defaultParallelism
    if not key or df.rdd.getNumPartitions() >= cores:
        return df
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)  # noqa: SLF001
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()  # noqa: SLF001
    return df.repartition(cores, key) if size <= SPREAD_BYTES else df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the letter case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(df: DataFrame, name: str) -> Column:
    """The column of exactly this spelling, also where others differ only in letter case or contain dots."""
    return F.col(f"`{name}`")


def hash_sample(df: DataFrame, key: Column, rows: int, by: str | None = None) -> DataFrame:
    """At most ``rows`` rows of df, in hash order of ``key``: the same for any partitioning.

    With ``by``, in turn from each of its values: rare ones come whole before common ones fill the rest. On large frames
    a bound on the hash leaves about twice the rows of a value before they are ordered, so what tasks send on doesn't
    grow with their number.
    """
    name, size, place = (fresh(c, df) for c in ("hash_", "size_", "place_"))
    own = [F.col(f"`{by}`")] if by else []
    counts = materialize(df.groupBy(*own).agg(F.count("*").alias(size)))
    n = counts.count()
    out = df.withColumn(name, F.xxhash64(key))
    out = out.join(sized(counts, n, 64), by) if by else out.crossJoin(F.broadcast(counts))
    share = F.least(F.lit(2.0) * rows / F.col(size), F.lit(1.0))
    out = out.filter((F.col(size) <= 4 * rows) | (F.col(name) / 2.0**64 + 0.5 < share))
    order = [F.col(name), *[F.col(f"`{c}`") for c in df.columns]]
    if by:
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
        order = [F.col(place), *order]
    return out.orderBy(*order).limit(rows).select([F.col(f"`{c}`") for c in df.columns])


def locator(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over every column of a row: equal exactly for rows equal in all columns.

    The locator depends on content alone, so a recomputed task gives the same one. Maps are
    hashed through their JSON form.
    """
    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(c) if "map<" in f.dataType.simpleString() else c

    fields = [plain(f) for f in df.schema.fields]
    nulls = [c.isNull() for c in fields]
    return [F.xxhash64(F.lit(seed), *nulls, *fields) for seed in (17, 91)]


def drop_rows(docs: DataFrame, losers: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows whose locator is in ``losers``, and one row of each locator in ``repeated``.

    Both have the columns (l1, l2) and should be materialised: they are counted here. Only the
    rows named by ``repeated`` (whole rows that occur several times) are shuffled with their text,
    and the others only if the losers are too many to broadcast.
    """
    a, b, act = (fresh(n, docs) for n in ("l1_", "l2_", "act_"))
    one, two = locator(docs)
    n_losers, n_repeated = losers.count(), repeated.count()
    out = docs.withColumns({a: one, b: two})

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("l1").alias(a), F.col("l2").alias(b))

    if n_losers:
        out = out.join(sized(named(losers), n_losers, 64), [a, b], "left_anti")
    if n_repeated:
        marks = sized(named(repeated).withColumn(act, F.lit(True)), n_repeated, 64)
        out = out.join(marks, [a, b], "left")
        once = out.filter(F.col(act)).dropDuplicates([a, b])
        out = out.filter(F.col(act).isNull()).unionByName(once)
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def min_by_order(value: Column, *order: Column) -> Column:
    """min_by with nulls last in each ordering column."""
    parts = [p for c in order for p in (c.isNull(), c)]
    return F.min_by(value, F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)]))
