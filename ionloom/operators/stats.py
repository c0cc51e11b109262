"""Statistics of timing results: gather, reshape, summarise, sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def read_results(spark: SparkSession, path: str, charge_pattern: str = r"charge_([A-Z])", size_pattern: str = r"against_([0-9]+)") -> DataFrame:
    """All CSV files of a folder with what their names say (charge, library size)."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    name = F.col("_metadata.file_name")
    return df.select("*", name.alias("file_name")).withColumn("charge", F.regexp_extract("file_name", charge_pattern, 1)).withColumn(
        "library_size", F.regexp_extract("file_name", size_pattern, 1).try_cast("long")
    )


def long_form(df: DataFrame, ids: list[str], measures: list[str], name: str = "method", value: str = "seconds") -> DataFrame:
    """One row per measure; null and NaN values are left out."""
    return df.unpivot(ids, measures, name, value).filter(F.col(value).isNotNull() & ~F.isnan(value))


def running_total(df: DataFrame, by: list[str], order: Column, weight: Column) -> DataFrame:
    """``df`` with ``__upto``, the sum of ``weight`` over the group's rows up to this one, and ``__n``, that over the group.

    Rows are range-partitioned by (group, order); a row's sum is the running one within its partition
    plus the totals of the partitions before.  No task holds more than a range of a group.  Null keys
    form a group; (group, order) must be unique.
    """
    parts = df.withColumns({"__order": order, "__weight": weight}).repartitionByRange(*by, "__order")
    parts = cut_lineage(parts.withColumn("__p", F.spark_partition_id()))
    totals = parts.groupBy(*by, "__p").agg(F.sum("__weight").alias("__t"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__t").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("__before", before).withColumn("__n", F.sum("__t").over(group))
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__p"]]
    run = F.sum("__weight").over(Window.partitionBy(*by, "__p").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0))
    both = parts.withColumn("__run", run).alias("a").join(totals.alias("b"), cond)
    return both.select(*[f"a.{c}" for c in df.columns], (F.col("__before") + F.col("__run")).alias("__upto"), "__n")


def exact_quantiles(df: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """``(by..., q)``: exact interpolated quantiles per group, as an array in the order of ``fractions``.

    Equal values are counted first, ranks are running counts (:func:`running_total`).  Null values do not count.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    rows = running_total(counts, by, F.col("__x"), F.col("__c")).withColumn("__from", F.col("__upto") - F.col("__c"))
    aggs, out = [], []
    for i, f in enumerate(fractions):
        at = F.lit(float(f)) * (F.col("__n") - 1)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__upto")), F.col("__x"))).alias(f"__{end}{i}"))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return rows.groupBy(*by).agg(F.max("__n").alias("__n"), *aggs).select(*by, F.array(*out).alias("q"))


def dense_ranks(df: DataFrame, by: str, scores: list[str]) -> DataFrame:
    """``rank_<score>`` per group, the best score first (NaN before all, null after all).

    The distinct scores of a group are counted in order over ranges (:func:`running_total`), so a group
    with most of the rows is no single task's work; rows find their rank by group and score.
    """
    for s in scores:
        each = df.select(F.col(by).alias("__by"), F.col(s).alias("__s")).distinct()
        # the greatest first, NaN before all, null after all
        order = F.struct(F.col("__s").isNull(), ~F.isnan(F.col("__s").cast("double")), -F.col("__s"))
        ranks = running_total(each, ["__by"], order, F.lit(1)).withColumn(f"rank_{s}", F.col("__upto").cast("int"))
        cond = F.col(by).eqNullSafe(F.col("__by")) & F.col(s).eqNullSafe(F.col("__s"))
        df = df.join(ranks.select("__by", "__s", f"rank_{s}"), cond).drop("__by", "__s")
    return df


def summary(df: DataFrame, by: list[str], value: str = "seconds") -> DataFrame:
    """Count, mean, maximum and exact quartiles per group."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    q = exact_quantiles(df, by, value, [0.25, 0.5, 0.75])
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    both = out.alias("a").join(q.alias("b"), cond, "left")
    return both.select(*[f"a.{c}" for c in by], "n", "mean", "max", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def histogram(df: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    return df.groupBy(*by, (F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for equal data and seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def sample_share(df: DataFrame, fraction: float, replacement: bool = False, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=replacement, fraction=fraction, seed=seed)


def nearest(df: DataFrame, by: str, offset: str, tie: str, limit: float) -> DataFrame:
    """Per group the row of the smallest absolute offset within ``limit``."""
    w = Window.partitionBy(by).orderBy(F.abs(F.col(offset)), tie)
    return df.filter(F.abs(F.col(offset)) <= limit).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of CSV (or, with another ``sep``, tab-separated) files with a header; arrays and maps as JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
