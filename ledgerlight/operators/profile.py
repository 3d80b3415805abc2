"""What the fields of a table hold: how full, how varied, how large."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ledgerlight.functions.crypto import fnv1a_many

#: Bits of a sketch, and keys of a bag that are profiled.
SKETCH_BITS, BAG_KEYS, SATURATED = 4096, 256, 0.95


def shape(value: Column) -> Column:
    """What a JSON text is, by its first character."""
    first = F.substring(F.trim(value), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "list").when(first.isin("t", "f"), "bool").when(first.rlike("[-0-9]"), "number").otherwise("text")


def bag(df: DataFrame, column: str, most: int = BAG_KEYS) -> DataFrame:
    """field, value (as text) and number of each key of a JSON object, the first most keys in order."""
    keys = F.slice(F.array_sort(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))), 1, most)
    each = df.select("org_id", "us", F.col(column).alias("j"), F.explode(keys).alias("key"))
    return each.select("org_id", "us", F.concat(F.lit("raw."), "key").alias("field"), F.try_variant_get(F.try_parse_json("j"), F.concat(F.lit("$['"), "key", F.lit("']")), "string").alias("value"))


def skipped(df: DataFrame, column: str, most: int = BAG_KEYS) -> DataFrame:
    """For each organisation the keys that bag() leaves out, counted in every row."""
    over = F.greatest(F.lit(0), F.size(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))) - most)
    return df.groupBy("org_id").agg(F.sum(over).alias("skipped"))


@F.pandas_udf(IntegerType())
def bucket(org: pd.Series, field: pd.Series, value: pd.Series) -> pd.Series:
    told = value.notna().to_numpy()
    out = pd.Series(pd.NA, index=value.index, dtype="Int32")
    out[told] = (fnv1a_many([f"{o}\0{f}\0{v}".encode() for o, f, v in zip(org[told], field[told], value[told])]) % SKETCH_BITS).astype("int32")
    return out


def long_form(df: DataFrame, texts: list[str], numbers: list[str], zeros: bool = False) -> DataFrame:
    """org_id, us, field, value (null where blank) and number of every declared field, in one pass.

    A number of zero is blank, as where a missing one is read as zero. With zeros it is a value: in tables, what is missing is null.
    """
    told = lambda c: F.col(c).isNotNull() if zeros else F.col(c) != 0
    cells = [F.struct(F.lit(c).alias("field"), F.when(F.col(c) != "", F.col(c)).alias("value"), F.lit(None).cast("double").alias("number")) for c in texts]
    cells += [F.struct(F.lit(c).alias("field"), F.when(told(c), F.col(c).cast("string")).alias("value"), F.when(told(c), F.col(c).cast("double")).alias("number")) for c in numbers]
    return df.select("org_id", "us", F.explode(F.array(*cells)).alias("c")).select("org_id", "us", "c.*")


def profile(cells: DataFrame) -> DataFrame:
    """Per organisation and field: seen, filled, fill, distinct (linear counting), min, max, mean, deviation, first and last."""
    n = F.count(F.when(F.col("value").isNotNull(), 1))
    number = F.col("number") if "number" in cells.columns else F.lit(None).cast("double")
    stats = cells.groupBy("org_id", "field").agg(
        F.count("*").alias("seen"), n.alias("filled"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"), F.stddev_pop(number).alias("deviation"),
        F.min(F.when(F.col("value").isNotNull(), F.col("us"))).alias("first_us"), F.max(F.when(F.col("value").isNotNull(), F.col("us"))).alias("last_us"),
    )
    sketches = sketch(cells)
    return stats.withColumn("fill", F.try_divide("filled", "seen")).join(sketches, ["org_id", "field"], "left")


def sketch(cells: DataFrame) -> DataFrame:
    """A bitmap of value hashes for each field, mergeable by bitmap_or_agg, and the number of values it stands for."""
    some = cells.where("value is not null").withColumn("b", bucket("org_id", "field", "value")).where("b is not null")
    bits = some.groupBy("org_id", "field").agg(F.bitmap_construct_agg("b").alias("sketch"))
    return estimated(bits)


def estimated(bits: DataFrame) -> DataFrame:
    set_bits = F.bitmap_count("sketch")
    free = (F.lit(SKETCH_BITS) - set_bits) / SKETCH_BITS
    return bits.withColumn("saturated", set_bits >= SATURATED * SKETCH_BITS).withColumn("distinct", F.when(free > 0, F.round(-SKETCH_BITS * F.ln(free))).otherwise(F.lit(float(SKETCH_BITS))).cast("long"))


def merge(sketches: DataFrame) -> DataFrame:
    return estimated(sketches.groupBy("org_id", "field").agg(F.bitmap_or_agg("sketch").alias("sketch")))


def partial(cells: DataFrame) -> DataFrame:
    """What a batch of cells adds to a profile: counts, sums, squares of deviations and a sketch for each organisation and field, to be put together by published().

    One pass makes all of it. Squares are those of deviations from the batch's own mean, as sums of squares of large numbers
    leave nothing of a small deviation.
    """
    filled, number = F.col("value").isNotNull(), F.col("number") if "number" in cells.columns else F.lit(None).cast("double")
    bits = cells.withColumn("b", bucket("org_id", "field", "value"))
    return bits.groupBy("org_id", "field").agg(
        F.count("*").alias("seen"), F.count_if(filled).alias("filled"), F.min(number).alias("min"), F.max(number).alias("max"), F.count(number).alias("numbers"), F.sum(number).alias("total"), (F.var_pop(number) * F.count(number)).alias("spread"),
        F.min(F.when(filled, F.col("us"))).alias("first_us"), F.max(F.when(filled, F.col("us"))).alias("last_us"), F.when(F.count("b") > 0, F.bitmap_construct_agg("b")).alias("sketch"),
    )


def published(partials: DataFrame) -> DataFrame:
    """The profile of all batches: as profile() has it."""
    all_batches = Window.partitionBy("org_id", "field")
    mean = F.try_divide(F.sum("total").over(all_batches), F.sum("numbers").over(all_batches))
    apart = F.try_divide("total", "numbers") - F.col("_mean")
    out = partials.withColumn("_mean", mean).groupBy("org_id", "field").agg(
        F.sum("seen").alias("seen"), F.sum("filled").alias("filled"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("numbers").alias("_n"), F.first("_mean").alias("mean"), F.sum(F.col("spread") + F.col("numbers") * apart * apart).alias("_s"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.bitmap_or_agg("sketch").alias("sketch"),
    )
    out = out.withColumns({"fill": F.try_divide("filled", "seen"), "deviation": F.sqrt(F.try_divide("_s", "_n"))})
    return estimated(out.drop("_n", "_s"))
