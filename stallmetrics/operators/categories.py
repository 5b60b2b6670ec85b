"""The dimension of categories, a hierarchy of any depth (survey S24), and what users choose of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CHOSEN = 2


def closure(categories: DataFrame) -> DataFrame:
    """key, above, steps for each category (key, parent) and each category above it, itself included; roots have a null parent.

    The dimension is declared by hand and small. A cycle is an error.
    """
    spark, name = categories.sparkSession, f"categories_{uuid.uuid4().hex}"
    categories.select("key", "parent").createOrReplaceTempView(name)
    return spark.sql(f"""
        WITH RECURSIVE up (key, above, steps) AS (
          SELECT key, key, 0 FROM {name} UNION ALL SELECT up.key, c.parent, up.steps + 1 FROM up JOIN {name} c ON c.key = up.above WHERE c.parent IS NOT NULL)
        SELECT key, above, steps FROM up""")


def roots(closed: DataFrame) -> DataFrame:
    """key, root: the category at the top."""
    return closed.groupBy("key").agg(F.max_by("above", "steps").alias("root"))


def in_group(closed: DataFrame, group: str) -> DataFrame:
    """The keys below a category, itself included."""
    return closed.filter(F.col("above") == group).select("key")


def counts(listings: DataFrame, closed: DataFrame) -> DataFrame:
    """category, listings: how many there are in a category and all below it; listings are counted by their own category first."""
    own = listings.groupBy(F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(closed, "key").groupBy(F.col("above").alias("category")).agg(F.sum("n").alias("listings"))


def toggled(chosen: Column, key: Column, is_group: Column, root: Column, children: Column, most: int = MOST_CHOSEN) -> Column:
    """struct chosen (sorted), refused: a chosen key goes; a root takes its children's place and a child its root's; more than `most` are refused."""
    added = F.array_union(F.when(is_group, F.array_except(chosen, children)).otherwise(F.array_except(chosen, F.array(root))), F.array(key))
    there, over = F.array_contains(chosen, key), F.size(added) > most
    now = F.when(there, F.array_except(chosen, F.array(key))).when(over, chosen).otherwise(added)
    return F.struct(F.sort_array(now).alias("chosen"), (~there & over).alias("refused"))


def filled_up(chosen: Column, root: Column, children: Column, most: int = MOST_CHOSEN) -> Column:
    """struct chosen (sorted), short: children that are chosen all go; else children in their order fill the free places."""
    own = F.array_intersect(children, chosen)
    kept = F.array_except(chosen, F.array(root))
    missing = F.array_except(children, kept)
    free = F.greatest(F.lit(0), F.lit(most) - F.size(kept))
    full = F.array_union(kept, F.slice(missing, F.lit(1), free))
    return F.struct(F.sort_array(F.when(F.size(own) > 0, F.array_except(chosen, own)).otherwise(full)).alias("chosen"), ((F.size(own) == 0) & (F.size(missing) > free)).alias("short"))


def valid_choice(keys: Column, known: Column, most: int = MOST_CHOSEN) -> Column:
    """Struct keys (known ones, once, in their order), error: none, too many, or null."""
    kept = F.array_distinct(F.filter(keys, lambda k: F.array_contains(known, k)))
    return F.struct(kept.alias("keys"), F.when(F.size(kept) == 0, "none").when(F.size(kept) > most, "too many").alias("error"))
