"""Cohesion, pairwise cosine similarity, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohesion(df: DataFrame, entity: list[str], vote: str, plus: Column, minus: Column, member: str) -> DataFrame:
    """(plus - minus) / members, for each entity and vote; abstentions count as members only."""
    value = (F.count_if(plus) - F.count_if(minus)) / F.count_distinct(member)
    return df.groupBy(*entity, vote).agg(value.alias("t"))


def pairwise_cosine(vectors: DataFrame, entity: str, dim: str, value: str) -> DataFrame:
    """(a, b, similarity, n) of each unordered pair with a common dimension: the cosine over the common ones;
    null where a norm is zero. The join is on the dimension."""
    a = vectors.select(F.col(dim), F.col(entity).alias("a"), F.col(value).alias("x"))
    b = vectors.select(F.col(dim), F.col(entity).alias("b"), F.col(value).alias("y"))
    pairs = a.join(b, dim).where("a < b")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return pairs.groupBy("a", "b").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), norm).alias("similarity"), F.count("*").alias("n"))


def cooccurrence(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(a, b, n): in how many baskets two items meet; an item counts once a basket."""
    rows = df.select(basket, item).distinct()
    a = rows.select(basket, F.col(item).alias("a"))
    b = rows.select(basket, F.col(item).alias("b"))
    return a.join(b, basket).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def cooccurrence_for(df: DataFrame, basket: str, item: str, key) -> DataFrame:
    """(item, n): what meets one item, repeats within a basket counted; only that item's baskets are joined."""
    chosen = df.where(F.col(item) == key).select(basket).distinct()
    return df.join(chosen, basket, "left_semi").where(F.col(item) != key).groupBy(item).agg(F.count("*").alias("n"))
