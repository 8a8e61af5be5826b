"""Typed expressions over an environment of values, functions and members, by rising length.

A length counts names, brackets, commas and dots. At each length, calls are completed from partly
filled ones by a join with shorter expressions through the subtype table, and members are joined once
for each receiver type. Environments are small tables; so are the results, by the length's bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.plans.shared import cut


def expressions(values: DataFrame, fns: DataFrame, members: DataFrame, subtypes: DataFrame, max_length: int = 10) -> DataFrame:
    """Rows (text, type, len). values: name, type; fns: name, params, ret; members: owner, name, params (null: a value), ret; subtypes: sub, sup (a type is its own)."""
    found = cut(values.select(F.col("name").alias("text"), "type", F.lit(1).alias("len")).dropDuplicates(["text", "type"]))
    arity = max([0] + [r[0] for t in (fns, members) for r in t.select(F.max(F.size("params"))).collect() if r[0] is not None])
    same = found.sparkSession.createDataFrame([], "sub string, sup string").unionByName(subtypes.select("sub", "sup"))
    for n in range(2, max_length + 1):
        fits = found.join(same, found["type"] == same["sub"]).select("text", "len", F.col("sup").alias("wanted")).unionByName(found.select("text", "len", F.col("type").alias("wanted"))).distinct()
        receivers = found.where(F.col("len") <= n - 2).select("text", "len", "type")
        owned = members.join(receivers, members["owner"] == receivers["type"]).select((F.concat_ws(".", "text", "name")).alias("head"), (F.col("len") + 2).alias("size"), "params", "ret")
        fields = owned.where(F.col("params").isNull() & (F.col("size") == n)).select(F.col("head").alias("text"), F.col("ret").alias("type"), "size")
        calls = owned.where(F.col("params").isNotNull()).unionByName(fns.select(F.col("name").alias("head"), F.lit(1).alias("size"), "params", "ret"))
        part = calls.select(F.concat("head", F.lit("(")).alias("head"), (F.col("size") + 2).alias("size"), "params", "ret")
        done = part.where((F.size("params") == 0) & (F.col("size") == n))
        for k in range(arity):
            wanted = part.where(F.size("params") > k).withColumn("wanted", F.get("params", F.lit(k)))
            part = wanted.join(fits, "wanted").select(F.concat("head", F.lit(", " if k else ""), "text").alias("head"), (F.col("size") + F.col("len") + (1 if k else 0)).alias("size"), "params", "ret").where(F.col("size") <= n)
            done = done.unionByName(part.where((F.size("params") == k + 1) & (F.col("size") == n)))
        new = done.select(F.concat("head", F.lit(")")).alias("text"), F.col("ret").alias("type"), "size").unionByName(fields)
        found = cut(found.unionByName(new.select("text", "type", F.col("size").alias("len"))).groupBy("text", "type").agg(F.min("len").alias("len")))
    return found


def of_type(found: DataFrame, subtypes: DataFrame, expected: str, k: int) -> DataFrame:
    """The k least expressions by (length, text) of a type or a subtype of it."""
    below = subtypes.where(F.col("sup") == expected).select(F.col("sub").alias("type"))
    return found.where(F.col("type") == expected).unionByName(found.join(below, "type", "left_semi")).dropDuplicates(["text"]).orderBy("len", "text").limit(k)
