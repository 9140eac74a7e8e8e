"""Helpers the training-data operators share: table access, lineage cuts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Besides cutting the lineage this gives a later join two plain exchanges, so adaptive
    execution can split a skewed key on either side.
    """
    return materialize(df)


def sheltered(docs: DataFrame, prefix: str, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns whose names start with ``prefix`` renamed, and the names to give back to them.

    An operator whose internal columns start with ``prefix`` can then keep any columns. ``own`` are columns it reads.
    """
    taken = {c.lower() for c in docs.columns}
    back = {}
    for c in docs.columns:
        if c.lower().startswith(prefix) and c not in own:
            new, n = f"kept {c}", 0
            while new.lower() in taken:
                n += 1
                new = f"kept {n} {c}"
            taken.add(new.lower())
            back[new] = c
    return docs.withColumnsRenamed({c: new for new, c in back.items()}), back


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``(a, b)`` links as ``(node, component)``.

    ``component`` is the smallest node reachable. Alternating large-star and small-star
    rounds (Kiveris et al., 2014): every round is a map-side combined minimum, a join and a
    distinct, so no component is ever gathered in one task and long chains halve per round.
    Null ends and self links are ignored.
    """
    a, b = F.col("a"), F.col("b")
    links = pinned(edges.where(a.isNotNull() & b.isNotNull() & (a != b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pinned(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = pinned(large)
        low = pinned(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                        F.struct(F.col("u"), F.col("m").alias("v")))
        links = pinned(large.join(low, "u").select(F.explode(pairs).alias("p")).select("p.u", "p.v")
                       .where("u != v").distinct())
        new = _state(links)
        if new == state:
            break
        state = new
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(links: DataFrame):
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
