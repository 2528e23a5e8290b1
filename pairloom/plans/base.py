"""The tables that stand for the data model, in Spark and in SQL.

A domain is a label of the embeddings, a singleton a row in the order of vec_id, a pair two neighbouring ones. Pairs are
split by pair_idx mod 5: 0 to 2 train, 3 val, 4 test. The SQL below gives the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import pairs as P
from pairloom.sources.tables import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("domain"), "vec_id", V.doubles("embedding").alias("v"))
    return P.numbered(rows, "domain", "vec_id")


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, pair_idx, split, l, r. Numbering and pairing shuffle all vectors, so their result is written and read by each use."""
    return written(P.vector_pairs(singles(spark, sf_dir)).withColumn("split", P.split_of()), "vector_pairs")


def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, pair_idx, split, v: unit pair vectors."""
    pairs = P.vector_pairs(singles(spark, sf_dir)).withColumn("split", P.split_of())
    return written(pairs.select("domain", "pair_idx", "split", V.unit_pair(F.col("l"), F.col("r")).alias("v")), "unit_pairs")


def part(pairs: DataFrame, split: str) -> DataFrame:
    return pairs.where(F.col("split") == split).drop("split")


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-10))"


def add_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"


def half_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: (z[1] + z[2]) / 2)"


PAIRS = f"""
s AS (SELECT label AS domain, vec_id, CAST(embedding AS DOUBLE[]) AS v,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings),
raw AS (SELECT a.domain, CAST(a.idx // 2 AS BIGINT) AS pair_idx,
               CASE WHEN (a.idx // 2) % 5 <= 2 THEN 'train' WHEN (a.idx // 2) % 5 = 3 THEN 'val' ELSE 'test' END AS split,
               a.v AS l, b.v AS r
        FROM s a JOIN s b ON a.domain = b.domain AND b.idx = a.idx + 1 WHERE a.idx % 2 = 0),
units AS (SELECT domain, pair_idx, split, {unit_sql("l")} AS l, {unit_sql("r")} AS r FROM raw),
halves AS (SELECT domain, pair_idx, split, {half_sql("l", "r")} AS m FROM units),
up AS (SELECT domain, pair_idx, split, {unit_sql("m")} AS v FROM halves),
train AS (SELECT * FROM up WHERE split = 'train')
"""


def mean_sql(name: str, source: str, v: str = "v") -> str:
    """A table name(domain, mean, n) of component-wise means of source's vectors."""
    return f"""
{name}_k AS (SELECT domain, k, avg(x) AS m, count(*) AS c FROM (
    SELECT domain, unnest({v}) AS x, unnest(range(1, len({v}) + 1)) AS k FROM {source}) GROUP BY domain, k),
{name} AS (SELECT domain, list(m ORDER BY k) AS mean, max(c) AS n FROM {name}_k GROUP BY domain)
"""


def fill_sql(scored: str, budget: int, seed: int = 22) -> str:
    """The budget frame over a table scored(target, donor, pair_idx, score)."""
    return f"""
cnt AS (SELECT domain, count(*) AS n FROM train GROUP BY domain),
own AS (SELECT t.domain AS target, t.domain AS donor, t.pair_idx, n,
        row_number() OVER (PARTITION BY t.domain ORDER BY CASE WHEN n >= {budget} THEN md5(concat_ws('|', '{seed}', t.domain, t.pair_idx)) ELSE '' END, t.pair_idx) - 1 AS pos
        FROM train t JOIN cnt USING (domain)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 9), donor, pair_idx) AS rank FROM ({scored})),
base AS (SELECT target, donor, pair_idx, pos FROM own WHERE pos < {budget}
         UNION ALL
         SELECT target, donor, pair_idx, n + rank - 1 FROM ranked JOIN cnt ON cnt.domain = target WHERE n < {budget} AND rank <= {budget} - n),
size AS (SELECT target, count(*) AS m FROM base GROUP BY target),
filled AS (SELECT target, rep * m + pos AS out_pos, donor, pair_idx
           FROM base JOIN size USING (target), LATERAL (SELECT unnest(range(0, CAST(ceil({budget} / m) AS BIGINT))) AS rep))
SELECT target, CAST(out_pos AS BIGINT) AS out_pos, donor, pair_idx FROM filled WHERE out_pos < {budget}
"""
