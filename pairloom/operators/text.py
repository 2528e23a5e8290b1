"""TF-IDF over pairs as joins over tokens, and the summariser, over arrays of a pair's tokens.

Fixed behaviour: the vocabulary is lower-cased but looked up with the token as it stands; COL and VAL are ranked with
weight 0 and take length; the limit is per side. Ties in weight go to the first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.pairs import small

TOKEN = r"[\p{L}\p{N}_]{2,}"
HEADS = ("COL", "VAL")


def idf(lines: DataFrame, fields: tuple[str, ...] = ("left", "right", "label")) -> DataFrame:
    """token, df, idf over documents that are the fields of lines (labels too): ln((1 + n) / (1 + df)) + 1."""
    docs = lines.select(F.monotonically_increasing_id().alias("_line"), *[F.col(c).cast("string").alias(c) for c in fields])
    n = lines.count() * len(fields)
    words = F.array(*[F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)) for c in fields])
    df = docs.select(F.explode(F.flatten(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def shared(left: Column, right: Column) -> Column:
    """The number of different lower-cased tokens in both texts."""
    low = lambda c: F.split(F.lower(c), " ", -1)
    return F.size(F.array_intersect(low(left), low(right))).cast("long")


def frequency(text: Column) -> dict[str, Column]:
    """heads (COL and VAL), tokens, and kinds of tokens of a text split at single spaces."""
    t = F.split(text, " ", -1)
    heads = F.filter(t, lambda x: x.isin(*HEADS))
    return {"heads": F.size(heads).cast("long"), "tokens": F.size(t).cast("long"), "kinds": F.size(F.array_distinct(t)).cast("long")}


def side_tokens(pairs: DataFrame) -> DataFrame:
    """pair_id, side, pos, token of both texts, split at single spaces."""
    sides = pairs.select("pair_id", F.posexplode(F.array("left", "right")).alias("side", "text"))
    return sides.select("pair_id", "side", F.posexplode(F.split("text", " ", -1)).alias("pos", "token"))


def _with_idf(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """tokens with the idf of their token (null: not in the vocabulary).

    Only a vocabulary that is counted small is broadcast: Spark's estimates of exploded rows are far too low to go by.
    """
    return tokens.hint("merge").join(small(weights.select("token", "idf")), "token", "left")


def pair_weights(tokens: DataFrame, weights: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """pair_id, token, weight: how often a vocabulary token is in the pair, times its idf."""
    seen = tokens.where(~F.col("token").isin(*HEADS, *stopwords)).groupBy("pair_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return _with_idf(seen, weights).where("idf IS NOT NULL").select("pair_id", "token", (F.col("n") * F.col("idf")).alias("weight"))


def _ranked(first: str, max_len: int) -> Column:
    """The pair's tokens in _kinds that a side has, heaviest first, then by their first place, which the field `first` holds."""
    own = F.filter("_kinds", lambda x: x[first].isNotNull())
    order = F.transform(own, lambda x: F.struct((-F.round(x["weight"], 9)).alias("w"), x[first].alias("pos"), x["token"].alias("token"), x["size"].alias("size")))
    return F.slice(F.sort_array(order), 1, max_len)


def _shown(heads: Column, ranked: Column, max_len: int) -> Column:
    """A side's heads and the ranked tokens that fit, in their order."""

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + x["size"]
        return F.struct(total.alias("total"), (state["n"] + F.when(total <= max_len, 1).otherwise(0)).alias("n"))

    start = F.struct(F.size(heads).cast("long").alias("total"), F.lit(0).alias("n"))
    fitting = F.slice(ranked, F.lit(1), F.aggregate(ranked, start, add, lambda state: state["n"]))
    kept = F.transform(F.filter(fitting, lambda x: ~x["token"].isin(*HEADS)), lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token")))
    text = F.transform(F.sort_array(F.concat(heads, kept)), lambda x: F.concat(x["token"], F.lit(" ")))
    return F.coalesce(F.array_join(text, ""), F.lit(""))


def summarize(pairs: DataFrame, weights: DataFrame, max_len: int, stopwords: tuple[str, ...] = (), length=None) -> DataFrame:
    """pair_id, left, right: each side's heads, and its heaviest tokens once each in their order, within max_len.

    length(token column) counts a token's pieces; one by default. A pair's different tokens become one array next to its
    texts, so only the vocabulary is joined by token, and no join has a row for each place of a token.
    """
    size = length or (lambda c: F.lit(1))
    first = lambda side: F.min(F.when(F.col("side") == side, F.col("pos")))
    kinds = side_tokens(pairs).groupBy("pair_id", "token").agg(F.count(F.lit(1)).alias("n"), first(0).alias("in_left"), first(1).alias("in_right"))
    weight = F.when(~F.col("token").isin(*HEADS, *stopwords), F.col("n") * F.col("idf"))
    kinds = _with_idf(kinds, weights).select(
        "pair_id", F.struct("token", F.coalesce(weight, F.lit(0.0)).alias("weight"), size(F.col("token")).cast("long").alias("size"), "in_left", "in_right").alias("kind")
    )
    kinds = kinds.groupBy("pair_id").agg(F.collect_list("kind").alias("_kinds"))
    both = pairs.select("pair_id", "left", "right", "label").join(kinds.hint("merge"), "pair_id", "left")
    places = lambda c: F.transform(F.split(c, " ", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("token")))
    heads = lambda c: F.filter(places(c), lambda x: x["token"].isin(*HEADS))
    both = both.select("pair_id", "label", *[x for c in ("left", "right") for x in (heads(c).alias(f"heads_{c}"), _ranked(f"in_{c}", max_len).alias(f"ranked_{c}"))])
    return both.select("pair_id", *[_shown(F.col(f"heads_{c}"), F.col(f"ranked_{c}"), max_len).alias(c) for c in ("left", "right")], "label")
