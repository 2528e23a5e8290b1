"""Augmentation: label-preserving new pairs, and token-level operators.

New pairs are drawn by md5 order, so any engine repeats them. Token operators are seeded by row.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.tagging import STRUCTURE
from pairloom.sources.tables import written

OPS = ("del", "swap", "drop_len", "drop_sym", "drop_same", "drop_token", "ins", "append_col", "drop_col", "all")
_STRIP = '.,:-_()"'


def paraphrase(title: Column, synonyms: dict[str, list[str]] | None, seed: int = 22) -> Column:
    """Each word that is a synonym's key but for punctuation around it is replaced, punctuation included. Without synonyms nothing changes."""
    if not synonyms:
        return title
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")

    def other(w: Column, i: Column) -> Column:
        own = F.element_at(table, F.btrim(w, F.lit(_STRIP)))
        pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), title, i.cast("string"))), 1, 6), 16, 10).cast("int"), F.size(own))
        return F.coalesce(F.get(own, pick), w)

    return F.array_join(F.transform(words, other), " ")


def needed(train: DataFrame, total: int) -> DataFrame:
    """domain, n, pos, need_pos, need_neg: what keeps the label ratio at `total` rows."""
    c = train.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("pos"))
    goal = F.floor(F.lit(total) * (F.col("pos") / F.col("n")))
    return c.select("domain", "n", "pos", F.greatest(goal - F.col("pos"), F.lit(0)).alias("need_pos"), F.greatest(F.lit(total) - goal - (F.col("n") - F.col("pos")), F.lit(0)).alias("need_neg"))


def negatives(train: DataFrame, need: DataFrame, seed: int = 22, tries: int = 4) -> DataFrame:
    """domain, left, right: new pairs of a domain's titles that exist in neither order, need_neg of them if there are so many.

    Titles are ranked by md5 and pairs taken by the distance of their ranks, then by the first rank. Pairs up to a distance
    of `tries` times the need per title are tried, then further ones while a domain hasn't enough and has more.
    """
    titles = train.select("domain", F.explode(F.array("left", "right")).alias("title")).distinct()
    order = Window.partitionBy("domain").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "title")), "title")
    ranked = written(titles.withColumn("i", F.row_number().over(order)), "titles")
    known = train.select(F.col("domain").alias("_d"), F.least("left", "right").alias("_a"), F.greatest("left", "right").alias("_b"))
    known = written(known.distinct(), "known_pairs")
    while True:
        out, short = _new_pairs(ranked, known, need, tries)
        if short.isEmpty():
            return out
        tries *= 4


def _new_pairs(ranked: DataFrame, known: DataFrame, need: DataFrame, tries: int) -> tuple[DataFrame, DataFrame]:
    """(new pairs up to a distance of ranks, the domains that need more and have more)."""
    size = ranked.groupBy("domain").agg(F.max("i").alias("m"))
    reach = F.ceil(F.lit(tries) * F.col("need_neg") / F.col("m")) + 1
    sized = need.where("need_neg > 0").join(size, "domain").select("domain", "need_neg", "m", F.least(reach, F.col("m") - 1).alias("reach"))
    a = ranked.join(sized, "domain").where("reach > 0").withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("reach"))))
    b = ranked.select("domain", F.col("i").alias("j"), F.col("title").alias("right"))
    drawn = a.join(b, ["domain", "j"]).select("domain", F.col("title").alias("left"), "right", "need_neg", "i", "j")
    fresh = drawn.join(known, (F.col("domain") == F.col("_d")) & (F.least("left", "right") == F.col("_a")) & (F.greatest("left", "right") == F.col("_b")), "left_anti")
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("j") - F.col("i"), "i"))
    out = written(fresh.withColumn("k", place).where(F.col("k") <= F.col("need_neg")).select("domain", "left", "right"), "negatives")
    got = out.groupBy("domain").agg(F.count(F.lit(1)).alias("got"))
    return out, sized.where("reach < m - 1").join(got, "domain", "left").where(F.coalesce("got", F.lit(0)) < F.col("need_neg"))


def positives(train: DataFrame, need: DataFrame, synonyms: dict | None, seed: int = 22) -> DataFrame:
    """domain, left, right: need_pos positive pairs again, in md5 order and in turn, one side paraphrased."""
    order = Window.partitionBy("domain").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "left", "right")), "left", "right")
    pos = train.where("label = 1").withColumn("i", F.row_number().over(order) - 1)
    rows = pos.join(need.where("need_pos > 0").select("domain", "pos", "need_pos"), "domain")
    times = F.ceil((F.col("need_pos") - F.col("i")) / F.col("pos"))
    rows = rows.where(F.col("i") < F.col("need_pos")).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    left = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "left", "right", F.col("rep").cast("string"))), 1, 1), 16, 10).cast("int") % 2 == 0
    return rows.select("domain", F.when(left, paraphrase(F.col("left"), synonyms, seed)).otherwise(F.col("left")).alias("left"), F.when(left, F.col("right")).otherwise(paraphrase(F.col("right"), synonyms, seed)).alias("right"))


def augmented(train: DataFrame, total: int, synonyms: dict | None = None, seed: int = 22, include_original: bool = True) -> DataFrame:
    """domain, left, right, label: own pairs, paraphrased positives, new negatives."""
    need = needed(train, total)
    new = positives(train, need, synonyms, seed).withColumn("label", F.lit(1)).unionByName(negatives(train, need, seed).withColumn("label", F.lit(0)))
    return train.select("domain", "left", "right", "label").unionByName(new) if include_original else new


def synonyms_for(domain: str, maps: dict[str, dict[str, list[str]]]) -> dict[str, list[str]] | None:
    """The first synonym table whose name is a part of the domain's name; None: none."""
    return next((table for name, table in maps.items() if name in domain), None)


def _kind(token: str) -> str:
    return next((kind for kind, tokens in STRUCTURE.items() if token in tokens), "O")


def _span(tokens: list[str], n: int, rng: random.Random) -> int | None:
    starts = [i for i in range(len(tokens) - n + 1) if all(_kind(t) == "O" for t in tokens[i : i + n])]
    return rng.choice(starts) if starts else None


def _columns(tokens: list[str], left_only: bool) -> list[tuple[int, int]]:
    """(start, end) of each COL part, without a separator at its end; of the first entity only, if asked for."""
    heads = [i for i, t in enumerate(tokens) if t == "COL"]
    out = []
    for a, b in zip(heads, [*heads[1:], len(tokens)], strict=True):
        at_sep = tokens[b - 1] == "[SEP]"
        out.append((a, b - at_sep))
        if at_sep and left_only:
            break
    return out


def change(tokens: list[str], op: str, rng: random.Random) -> list[str]:
    """One operator on one token list; where it has nothing to work on, or isn't known, the tokens stay."""
    plain = [i for i, t in enumerate(tokens) if _kind(t) == "O"]
    if op == "all":
        for o in rng.choices(["del", "swap", "drop_col", "append_col"], k=3):
            tokens = change(tokens, o, rng)
        return tokens
    if op in ("del", "swap"):
        n = rng.randint(1, 2) if op == "del" else rng.randint(2, 4)
        at = _span(tokens, n, rng)
        if at is None:
            return tokens
        middle = [] if op == "del" else rng.sample(tokens[at : at + n], n)
        return tokens[:at] + middle + tokens[at + n :]
    if op == "drop_len":
        if not plain:
            return tokens
        size = len(tokens[rng.choice(plain)])
        return [t for t in tokens if _kind(t) != "O" or len(t) != size]
    if op == "drop_sym":
        bare = lambda t: "".join(c if c.isalnum() else " " for c in t)
        out = [bare(t) if _kind(t) == "O" and rng.randint(0, 4) == 0 else t for t in tokens]
        return [new for new, old in zip(out, tokens, strict=True) if new or not old]
    if op == "drop_same":
        cut = tokens.index("[SEP]") if "[SEP]" in tokens else len(tokens)
        sides = [{t.lower() for t in part if _kind(t) == "O"} for part in (tokens[:cut], tokens[cut:])]
        both = sorted(sides[0] & sides[1])
        if not both:
            return tokens
        gone = rng.choice(both)
        return [t for t in tokens if _kind(t) != "O" or t.lower() != gone]
    if op == "drop_token":
        return [t for t in tokens if _kind(t) != "O" or rng.randint(0, 4) != 0]
    if op == "ins":
        if not plain:
            return tokens
        at = rng.choice(plain)
        return [*tokens[:at], rng.choice("-*.,#&"), *tokens[at:]]
    if op == "append_col":
        cols = _columns(tokens, left_only=True)
        if len(cols) < 2:
            return tokens
        (a1, b1), (_, b2) = rng.sample(cols, 2)
        moved = tokens[a1:b1]
        moved = moved[moved.index("VAL") + 1 :] if "VAL" in moved else moved
        if b2 <= a1:
            return tokens[:b2] + moved + tokens[b2:a1] + tokens[b1:]
        return tokens[:a1] + tokens[b1:b2] + moved + tokens[b2:]
    if op == "drop_col":
        cols = [(a, b) for a, b in _columns(tokens, left_only=False) if b - a <= 8]
        if not cols:
            return tokens
        a, b = rng.choice(cols)
        return tokens[:a] + tokens[b:]
    return tokens


def change_text(text: str, op: str, seed: str) -> str:
    rng = random.Random(seed)
    if " [SEP] " in text and rng.randint(0, 1) == 0:
        left, _, right = text.partition(" [SEP] ")
        text = f"{right} [SEP] {left}"
    return " ".join(change(text.split(" "), op, rng))


def augment_texts(df: DataFrame, op: str, seed: int = 22, text: str = "text", key: str = "pair_id") -> DataFrame:
    """df with column augmented; each row is seeded by its key."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, texts in parts:
            yield pd.Series([None if t is None else change_text(t, op, f"{seed}|{op}|{k}") for k, t in zip(keys, texts, strict=True)])

    return df.withColumn("augmented", run(F.col(key).cast("string"), text))
