"""URL filtering: given rules first, then association rules mined from the URLs.

A given rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's; the longest wins.
The URLs that a rule decides are labelled examples. Every URL becomes a set of tokens (top-level name, domain, all host
labels, all path segments, keys of the query, extension). The rules are those "tokens -> label" of at least SUPPORT (of all rows) and CONFIDENCE
(URLs without a label count against a rule) that no shorter rule with at least the same confidence and label makes idle.
Spark's FP-growth finds the frequent sets of tokens and labels, which stay in Spark until the pruning, size by size, has
left the rules. Sets in long baskets multiply: where the baskets' sizes prove no bound of SETS on the frequent sets, the
same rules are mined level by level instead, without a cap: a set of tokens grows only while all its parts are live, i.e.
some label has it often enough, no part has the same rows, and its rows don't all have one label. What is not live can
only give idle rules, so tokens that always come together don't multiply. There, counts are summed in Spark and only sets
that are frequent reach the driver. An inverted index from each rule's rarest token to the rule matches them; the rule
with the highest confidence decides, among equals that with the highest support, then the shortest, then the first in
the order of tokens and verdicts.

Defined results: a null URL, or one without "://", has empty host and path, no rule, and the verdict allow unless a mined
rule with no further condition applied. Repeated rows get a row each, and so do null page_ids. URLs of any length are used
whole. An empty table gives an empty result. Other columns
are not read. The driver and each matching task hold the rules that are left after pruning.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, ship

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT = 0.005
CONFIDENCE = 0.8
#: FP-growth is used if there can't be more frequent sets than this.
SETS = 1_000_000
#: Sets that a counting task holds before it hands on its counts.
HELD = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def query_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def rule_of(rules=RULES, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The fitting rule as a string, and its verdict; null where none fits. For a list of rules that fits in an expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest comes last and stands outermost
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(host: str = "host", path: str = "path", query: str = "query") -> Column:
    """t: top-level name, d: domain, h: the host labels before it, p1:, p2: and so on path segments and q: keys of the query (numbers as #), x: extension."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    numberless = lambda x: F.regexp_replace(x, r"[0-9]+", "#")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shown = F.transform(segments, lambda x, i: F.concat(F.lit("p"), (i + 1).cast("string"), F.lit(":"), numberless(x)))
    keys = F.filter(F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.array_distinct(
        F.concat(
            F.when(n >= 1, F.array(F.concat(F.lit("t:"), F.element_at(labels, -1)))).otherwise(F.array()),
            F.when(n >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array()),
            F.when(n >= 3, F.transform(F.slice(labels, 1, n - 2), lambda x: F.concat(F.lit("h:"), x))).otherwise(F.array()),
            shown,
            F.transform(keys, lambda x: F.concat(F.lit("q:"), numberless(x))),
            F.when(extension != "", F.array(F.concat(F.lit("x:"), extension))).otherwise(F.array()),
        )
    )


def _grow(live: set[tuple[int, ...]], code: dict[str, int]):
    """A mapInPandas function: counts, in each basket (items, verdict, n), the sets one larger all of whose subsets are live."""
    tree: dict = {}
    for own in live:
        node = tree
        for i in own:
            node = node.setdefault(i, {})
    depth = len(next(iter(live)))
    wanted: dict[tuple, bool] = {}

    def joined(node: dict, head: tuple, items: list[int]) -> Iterator[tuple]:
        own = [i for i in items if i in node]
        if len(head) < depth - 1:
            for i in own:
                yield from joined(node[i], (*head, i), items[bisect_right(items, i) :])
        else:
            for a, b in combinations(own, 2):
                yield (*head, a, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [(list(own), verdict, n) for (own, verdict), n in counts.items()]
            counts.clear()
            return pd.DataFrame(rows, columns=["items", "verdict", "n"])

        for rows in batches:
            for items, verdict, n in zip(rows["items"], rows["verdict"], rows["n"], strict=True):
                for own in joined(tree, (), sorted(code[t] for t in items)):
                    if (ok := wanted.get(own)) is None:
                        if len(wanted) > HELD:
                            wanted.clear()
                        ok = wanted[own] = all(own[:k] + own[k + 1 :] in live for k in range(len(own) - 2))
                    if ok:
                        counts[own, verdict] += n
                        if len(counts) > HELD:
                            yield flush()
        yield flush()

    return run


_LABEL = "\0=>"


def _grown(baskets: DataFrame, least: int, total: int, verdicts: list[str], confidence: float) -> list[dict]:
    """The rules by FP-growth over baskets of frequent tokens and labels."""
    from pyspark.ml.fpm import FPGrowth

    label = F.when(F.col("verdict").isNotNull(), F.array(F.concat(F.lit(_LABEL), "verdict"))).otherwise(F.array().cast("array<string>"))
    rows = baskets.select(F.concat("tokens", label).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / total)).fit(rows).freqItemsets
    own = F.array_sort(F.filter("items", lambda t: ~t.startswith(_LABEL)))
    of = F.filter("items", lambda t: t.startswith(_LABEL))
    sets = found.select(own.alias("own"), F.get(of, F.lit(0)).alias("label"), "freq").where(F.size("own") > 0)
    hits = [F.coalesce(F.max(F.when(F.col("label") == _LABEL + v, F.col("freq"))), F.lit(0)) for v in verdicts]
    sets = sets.groupBy("own").agg(F.max(F.when(F.col("label").isNull(), F.col("freq"))).alias("n"), F.array(*hits).alias("of"))
    sets = materialize(sets.withColumn("size", F.size("own")), "frequent_sets")
    rules: list[dict] = []
    before = None
    for size in range(1, (sets.agg(F.max("size")).first()[0] or 0) + 1):
        level = sets.where(F.col("size") == size)
        zero = F.array(*[F.lit(0.0) for _ in verdicts])
        if before is None:
            level = level.withColumn("known", zero)
        else:  # the highest confidence, by verdict, of a rule from a part
            without = F.explode(F.transform("own", lambda t: F.array_remove("own", t))).alias("part")
            parts = level.select("own", without).join(before.select(F.col("own").alias("part"), "best"), "part")
            best = F.array(*[F.max(F.get("best", F.lit(v))) for v in range(len(verdicts))])
            level = level.join(parts.groupBy("own").agg(best.alias("known")), "own")
        chance = F.transform("of", lambda x: F.when((x >= least) & (x / F.col("n") >= confidence), x / F.col("n")).otherwise(0.0))
        level = level.withColumn("chance", chance).withColumn("best", F.zip_with("chance", "known", lambda a, b: F.greatest(a, b)))
        before = materialize(level, "rule_level")
        for r in before.where(F.exists(F.zip_with("chance", "known", lambda a, b: a > b), lambda x: x)).collect():
            for v, verdict in enumerate(verdicts):
                if r["chance"][v] > r["known"][v]:
                    rules.append({"antecedent": r["own"], "verdict": verdict, "confidence": r["of"][v] / r["n"], "support": r["of"][v] / total})
    return rules


def mine(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sets: int = SETS) -> list[dict]:
    """Rules from rows with tokens and verdict (null: no label): antecedent, verdict, confidence, support; pruned, best first."""
    baskets = materialize(examples.select("tokens", "verdict").where((F.size("tokens") > 0) | F.col("verdict").isNotNull()), "baskets")
    verdicts = sorted(r[0] for r in baskets.where("verdict IS NOT NULL").select("verdict").distinct().collect())
    if not verdicts:
        return []
    total = baskets.count()
    least = max(1, math.ceil(support * total))
    tokens = baskets.select(F.explode("tokens").alias("token"))
    often = [r[0] for r in tokens.groupBy("token").count().where(F.col("count") >= least).select("token").collect()]
    few = baskets.select(F.filter("tokens", lambda t: t.isin(often)).alias("tokens"), "verdict")
    # A frequent set is in at least `least` baskets, and a basket has 2 ** size sets.
    most = few.agg(F.sum(F.pow(F.lit(2.0), F.size("tokens") + 1))).first()[0] / least
    rules = _grown(few, least, total, verdicts, confidence) if most <= sets else _by_level(baskets, least, total, verdicts, confidence)
    return sorted(rules, key=lambda r: (-r["confidence"], -r["support"], len(r["antecedent"]), r["antecedent"], r["verdict"]))


def _by_level(baskets: DataFrame, least: int, total: int, verdicts: list[str], confidence: float) -> list[dict]:
    """The same rules, level by level over live sets."""

    def frequent(rows: DataFrame, key: str) -> list:
        """(key, rows, rows of each verdict) of the sets that a verdict has often enough; the others stay where they are."""
        of = [F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)) for v in verdicts]
        sums = rows.groupBy(key).agg(F.sum("n").alias("n"), F.array(*of).alias("of"))
        return [(r[0], r["n"], r["of"]) for r in sums.where(F.array_max("of") >= least).collect()]

    rules: list[dict] = []
    # Of each live set: its rows and, by verdict, the highest confidence of a rule from it or a part of it.
    before: dict[tuple, tuple[int, list[float]]] = {(): (total + 1, [0.0] * len(verdicts))}
    tokens = baskets.select(F.explode("tokens").alias("token"), "verdict", F.lit(1).alias("n"))
    found = frequent(tokens, "token")
    names = sorted(t for t, _, _ in found)
    code = {t: i for i, t in enumerate(names)}
    level = [((code[t],), n, of) for t, n, of in found]
    sets = None
    while True:
        live: dict[tuple, tuple[int, list[float]]] = {}
        for own, n, of in level:
            parts = [before[own[:k] + own[k + 1 :]] for k in range(len(own))]
            if any(n == rows for rows, _ in parts):
                continue  # a part has the same rows, so it and what grows from it only repeat the part's rules
            best = [max(p[1][v] for p in parts) for v in range(len(verdicts))]
            for v, hits in enumerate(of):
                if hits >= least and hits / n >= confidence and hits / n > best[v]:
                    best[v] = hits / n
                    rules.append({"antecedent": [names[i] for i in own], "verdict": verdicts[v], "confidence": hits / n, "support": hits / total})
            if max(of) < n:  # else no larger set has a rule of more confidence
                live[own] = n, best
        if len(live) <= len(level[0][0]) if level else True:
            break  # a set of k + 1 needs k + 1 live parts
        if sets is None:
            items = F.array_sort(F.filter("tokens", lambda t: t.isin([names[i] for (i,) in live])))
            sets = baskets.select(items.alias("items"), "verdict").where(F.size("items") > 1)
            sets = materialize(sets.groupBy("items", "verdict").agg(F.count(F.lit(1)).alias("n")), "sets")
        grown = sets.mapInPandas(_grow(set(live), code), "items array<int>, verdict string, n long")
        before, level = live, [(tuple(own), n, of) for own, n, of in frequent(grown, "items")]
    return rules


class Matcher:
    """An inverted index: each rule under the token that the fewest rules have."""

    def __init__(self, rules: list[dict]):
        often = Counter(t for r in rules for t in r["antecedent"])
        self.index: dict[str, list[tuple[int, frozenset, str, float]]] = {}
        for place, r in enumerate(rules):
            rare = min(r["antecedent"], key=lambda t: (often[t], t))
            self.index.setdefault(rare, []).append((place, frozenset(r["antecedent"]), r["verdict"], r["confidence"]))

    def best(self, tokens) -> tuple[str | None, float | None]:
        own = set(tokens)
        hits = [rule for t in own for rule in self.index.get(t, ()) if rule[1] <= own]
        return min(hits)[2:] if hits else (None, None)


def judge(pages: DataFrame, rules=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that decided, else null) of each row of pages."""
    ship(pages.sparkSession)
    name, verdict = rule_of(rules)
    parts = pages.select("page_id", host_of().alias("host"), path_of().alias("path"), query_of().alias("query"))
    ruled = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), tokens_of().alias("tokens"))
    matcher = Matcher(mine(ruled.select("tokens", "verdict"), **how))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        for rows in batches:
            found = []
            for tokens in rows["tokens"]:
                key = tuple(tokens)
                if (hit := known.get(key)) is None:
                    if len(known) > 100_000:
                        known.clear()
                    hit = known[key] = matcher.best(key)
                found.append(hit)
            mined = pd.Series([h[0] for h in found], index=rows.index, dtype="object")
            chance = pd.Series([h[1] for h in found], index=rows.index, dtype="float64")
            out = rows.drop(columns=["tokens"])
            out["confidence"] = chance.where(rows["verdict"].isna())
            out["verdict"] = rows["verdict"].where(rows["verdict"].notna(), mined).fillna("allow")
            yield out

    kind = dict(pages.dtypes)["page_id"]
    return ruled.mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string, confidence double")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
