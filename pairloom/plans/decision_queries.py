"""Queries of scores, thresholds, votes, metrics, reports and the pluggable scorers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.functions import records as R
from pairloom.operators import matcher, metrics
from pairloom.plans import text_queries
from pairloom.plans.base import table
from pairloom.plans.selection_queries import scored_pairs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


# Gold labels against a rule on the text's length, by language.
_JUDGED = "j AS (SELECT d.doc_id, d.lang AS domain, d.source, l.quality AS label, CAST(d.n_chars > 1500 AS INT) AS match, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS p FROM documents d JOIN labels l USING (doc_id))"


def judged(spark, d):
    docs, gold = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, d, "labels")
    return docs.join(gold, "doc_id").select(
        "doc_id", "n_chars", F.col("lang").alias("domain"), "source", F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("match"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p"),
    )


_COUNTS = "count(*) FILTER (match = 1 AND label = 1) AS tp, count(*) FILTER (match = 1 AND label = 0) AS fp, count(*) FILTER (match = 0 AND label = 1) AS fn"
_PRF = "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall"
_F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"


@query("prf1_by_domain", f"WITH {_JUDGED}, c AS (SELECT domain, {_COUNTS} FROM j GROUP BY domain), p AS (SELECT *, {_PRF} FROM c) SELECT domain, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM p")
def prf1_by_domain(spark, d):
    c = judged(spark, d).groupBy("domain").agg(*metrics.confusion(F.col("match"), F.col("label")))
    return metrics.with_scores(c).select("domain", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


def _sweep_sql(scored: str, n: int, step: str) -> str:
    return f"""
g AS (SELECT domain, i, {step} AS t, CAST(score > {step} AS INT) AS match, label FROM ({scored}) CROSS JOIN (SELECT unnest(range(0, {n})) AS i)),
c AS (SELECT domain, i, any_value(t) AS t, {_COUNTS} FROM g GROUP BY domain, i), p AS (SELECT *, {_PRF} FROM c), f AS (SELECT *, {_F1} AS f1 FROM p),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY domain ORDER BY f1 DESC, i) = 1)
SELECT domain, round(CASE WHEN f1 > 0 THEN t ELSE 0.5 END, 6) AS threshold, round(f1, 6) AS f1 FROM b"""


def _shown(best):
    return best.select("domain", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query("threshold_sweep_pairwise", f"WITH {_JUDGED}, " + _sweep_sql("SELECT domain, p AS score, label FROM j", 20, "i * CAST(0.05 AS DOUBLE)"))
def threshold_sweep_pairwise(spark, d):
    return _shown(metrics.sweep(judged(spark, d).withColumnRenamed("p", "score"), ["domain"], metrics.PAIRWISE))


_COS = "SELECT a.label AS domain, CAST(a.label = b.label AS INT) AS label, list_cosine_similarity(a.v, b.v) AS score FROM s a JOIN s b ON b.vec_id = a.vec_id + 1"
_S = "s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("threshold_sweep_cosine", f"WITH {_S}, " + _sweep_sql(_COS, 101, "i * CAST(0.01 AS DOUBLE)"))
def threshold_sweep_cosine(spark, d):
    return _shown(metrics.sweep(scored_pairs(spark, d), ["domain"], metrics.COSINE))


@query("domain_weights", "SELECT lang AS domain, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS weight FROM documents GROUP BY lang")
def domain_weights(spark, d):
    w = metrics.domain_weights(table(spark, d, "documents").withColumnRenamed("lang", "domain"))
    return w.select("domain", "n", r6("weight").alias("weight"))


_DOM = f"WITH {_JUDGED}, c AS (SELECT domain, {_COUNTS} FROM j GROUP BY domain), p AS (SELECT *, {_PRF} FROM c), f AS (SELECT domain, {_F1} AS f1 FROM p), w AS (SELECT lang AS domain, count(*) AS w FROM documents GROUP BY lang)"


@query("macro_weighted_f1", _DOM + " SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * w) / sum(w), 6) AS weighted_f1 FROM f JOIN w USING (domain)")
def macro_weighted_f1(spark, d):
    f1 = metrics.with_scores(judged(spark, d).groupBy("domain").agg(*metrics.confusion(F.col("match"), F.col("label")))).select("domain", "f1")
    out = metrics.averages(f1, metrics.domain_weights(table(spark, d, "documents").withColumnRenamed("lang", "domain")).select("domain", "weight"))
    return out.select(r6("macro_f1").alias("macro_f1"), r6("weighted_f1").alias("weighted_f1"))


_RUNS = f"WITH {_JUDGED}, s AS (SELECT unnest([22, 42, 62, 82]) AS seed), x AS (SELECT seed, j.* REPLACE (CAST(n_chars > 1000 + 12 * seed AS INT) AS match) FROM j JOIN documents USING (doc_id) CROSS JOIN s), c AS (SELECT seed, domain, {_COUNTS} FROM x GROUP BY seed, domain), p AS (SELECT *, {_PRF} FROM c), f AS (SELECT *, {_F1} AS f1 FROM p), l AS (SELECT seed, domain, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM f)"


def runs(spark, d):
    """seed, domain, metric, value: all documents judged in each run, by a rule that the seed shifts."""
    rows = judged(spark, d).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (22, 42, 62, 82)])))
    rows = rows.withColumn("match", (F.col("n_chars") > 1000 + 12 * F.col("seed")).cast("int"))
    f = metrics.with_scores(rows.groupBy("seed", "domain").agg(*metrics.confusion(F.col("match"), F.col("label"))))
    return f.unpivot(["seed", "domain"], ["precision", "recall", "f1"], "metric", "value")


@query("metric_mean_std", _RUNS + " SELECT domain, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS runs FROM l GROUP BY domain, metric")
def metric_mean_std(spark, d):
    out = metrics.spread(runs(spark, d), ["domain", "metric"])
    return out.select("domain", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "runs")


@query("metric_report", _RUNS + " SELECT 30 AS budget, printf('%s %s: %.4f', domain, metric, round(avg(value), 9)) || printf(' ± %.4f', round(stddev_pop(value), 9)) AS line FROM l GROUP BY domain, metric")
def metric_report(spark, d):
    from pairloom.sources.files import report

    return report(metrics.spread(runs(spark, d), ["domain", "metric"]).withColumn("budget", F.lit(30)))


@query("classify", f"WITH {_JUDGED} SELECT doc_id, CAST(p > 0.5 AS INT) AS match, round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 6) AS match_confidence FROM j")
def classify(spark, d):
    match = R.decide(F.col("p"))
    return judged(spark, d).select("doc_id", match.alias("match"), r6(R.confidence(F.col("p"), match)).alias("match_confidence"))


@query("late_fusion", f"WITH {_S}, x AS ({_COS.replace('SELECT a.label', 'SELECT a.vec_id, a.label')}) SELECT vec_id, CAST(round(score, 9) > 0.3 AS INT) AS match, round(score, 6) AS match_confidence FROM x")
def late_fusion(spark, d):
    """Decisions on the cosine of two records' encodings, which is the confidence too."""
    rows = scored_pairs(spark, d)
    match = R.decide(F.round("score", 9), 0.3)
    return rows.select("vec_id", match.alias("match"), r6(R.confidence(F.col("score"), match, late_fusion=True)).alias("match_confidence"))


@query("softmax_prob", "SELECT doc_id, round(1 / (1 + exp(CAST(n_chars % 7 AS DOUBLE) - CAST(n_chars % 5 AS DOUBLE))), 6) AS prob FROM documents")
def softmax_prob(spark, d):
    l0, l1 = (F.col("n_chars") % 7).cast("double"), (F.col("n_chars") % 5).cast("double")
    return table(spark, d, "documents").select("doc_id", r6(R.positive_chance(l0, l1)).alias("prob"))


_VOTES = f"WITH {_S}, v AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS c, CAST(a.vec_id % 10 AS DOUBLE) / 10 AS m, CAST(a.label AS DOUBLE) / 10 AS q FROM s a JOIN s b ON b.vec_id = a.vec_id + 1)"


def votes(spark, d):
    """vec_id, method, prob: three deterministic scores of each pair."""
    rows = scored_pairs(spark, d)
    probs = F.array(
        F.struct(F.lit("cosine").alias("method"), F.col("score").alias("prob")), F.struct(F.lit("place").alias("method"), ((F.col("vec_id") % 10).cast("double") / 10).alias("prob")),
        F.struct(F.lit("domain").alias("method"), (F.col("domain").cast("double") / 10).alias("prob")),
    )
    return rows.select("vec_id", F.explode(probs).alias("x")).select("vec_id", "x.method", "x.prob")


@query("soft_vote", _VOTES + " SELECT vec_id, round((c + m + q) / 3, 6) AS prob, CAST(round((c + m + q) / 3, 9) > 0.5 AS INT) AS match FROM v")
def soft_vote(spark, d):
    return metrics.vote(votes(spark, d), ["vec_id"]).select("vec_id", r6("prob").alias("prob"), R.decide(F.round("prob", 9)).alias("match"))


@query("soft_vote_weighted", _VOTES + " SELECT vec_id, round((0.5 * c + 1 * m + 0.25 * q) / 1.75, 6) AS prob FROM v")
def soft_vote_weighted(spark, d):
    return metrics.vote(votes(spark, d), ["vec_id"], {"cosine": 0.5, "place": 1.0, "domain": 0.25}, "soft_vote_weighted").select("vec_id", r6("prob").alias("prob"))


@query("select_best_method", _RUNS + " SELECT domain, seed, round(value, 6) AS f1 FROM l WHERE metric = 'f1' AND value > 0 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY value DESC, seed) = 1")
def select_best_method(spark, d):
    """A domain's best run by F1; of equal ones the first stays."""
    f1 = runs(spark, d).where("metric = 'f1'").withColumnRenamed("value", "f1")
    return metrics.first_best(f1, ["domain"], "f1", "seed", []).select("domain", "seed", r6("f1").alias("f1"))


@query("keep_lower_budget", _RUNS + ", o AS (SELECT domain, seed AS budget, value AS f1, max(value) OVER (PARTITION BY domain ORDER BY seed ROWS UNBOUNDED PRECEDING) AS best FROM l WHERE metric = 'f1') SELECT domain, budget, round(f1, 6) AS f1, round(best, 6) AS best_so_far FROM o")
def keep_lower_budget(spark, d):
    """The best F1 of this and all lower budgets."""
    f1 = runs(spark, d).where("metric = 'f1'").select("domain", F.col("seed").alias("budget"), F.col("value").alias("f1"))
    return metrics.best_so_far(f1, ["domain"], "f1", "budget").select("domain", "budget", r6("f1").alias("f1"), r6("best").alias("best_so_far"))


@query("pair_losses", f"WITH {_S}, x AS ({_COS}) SELECT domain, round(avg(-ln(greatest(CASE WHEN label = 1 THEN 1 / (1 + exp(-score)) ELSE 1 - 1 / (1 + exp(-score)) END, 1e-12))), 6) AS cross_entropy, round(avg(-ln(greatest(CASE WHEN label = 1 THEN 1 / (1 + exp(-score)) ELSE 1 - 1 / (1 + exp(-score)) END, 1e-12))) + 0.5 * (coalesce(avg(1 - score) FILTER (label = 1), 0) + coalesce(avg(greatest(score, 0)) FILTER (label = 0), 0)), 6) AS dual, round(coalesce(avg(1 - score) FILTER (label = 1), 0) + coalesce(avg(greatest(score, 0)) FILTER (label = 0), 0), 6) AS cosine_loss FROM x GROUP BY domain")
def pair_losses(spark, d):
    p = 1 / (1 + F.exp(-F.col("score")))
    all_ = metrics.losses(p, F.col("score"), F.col("label"), 0.5)
    return scored_pairs(spark, d).groupBy("domain").agg(*[r6(all_[k]).alias(k) for k in ("cross_entropy", "cosine_loss", "dual")])


@query("budget_log_scan", """
WITH l AS (SELECT file, no, CASE WHEN no % 4 = 0 THEN 'STARTING BUDGET: ' || CAST((no // 4 + 1) * 1000 AS VARCHAR) ELSE 'd' || CAST(no % 3 AS VARCHAR) || ' F1: 0.' || CAST(no AS VARCHAR) END AS line
 FROM (SELECT p_size AS file, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS no FROM part))
SELECT CAST(file AS VARCHAR) AS file, CAST((no // 4 + 1) * 1000 AS INT) AS budget, 'd' || CAST(no % 3 AS VARCHAR) AS domain, 'F1' AS metric, round(CAST('0.' || CAST(no AS VARCHAR) AS DOUBLE), 6) AS value FROM l WHERE no % 4 <> 0""")
def budget_log_scan(spark, d):
    from pairloom.sources.files import parse_budget_log

    place = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1
    rows = table(spark, d, "part").select(F.col("p_size").cast("string").alias("file"), place.alias("line_no"))
    n = F.col("line_no")
    head = F.concat(F.lit("STARTING BUDGET: "), ((F.floor(n / 4) + 1) * 1000).cast("string"))
    line = F.when(n % 4 == 0, head).otherwise(F.concat(F.lit("d"), (n % 3).cast("string"), F.lit(" F1: 0."), n.cast("string")))
    return parse_budget_log(rows.withColumn("line", line)).select("file", "budget", "domain", "metric", r6("value").alias("value"))


@query("zero_shot_log_scan", "SELECT 'wdc_' || p_brand AS domain, 'Recall' AS metric, round(p_size / 100, 6) AS value FROM part")
def zero_shot_log_scan(spark, d):
    from pairloom.sources.files import parse_zero_shot_log

    line = F.concat(F.lit("wdc_"), "p_brand", F.lit("_test.txt Recall: "), (F.col("p_size") / 100).cast("string"))
    return parse_zero_shot_log(table(spark, d, "part").select(line.alias("line"))).select("domain", "metric", r6("value").alias("value"))


@query("zero_shot", text_queries.ORACLES["shared_tokens"].replace("SELECT pair_id, len(", "SELECT pair_id, label, CAST(len(").rsplit(" AS shared FROM pairs", 1)[0] + " > 10 AS INT) AS match FROM pairs")
def zero_shot(spark, d):
    """Prompts answered by an injected callable; here one that says Yes if the entities share over 10 words."""

    def ask(prompt: str) -> str:
        a, b = prompt.split("Entity A:\n")[1].split("\n\nEntity B:\n")
        words = lambda s: set(s.lower().split(" "))
        return "Yes" if len(words(a) & words(b)) > 10 else "No"

    return matcher.zero_shot(text_queries.pairs(spark, d), ask).select("pair_id", "label", "match")


@query("lexical_matcher")
def lexical_matcher(spark, d):
    """A trained baseline: logistic regression on lexical features, with its tuned threshold."""
    pairs = text_queries.pairs(spark, d)
    model = matcher.train(matcher.features(pairs).where("pair_id % 5 <= 2"))
    return matcher.score(model, matcher.features(pairs)).select("pair_id", "label", r6("prob").alias("prob"), R.decide(F.col("prob")).alias("match"))


@query("dynamic_resample")
def dynamic_resample(spark, d):
    """Selection again on vectors that have moved, as between training epochs."""
    from pairloom.functions import vectors as V
    from pairloom.operators import selection
    from pairloom.plans.base import part, unit_pairs

    fresh = matcher.re_embed(part(unit_pairs(spark, d), "train"), lambda x: x + 0.05 * (x * x))
    return selection.nearest(fresh.withColumn("v", V.unit(F.col("v"))), 30)


@query("ensemble_predict", _VOTES + ", t AS (SELECT vec_id, round((c + m + q) / 3, 9) AS p FROM v) SELECT vec_id, CAST(p > 0.3 AS INT) AS match, round(CASE WHEN p > 0.3 THEN p ELSE 1 - p END, 6) AS match_confidence FROM t")
def ensemble_predict(spark, d):
    p = metrics.vote(votes(spark, d), ["vec_id"]).withColumn("prob", F.round("prob", 9))
    match = R.decide(F.col("prob"), 0.3)
    return p.select("vec_id", match.alias("match"), r6(R.confidence(F.col("prob"), match)).alias("match_confidence"))
