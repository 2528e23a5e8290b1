"""Queries of vectors, centroids and budget selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import discrepancy, selection
from pairloom.operators.pairs import centroids, mean_vector, small
from pairloom.plans.base import PAIRS, add_sql, fill_sql, half_sql, mean_sql, part, raw_pairs, singles, table, unit_pairs, unit_sql

QUERIES, ORACLES = {}, {}
BUDGET = 30


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


@query("pair_unpivot", f"WITH {PAIRS} SELECT domain, pair_idx, 0 AS side, pair_idx * 2 AS singleton_idx, round(l[1], 6) AS v0 FROM raw UNION ALL SELECT domain, pair_idx, 1, pair_idx * 2 + 1, round(r[1], 6) FROM raw")
def pair_unpivot(spark, d):
    sides = F.posexplode(F.array("l", "r")).alias("side", "v")
    return raw_pairs(spark, d).select("domain", "pair_idx", sides).select(
        "domain", "pair_idx", "side", (F.col("pair_idx") * 2 + F.col("side")).alias("singleton_idx"), r6(F.col("v")[0]).alias("v0")
    )


@query("unit_norm", f"SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(({unit_sql('v')})[1], 6) AS u0, round(list_sum({unit_sql('v')}), 6) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def unit_norm(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("v"))
    u = V.unit(F.col("v"))
    return rows.select("vec_id", r6(V.norm(F.col("v"))).alias("norm"), r6(u[0]).alias("u0"), r6(V.total(u)).alias("total"))


@query("pair_vectors", f"WITH {PAIRS} SELECT domain, pair_idx, split, round(up.v[1], 6) AS unit0, round(list_sum(up.v), 6) AS unit_total, round(list_sum({half_sql('raw.l', 'raw.r')}), 6) AS raw_total FROM up JOIN raw USING (domain, pair_idx, split)")
def pair_vectors(spark, d):
    u = V.unit_pair(F.col("l"), F.col("r"))
    return raw_pairs(spark, d).select(
        "domain", "pair_idx", "split", r6(u[0]).alias("unit0"), r6(V.total(u)).alias("unit_total"), r6(V.total(V.mean2(F.col("l"), F.col("r")))).alias("raw_total")
    )


@query("domain_centroid", f"WITH {PAIRS}, {mean_sql('c', 'train')} SELECT domain, k, round(x, 6) AS value, n FROM (SELECT domain, n, unnest({unit_sql('mean')}) AS x, CAST(unnest(range(0, len(mean))) AS INT) AS k FROM c)")
def domain_centroid(spark, d):
    c = centroids(part(unit_pairs(spark, d), "train"))
    return c.select("domain", "n", F.posexplode("centroid").alias("k", "x")).select("domain", "k", r6("x").alias("value"), "n")


@query("dataset_mean", "SELECT label AS domain, k, round(avg(x), 6) AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, CAST(unnest(range(0, len(embedding))) AS INT) AS k FROM embeddings) GROUP BY label, k")
def dataset_mean(spark, d):
    means = singles(spark, d).groupBy("domain").agg(mean_vector("v").alias("mean"))
    return means.select("domain", F.posexplode("mean").alias("k", "x")).select("domain", "k", r6("x").alias("value"))


@query("cosine_score", "WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, CAST(a.label = b.label AS INT) AS label, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def cosine_score(spark, d):
    return scored_pairs(spark, d).select("vec_id", "label", r6("score").alias("score"))


def scored_pairs(spark, d):
    """vec_id, domain, label, score: each vector with the next one by id; the label says if their domains agree."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("domain"), V.doubles("embedding").alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("domain").alias("next"), F.col("v").alias("w"))
    return rows.join(after, "vec_id").select(
        "vec_id", "domain", (F.col("domain") == F.col("next")).cast("int").alias("label"), V.cosine(F.col("v"), F.col("w")).alias("score")
    )


_NN = f"""
WITH {PAIRS}, {mean_sql('c', 'train')},
goal AS (SELECT domain AS target, {unit_sql('mean')} AS g FROM c)
"""


@query("nn_distance", _NN + "SELECT target, domain AS donor, pair_idx, round(list_distance(v, g), 6) AS distance FROM train JOIN goal ON domain <> target")
def nn_distance(spark, d):
    train = part(unit_pairs(spark, d), "train")
    goals = centroids(train).select(F.col("domain").alias("target"), "centroid")
    rows = train.join(small(goals), F.col("domain") != F.col("target"))
    return rows.select("target", F.col("domain").alias("donor"), "pair_idx", r6(V.distance(F.col("v"), F.col("centroid"))).alias("distance"))


@query("select_nn", _NN + ", " + fill_sql("SELECT target, domain AS donor, pair_idx, list_distance(v, g) AS score FROM train JOIN goal ON domain <> target", BUDGET))
def select_nn(spark, d):
    return selection.nearest(part(unit_pairs(spark, d), "train"), BUDGET)


_NONE = "SELECT 0 AS target, 0 AS donor, 0 AS pair_idx, 0.0 AS score WHERE false"


@query("select_spec", f"WITH {PAIRS}, " + fill_sql(_NONE, 10))
def select_spec(spark, d):
    return selection.spec(part(unit_pairs(spark, d), "train"), 10)


@query("oversample", f"WITH {PAIRS}, " + fill_sql(_NONE, 400))
def oversample(spark, d):
    return selection.spec(part(unit_pairs(spark, d), "train"), 400)


@query("select_gen", f"""WITH {PAIRS},
pool AS (SELECT t.domain AS target, p.domain AS donor, p.pair_idx,
         row_number() OVER (PARTITION BY t.domain ORDER BY md5(concat_ws('|', '22', t.domain, p.domain, p.pair_idx)), p.domain, p.pair_idx) - 1 AS pos
         FROM (SELECT DISTINCT domain FROM train) t CROSS JOIN train p),
base AS (SELECT * FROM pool WHERE pos < {BUDGET}),
size AS (SELECT target, count(*) AS m FROM base GROUP BY target),
filled AS (SELECT target, rep * m + pos AS out_pos, donor, pair_idx FROM base JOIN size USING (target), LATERAL (SELECT unnest(range(0, CAST(ceil({BUDGET} / m) AS BIGINT))) AS rep))
SELECT target, CAST(out_pos AS BIGINT) AS out_pos, donor, pair_idx FROM filled WHERE out_pos < {BUDGET}""")
def select_gen(spark, d):
    return selection.general(part(unit_pairs(spark, d), "train"), BUDGET)


def _gain_sql(split: str) -> str:
    return f"""
WITH {PAIRS}, {mean_sql('c', 'train')}, goals AS (SELECT * FROM up WHERE split = '{split}'), {mean_sql('g', 'goals')},
state AS (SELECT c.domain AS target, c.mean, c.n, g.mean AS goal, list_cosine_similarity(c.mean, g.mean) AS sim FROM c JOIN g USING (domain)),
gains AS (SELECT target, t.domain AS donor, t.pair_idx,
          list_cosine_similarity(list_transform(list_zip(mean, v), lambda z: (z[1] * n + z[2]) / (n + 1)), goal) - sim AS gain
          FROM train t JOIN state ON t.domain <> target)
"""


@query("centroid_gain", _gain_sql("val") + "SELECT target, donor, pair_idx, round(gain, 6) AS gain FROM gains")
def centroid_gain(spark, d):
    pairs = unit_pairs(spark, d)
    train, goals = part(pairs, "train"), part(pairs, "val").groupBy("domain").agg(mean_vector("v").alias("goal"))
    state = train.groupBy("domain").agg(mean_vector("v").alias("mean"), F.count(F.lit(1)).alias("m")).join(goals, "domain").withColumnRenamed("domain", "target")
    rows = train.join(small(state), F.col("domain") != F.col("target"))
    gain = selection.gain(F.col("v"), F.col("mean"), F.col("m"), F.col("goal"))
    return rows.select("target", F.col("domain").alias("donor"), "pair_idx", r6(gain).alias("gain"))


def _shift(split: str):
    def run(spark, d):
        pairs = unit_pairs(spark, d)
        goals = part(pairs, split).groupBy("domain").agg(mean_vector("v").alias("goal"))
        return selection.shift(part(pairs, "train"), goals, BUDGET)

    return run


for _name, _split in (("select_tv", "val"), ("select_tt", "test"), ("select_tm", "train")):
    query(_name, _gain_sql(_split) + ", " + fill_sql("SELECT target, donor, pair_idx, -gain AS score FROM gains", BUDGET))(_shift(_split))


@query("select_tv_singleton", f"""
WITH {PAIRS}, tr AS (SELECT domain, pair_idx, l, r, {half_sql('l', 'r')} AS h FROM raw WHERE split = 'train'),
va AS (SELECT domain, {half_sql('l', 'r')} AS h FROM raw WHERE split = 'val'),
{mean_sql('c', 'tr', 'h')}, {mean_sql('g', 'va', 'h')},
state AS (SELECT c.domain AS target, c.mean, 2 * c.n AS n, g.mean AS goal, list_cosine_similarity(c.mean, g.mean) AS sim FROM c JOIN g USING (domain)),
gains AS (SELECT target, t.domain AS donor, t.pair_idx,
          list_cosine_similarity(list_transform(list_zip(mean, {add_sql('l', 'r')}), lambda z: (z[1] * n + z[2]) / (n + 2)), goal) - sim AS gain
          FROM tr t JOIN state ON t.domain <> target), """ + fill_sql("SELECT target, donor, pair_idx, -gain AS score FROM gains", BUDGET))
def select_tv_singleton(spark, d):
    pairs = raw_pairs(spark, d)
    val = part(pairs, "val").withColumn("half", V.mean2(F.col("l"), F.col("r")))
    return selection.shift_singles(part(pairs, "train"), val.groupBy("domain").agg(mean_vector("half").alias("goal")), BUDGET)


_KERNEL = f"""
tr AS (SELECT domain, pair_idx, l, r FROM raw WHERE split = 'train'),
tsing AS (SELECT domain, l AS x FROM tr UNION ALL SELECT domain, r FROM tr),
goalp AS (SELECT domain, {half_sql('l', 'r')} AS y FROM raw WHERE split = 'val')
"""


@query("select_kde", f"""
WITH {PAIRS}, {_KERNEL},
tk AS (SELECT domain, k, sum(v) AS s, count(*) AS n FROM (SELECT domain, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM tsing) GROUP BY domain, k),
gk AS (SELECT domain, unnest(y) AS y, unnest(range(1, len(y) + 1)) AS k FROM goalp),
ck AS (SELECT domain, pair_idx, unnest({add_sql('l', 'r')}) AS c, unnest(range(1, len(l) + 1)) AS k FROM tr),
b AS (SELECT domain, k, ln(avg(exp(-2 * (s / n - y) * (s / n - y)))) AS lp FROM tk JOIN gk USING (domain, k) GROUP BY domain, k),
a AS (SELECT t.domain AS target, c.domain AS donor, c.pair_idx, t.k, ln(avg(exp(-2 * ((s + c) / (n + 2) - y) * ((s + c) / (n + 2) - y)))) AS lp
      FROM tk t JOIN ck c ON c.k = t.k AND c.domain <> t.domain JOIN gk ON gk.domain = t.domain AND gk.k = t.k GROUP BY ALL),
gains AS (SELECT target, donor, pair_idx, avg(a.lp - b.lp) AS gain FROM a JOIN b ON b.domain = target AND b.k = a.k GROUP BY ALL), """ + fill_sql("SELECT target, donor, pair_idx, -gain AS score FROM gains", BUDGET))
def select_kde(spark, d):
    pairs = raw_pairs(spark, d)
    return selection.kde(part(pairs, "train"), part(pairs, "val"), BUDGET)


_K = lambda a, b: f"exp(-list_distance({a}, {b}) * list_distance({a}, {b}) / len({a}))"


@query("select_mmd", f"""
WITH {PAIRS}, {_KERNEL},
xx AS (SELECT a.domain, sum({_K('a.x', 'b.x')}) AS xx FROM tsing a JOIN tsing b USING (domain) GROUP BY a.domain),
xy AS (SELECT a.domain, sum({_K('a.x', 'g.y')}) AS xy FROM tsing a JOIN goalp g USING (domain) GROUP BY a.domain),
n AS (SELECT domain, count(*) AS n FROM tsing GROUP BY domain), m AS (SELECT domain, count(*) AS m FROM goalp GROUP BY domain),
cx AS (SELECT s.domain AS target, c.domain AS donor, c.pair_idx, sum({_K('c.l', 's.x')} + {_K('c.r', 's.x')}) AS cx, any_value({_K('c.l', 'c.r')}) AS lr
       FROM tr c JOIN tsing s ON c.domain <> s.domain GROUP BY ALL),
cy AS (SELECT g.domain AS target, c.domain AS donor, c.pair_idx, sum({_K('c.l', 'g.y')} + {_K('c.r', 'g.y')}) AS cy
       FROM tr c JOIN goalp g ON c.domain <> g.domain GROUP BY ALL),
gains AS (SELECT cx.target, donor, pair_idx, (xx / (n * n) - 2 * xy / (n * m)) - ((xx + 2 * cx + 2 + 2 * lr) / ((n + 2) * (n + 2)) - 2 * (xy + cy) / ((n + 2) * m)) AS gain
          FROM cx JOIN cy USING (target, donor, pair_idx) JOIN xx ON xx.domain = target JOIN xy ON xy.domain = target
          JOIN n ON n.domain = target JOIN m ON m.domain = target), """ + fill_sql("SELECT target, donor, pair_idx, -gain AS score FROM gains", BUDGET))
def select_mmd(spark, d):
    pairs = raw_pairs(spark, d)
    return selection.mmd(part(pairs, "train"), part(pairs, "val"), BUDGET)


@query("mmd_by_domain", f"""
WITH {PAIRS}, {_KERNEL},
x AS (SELECT domain, {half_sql('l', 'r')} AS x FROM tr),
xx AS (SELECT a.domain, avg({_K('a.x', 'b.x')}) AS v FROM x a JOIN x b USING (domain) GROUP BY a.domain),
yy AS (SELECT a.domain, avg({_K('a.y', 'b.y')}) AS v FROM goalp a JOIN goalp b USING (domain) GROUP BY a.domain),
xy AS (SELECT a.domain, avg({_K('a.x', 'b.y')}) AS v FROM x a JOIN goalp b USING (domain) GROUP BY a.domain)
SELECT domain, round(xx.v + yy.v - 2 * xy.v, 6) AS mmd FROM xx JOIN yy USING (domain) JOIN xy USING (domain)""")
def mmd_by_domain(spark, d):
    """Train pairs against validation pairs, by kernel means over blocks of pairs."""
    rows = discrepancy.mmd_by_domain(_halves(spark, d))
    return rows.select("domain", r6("mmd").alias("mmd"))


def _halves(spark, d):
    pairs = raw_pairs(spark, d).where("split <> 'test'")
    return pairs.select("domain", "pair_idx", F.col("split").alias("kind"), V.mean2(F.col("l"), F.col("r")).alias("v"))


@query("kde1d_logdensity", f"""
WITH {PAIRS}, {_KERNEL},
gk AS (SELECT domain, unnest(y) AS y, unnest(range(1, len(y) + 1)) AS k FROM goalp),
tk AS (SELECT domain, pair_idx, unnest({half_sql('l', 'r')}) AS x, unnest(range(1, len(l) + 1)) AS k FROM tr),
p AS (SELECT domain, pair_idx, k, ln(sum(exp(-2 * (x - y) * (x - y))) / (count(*) * 0.5 * sqrt(2 * pi()))) AS lp FROM tk JOIN gk USING (domain, k) GROUP BY ALL)
SELECT domain, pair_idx, round(avg(lp), 6) AS log_density FROM p GROUP BY domain, pair_idx""")
def kde1d_logdensity(spark, d):
    out = discrepancy.log_densities(_halves(spark, d))
    return out.select("domain", "pair_idx", r6("log_density").alias("log_density"))


@query("silverman_bandwidth", f"""
WITH {PAIRS}, m AS (SELECT domain, {half_sql('l', 'r')} AS v FROM raw),
k AS (SELECT domain, v[1] AS x, v[2] AS y FROM m),
q AS (SELECT domain, count(*) AS n, least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) AS a,
             least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) AS b FROM k GROUP BY domain)
SELECT domain, n, round(CASE WHEN n < 5 THEN 1.0 ELSE greatest(1.06 * (a + b) / 2 * pow(n, -0.2), 0.001) END, 6) AS bandwidth FROM q""")
def silverman_bandwidth(spark, d):
    v = V.mean2(F.col("l"), F.col("r"))
    rows = raw_pairs(spark, d).select("domain", v[0].alias("x"), v[1].alias("y"))
    n = F.count(F.lit(1))
    return rows.groupBy("domain").agg(n.alias("n"), r6(discrepancy.silverman(F.col("x"), F.col("y"), n)).alias("bandwidth"))


@query("select_kde2d")
def select_kde2d(spark, d):
    pairs = raw_pairs(spark, d)
    return selection.kde2d(part(pairs, "train"), part(pairs, "val"), BUDGET)


@query("select_kcg", f"""
WITH RECURSIVE {PAIRS},
cnt0 AS (SELECT domain AS target, count(*) AS n FROM train GROUP BY domain),
cand AS (SELECT t.target, t.n, c.domain AS donor, c.pair_idx, c.v, (SELECT min(1 - list_inner_product(c.v, o.v)) FROM train o WHERE o.domain = t.target) AS d0
         FROM cnt0 t JOIN train c ON c.domain <> t.target WHERE t.n < {BUDGET}),
g AS (SELECT 0 AS step, target, n, donor, pair_idx, v, d0 AS md, false AS done, row_number() OVER (PARTITION BY target ORDER BY round(d0, 9) DESC, donor, pair_idx) = 1 AS pick FROM cand
      UNION ALL
      SELECT step + 1, target, n, donor, pair_idx, v, md, done, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN done THEN 1 ELSE 0 END, round(md, 9) DESC, donor, pair_idx) = 1 AS pick
      FROM (SELECT g.step, g.target, g.n, g.donor, g.pair_idx, g.v, least(g.md, 1 - list_inner_product(g.v, p.v)) AS md, g.done OR g.pick AS done
            FROM g JOIN g p ON p.target = g.target AND p.pick) WHERE step + 1 < {BUDGET} - n),
scored AS (SELECT target, donor, pair_idx, CAST(step AS DOUBLE) AS score FROM g WHERE pick AND NOT done), """ + fill_sql("SELECT * FROM scored", BUDGET))
def select_kcg(spark, d):
    return selection.k_center(part(unit_pairs(spark, d), "train"), BUDGET)


@query("single_domain_nn", _NN + ", " + fill_sql("SELECT target, domain AS donor, pair_idx, list_distance(v, g) AS score FROM train JOIN goal ON domain <> target", BUDGET).replace("FROM filled WHERE", "FROM filled WHERE target = 3 AND"))
def single_domain_nn(spark, d):
    """One target only: the filter is on the target side, donors still come from all domains."""
    return select_nn(spark, d).where(F.col("target") == 3)


@query("pooled_valid", f"""
WITH {PAIRS}, v AS (SELECT domain, pair_idx FROM up WHERE split = 'val'), n AS (SELECT domain, count(*) AS n FROM v GROUP BY domain)
SELECT n.domain AS target, v.domain, v.pair_idx FROM n JOIN v ON n.n < 6 OR v.domain = n.domain""")
def pooled_valid(spark, d):
    """A domain with few validation rows takes all domains'."""
    from pairloom.operators.datasets import pooled_validation

    return pooled_validation(part(unit_pairs(spark, d), "val").select("domain", "pair_idx"), 6)


def _sub(name: str, method: str) -> str:
    return f"SELECT *, '{method}' AS method FROM ({ORACLES[name]})"


@query("mix_encodings", f"WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * 0.8 + z[2] * 0.2)), 6) AS total FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def mix_encodings(spark, d):
    """An encoding joined with that of an augmented text (here: the next vector) by a share drawn once a batch."""
    rows = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(after, "vec_id").select("vec_id", r6(V.total(V.mixed(F.col("v"), F.col("w"), F.lit(0.8)))).alias("total"))


@query("select_ensemble", f"WITH {PAIRS}, spec AS (WITH x AS (SELECT 1), {fill_sql(_NONE, BUDGET)}) SELECT *, 'spec' AS method FROM spec UNION ALL {_sub('select_nn', 'nn')} UNION ALL {_sub('select_mmd', 'tv_mmd')}")
def select_ensemble(spark, d):
    """The training sets of an ensemble, one per method."""
    from pairloom.operators import methods

    return methods.select_ensemble(raw_pairs(spark, d), "spec-nn-tv_mmd", BUDGET)


_GRID = f"""
WITH {PAIRS}, g AS (SELECT * FROM (SELECT unnest([22, 42]) AS seed) CROSS JOIN (SELECT unnest([5, 10]) AS budget)),
r AS (SELECT seed, budget, domain, row_number() OVER (PARTITION BY seed, budget, domain ORDER BY md5(concat_ws('|', seed, domain, pair_idx)), pair_idx) - 1 AS pos, pair_idx,
      count(*) OVER (PARTITION BY seed, budget, domain) AS n FROM g CROSS JOIN train)
SELECT CAST(seed AS INT) AS seed, CAST(budget AS INT) AS budget, domain AS target, CAST(pos AS BIGINT) AS out_pos, pair_idx FROM r WHERE n >= budget AND pos < budget
"""


@query("budget_grid", _GRID)
def budget_grid(spark, d):
    """Seeds by budgets of one method; here the domains with enough rows of their own."""
    from pairloom.operators import methods

    pairs = raw_pairs(spark, d)
    rich = part(pairs, "train").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    out = methods.grid((22, 42), (5, 10), ("spec",), lambda s, b, m: methods.select(pairs, m, b, s))
    return out.join(rich, F.col("target") == F.col("domain")).where("n >= budget").select("seed", "budget", "target", "out_pos", "pair_idx")
