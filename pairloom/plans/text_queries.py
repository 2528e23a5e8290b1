"""Queries of records, prompts, TF-IDF, summaries and augmentation over pairs of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import records as R
from pairloom.operators import augment, datasets, selection, tagging, text
from pairloom.operators.pairs import numbered, split_of
from pairloom.plans.base import fill_sql, table
from pairloom.sources.tables import written

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def pairs(spark, d):
    """pair_id, domain (left brand), left, right, label (same brand): parts 2i and 2i+1."""
    part = table(spark, d, "part")
    rec = R.serialize(("name", F.col("p_name")), ("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size")))
    rows = part.select(F.expr("p_partkey div 2").alias("pair_id"), (F.col("p_partkey") % 2 == 1).alias("second"), "p_brand", F.rtrim(rec).alias("rec"))
    side = lambda c, second: F.max(F.when(F.col("second") == second, F.col(c)))
    both = rows.groupBy("pair_id").agg(
        side("p_brand", False).alias("domain"), side("rec", False).alias("left"), side("rec", True).alias("right"), side("p_brand", True).alias("other")
    )
    return both.where("right IS NOT NULL AND left IS NOT NULL").select("pair_id", "domain", "left", "right", (F.col("domain") == F.col("other")).cast("int").alias("label"))


REC = "rtrim('COL name VAL ' || coalesce(p_name, '') || ' COL brand VAL ' || coalesce(p_brand, '') || ' COL type VAL ' || coalesce(p_type, '') || ' COL size VAL ' || coalesce(CAST(p_size AS VARCHAR), '') || ' ')"
PAIRS = f"""
pairs AS (SELECT a.p_partkey // 2 AS pair_id, a.p_brand AS domain, {REC.replace('p_', 'a.p_')} AS "left", {REC.replace('p_', 'b.p_')} AS "right", CAST(a.p_brand = b.p_brand AS INT) AS label
          FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 2 = 0)
"""


@query("record_serialize", f"SELECT p_partkey, {REC} || ' ' AS record FROM part")
def record_serialize(spark, d):
    rec = R.serialize(("name", F.col("p_name")), ("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size")))
    return table(spark, d, "part").select("p_partkey", rec.alias("record"))


def _tagged(spark, d):
    """Records with a language tag, quotes, a missing value and mixed-case attributes."""
    return table(spark, d, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type",
        F.concat(F.lit('COL Part_Name VAL  "'), "p_name", F.lit('"@en COL brand VAL '), "p_brand", F.lit(' COL type VAL  "'), "p_type", F.lit('" COL note VAL None')).alias("record"),
    )


@query("record_parse", """
SELECT p_partkey, CAST(pos AS INT) AS pos, attr, val FROM (
  SELECT p_partkey, 0 AS pos, 'part name' AS attr, p_name AS val FROM part UNION ALL SELECT p_partkey, 1, 'brand', p_brand FROM part
  UNION ALL SELECT p_partkey, 2, 'type', p_type FROM part UNION ALL SELECT p_partkey, 3, 'note', 'N/A' FROM part)""")
def record_parse(spark, d):
    return _tagged(spark, d).select("p_partkey", F.posexplode(R.parse(F.col("record"))).alias("pos", "kv")).select("p_partkey", "pos", "kv.attr", "kv.val")


@query("record_flatten", "SELECT p_partkey, 'part name: ' || p_name || ', brand: ' || p_brand || ', type: ' || p_type || ', note: N/A' AS flat FROM part")
def record_flatten(spark, d):
    return _tagged(spark, d).select("p_partkey", R.flatten(F.col("record")).alias("flat"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, left: str, right: str) -> str:
    """The template's text in SQL, with two expressions in its places."""
    a, b, c = (_sql_text(t) for t in template.split("%s"))
    return f"{a} || {left} || {b} || {right} || {c}"


def _flat_sql(c: str) -> str:
    for name in ("brand", "type", "size"):
        c = f"replace({c}, ' COL {name} VAL ', ', {name}: ')"
    return f"replace({c}, 'COL name VAL ', 'name: ')"


@query("prompt_render", f"""WITH {PAIRS} SELECT pair_id, md5({_filled(R.PROMPT, '"left"', '"right"')}) AS prompt_md5,
 md5({_filled(R.JELLYFISH_PROMPT, _flat_sql('"left"'), _flat_sql('"right"'))}) AS flat_md5 FROM pairs""")
def prompt_render(spark, d):
    """The general prompt has the records as they are, the other model's has them flattened."""
    shown = {n: F.md5(R.prompt(F.col("left"), F.col("right"), m)).alias(n) for n, m in (("prompt_md5", "gpt"), ("flat_md5", "a/Jellyfish-7B"))}
    return pairs(spark, d).select("pair_id", *shown.values())


@query("prompt_chat", f"""WITH {PAIRS}, m AS (SELECT pair_id, unnest([0, 1]) AS pos, unnest(['system', 'user']) AS role, unnest([{_sql_text(R.SYSTEM)}, {_filled(R.PROMPT, '"left"', '"right"')}]) AS content FROM pairs)
SELECT pair_id, CAST(pos AS INT) AS pos, role, md5(content) AS content_md5 FROM m""")
def prompt_chat(spark, d):
    said = F.posexplode(R.chat(F.col("left"), F.col("right"))).alias("pos", "said")
    return pairs(spark, d).select("pair_id", said).select("pair_id", "pos", "said.role", F.md5("said.content").alias("content_md5"))


@query("yes_no_label", r"SELECT conv_id, turn, CAST(coalesce(regexp_matches(lower(trim(text)), '^\s*yes\b'), false) AS INT) AS yes FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' Yes, ' || text WHEN turn % 3 = 1 THEN text ELSE 'Yesterday ' || text END AS text FROM conversations)")
def yes_no_label(spark, d):
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit(" Yes, "), "text")).when(k == 1, F.col("text")).otherwise(F.concat(F.lit("Yesterday "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", R.yes_label(said).alias("yes"))


@query("title_extract", "SELECT p_partkey, p_name AS title FROM part")
def title_extract(spark, d):
    rec = F.concat(F.lit('COL title VAL  "'), "p_name", F.lit('"@en COL x VAL y'))
    return table(spark, d, "part").select("p_partkey", R.title(rec).alias("title"))


@query("number_normalize", "SELECT p_partkey, CASE WHEN p_retailprice = round(p_retailprice) THEN printf('%d', CAST(p_retailprice AS BIGINT)) ELSE printf('%.2f', p_retailprice) END AS price, CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part")
def number_normalize(spark, d):
    part = table(spark, d, "part")
    number = lambda c: R.normal_number(F.col(c).cast("string"))
    return part.select("p_partkey", number("p_retailprice").alias("price"), number("p_size").alias("size"), number("p_brand").alias("brand"))


@query("token_tags", r"""
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, unnest(range(0, len(string_split(text, ' ')))) AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$') THEN CASE WHEN abs(CAST(t AS DOUBLE)) >= 9223372036854775808 THEN t WHEN CAST(t AS DOUBLE) = round(CAST(t AS DOUBLE)) THEN printf('%d', CAST(CAST(t AS DOUBLE) AS BIGINT)) ELSE printf('%.2f', CAST(t AS DOUBLE)) END
       WHEN length(t) >= 7 THEN 'ID ' || t ELSE t END AS tagged
FROM t WHERE regexp_matches(t, '[0-9]')""")
def token_tags(spark, d):
    """Tokens with a digit, tagged: number form and identifiers."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    t = rows.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "t")).where(F.col("t").rlike("[0-9]"))
    return t.select("doc_id", "pos", R.tag_token(F.col("t")).alias("tagged"))


@query("arity_filter", "SELECT pair_id, n, CAST(n > 2 AS INT) AS lenient, CAST(n = 3 AS INT) AS strict FROM (SELECT p_partkey AS pair_id, CASE WHEN p_partkey % 7 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 4 ELSE 3 END AS n FROM part)")
def arity_filter(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 7 == 0, F.concat_ws("\t", "p_name", F.lit("1"))).when(k % 5 == 0, F.concat_ws("\t", "p_name", "p_brand", F.lit("x"), F.lit("1"))).otherwise(F.concat_ws("\t", "p_name", "p_brand", F.lit("0")))
    n = R.arity(line)
    return table(spark, d, "part").select(k.alias("pair_id"), n.cast("int").alias("n"), (n > 2).cast("int").alias("lenient"), (n == 3).cast("int").alias("strict"))


_IDF = f"""
WITH {PAIRS}, docs AS (SELECT "left" AS t FROM pairs UNION ALL SELECT "right" FROM pairs UNION ALL SELECT CAST(label AS VARCHAR) FROM pairs),
w AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'))) AS token FROM docs) GROUP BY token),
idf AS (SELECT token, df, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + df)) + 1 AS idf FROM w),
sides AS (SELECT pair_id, 0 AS side, "left" AS t FROM pairs UNION ALL SELECT pair_id, 1, "right" FROM pairs),
tok AS (SELECT pair_id, side, unnest(string_split(t, ' ')) AS token, unnest(range(0, len(string_split(t, ' ')))) AS pos FROM sides),
heavy AS (SELECT pair_id, token, count(*) * any_value(idf) AS weight FROM tok JOIN idf USING (token) WHERE token NOT IN ('COL', 'VAL') GROUP BY pair_id, token)
"""


@query("idf_fit", _IDF + "SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_fit(spark, d):
    return text.idf(pairs(spark, d)).select("token", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_pair_weight", _IDF + "SELECT pair_id, token, round(weight, 6) AS weight FROM heavy")
def tfidf_pair_weight(spark, d):
    p = pairs(spark, d)
    return text.pair_weights(text.side_tokens(p), text.idf(p)).select("pair_id", "token", F.round("weight", 6).alias("weight"))


@query("token_frequency", _IDF + "SELECT pair_id, CAST(side AS INT) AS side, count(*) FILTER (token IN ('COL', 'VAL')) AS heads, count(*) AS tokens, count(DISTINCT token) AS kinds FROM tok GROUP BY pair_id, side")
def token_frequency(spark, d):
    sides = pairs(spark, d).select("pair_id", F.posexplode(F.array("left", "right")).alias("side", "text"))
    return sides.select("pair_id", "side", *[c.alias(k) for k, c in text.frequency(F.col("text")).items()])


@query("summarize_pairs", _IDF + """,
kinds AS (SELECT pair_id, side, token, min(pos) AS first, count(*) AS n FROM tok GROUP BY ALL),
r AS (SELECT k.*, coalesce(weight, 0) AS weight, sum(CASE WHEN token IN ('COL', 'VAL') THEN n ELSE 0 END) OVER (PARTITION BY pair_id, side) AS heads,
      row_number() OVER (PARTITION BY pair_id, side ORDER BY round(coalesce(weight, 0), 9) DESC, first) AS rank
      FROM kinds k LEFT JOIN heavy USING (pair_id, token)),
keep AS (SELECT pair_id, side, token FROM r WHERE heads + rank <= 12 AND rank <= 12),
shown AS (SELECT pair_id, side, pos, token FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side, token ORDER BY pos) AS k FROM tok) t
          WHERE token IN ('COL', 'VAL') OR (k = 1 AND EXISTS (SELECT 1 FROM keep WHERE keep.pair_id = t.pair_id AND keep.side = t.side AND keep.token = t.token))),
txt AS (SELECT pair_id, side, string_agg(token || ' ', '' ORDER BY pos) AS s FROM shown GROUP BY pair_id, side)
SELECT p.pair_id, coalesce(a.s, '') AS "left", coalesce(b.s, '') AS "right", p.label FROM pairs p LEFT JOIN txt a ON a.pair_id = p.pair_id AND a.side = 0 LEFT JOIN txt b ON b.pair_id = p.pair_id AND b.side = 1""")
def summarize_pairs(spark, d):
    p = pairs(spark, d)
    return text.summarize(p, text.idf(p), 12)


@query("shared_tokens", f"""WITH {PAIRS} SELECT pair_id, len(list_intersect(list_distinct(string_split(lower("left"), ' ')), list_distinct(string_split(lower("right"), ' ')))) AS shared FROM pairs""")
def shared_tokens(spark, d):
    return pairs(spark, d).select("pair_id", text.shared(F.col("left"), F.col("right")).alias("shared"))


#: An example of a synonym table; the operator takes any.
SYNONYMS = {"Brand": ["Make"], "small": ["compact", "little"], "red": ["crimson", "scarlet"], "part": ["piece", "component"]}


def _paraphrase_sql(c: str) -> str:
    table = "MAP {" + ", ".join(f"{_sql_text(k)}: [{', '.join(map(_sql_text, v))}]" for k, v in SYNONYMS.items()) + "}"
    own = f"({table})[trim(w, '.,:-_()\"')]"
    pick = f"CAST(CAST('0x' || substr(md5(concat_ws('|', '22', {c}, CAST(i - 1 AS VARCHAR))), 1, 6) AS INT) % len({own}) + 1 AS INT)"
    words = f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w, i: coalesce({own}[{pick}], w)), ' ')"


@query("synonym_paraphrase", f"SELECT p_partkey, {_paraphrase_sql('p_name')} AS title FROM part")
def synonym_paraphrase(spark, d):
    return table(spark, d, "part").select("p_partkey", augment.paraphrase(F.col("p_name"), SYNONYMS).alias("title"))


@query("aug_label_balance", f"""WITH {PAIRS}, c AS (SELECT domain, count(*) AS n, sum(label) AS pos FROM pairs GROUP BY domain)
SELECT domain, n, CAST(pos AS BIGINT) AS pos, CAST(greatest(floor(300 * (CAST(pos AS DOUBLE) / n)) - pos, 0) AS BIGINT) AS need_pos, CAST(greatest(300 - floor(300 * (CAST(pos AS DOUBLE) / n)) - (n - pos), 0) AS BIGINT) AS need_neg FROM c""")
def aug_label_balance(spark, d):
    return augment.needed(pairs(spark, d), 300).select("domain", "n", "pos", F.col("need_pos").cast("long"), F.col("need_neg").cast("long"))


_NEGATIVES = """t AS (SELECT DISTINCT domain, title FROM (SELECT domain, "left" AS title FROM pairs UNION ALL SELECT domain, "right" FROM pairs)),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(concat_ws('|', '22', title)), title) AS i FROM t),
x AS (SELECT a.domain, a.title AS "left", b.title AS "right", need_neg, a.i, b.i AS j FROM r a JOIN need USING (domain) JOIN r b ON b.domain = a.domain AND b.i > a.i WHERE need_neg > 0),
f AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.domain = x.domain AND least(p."left", p."right") = least(x."left", x."right") AND greatest(p."left", p."right") = greatest(x."left", x."right"))),
negs AS (SELECT domain, "left", "right" FROM f QUALIFY row_number() OVER (PARTITION BY domain ORDER BY j - i, i) <= need_neg)"""


@query("aug_negatives", f"""WITH {PAIRS}, c AS (SELECT domain, count(*) AS n, sum(label) AS pos FROM pairs GROUP BY domain),
need AS (SELECT domain, greatest(300 - floor(300 * (CAST(pos AS DOUBLE) / n)) - (n - pos), 0) AS need_neg FROM c),
{_NEGATIVES}
SELECT domain, "left", "right" FROM negs""")
def aug_negatives(spark, d):
    p = pairs(spark, d)
    return augment.negatives(p, augment.needed(p, 300))


@query("select_aug", f"""WITH {PAIRS}, c AS (SELECT domain, count(*) AS n, sum(label) AS pos FROM pairs GROUP BY domain),
need AS (SELECT domain, pos, greatest(floor(300 * (CAST(pos AS DOUBLE) / n)) - pos, 0) AS need_pos, greatest(300 - floor(300 * (CAST(pos AS DOUBLE) / n)) - (n - pos), 0) AS need_neg FROM c),
{_NEGATIVES},
p AS (SELECT domain, "left", "right", row_number() OVER (PARTITION BY domain ORDER BY md5(concat_ws('|', '22', "left", "right")), "left", "right") - 1 AS i FROM pairs WHERE label = 1),
g AS (SELECT p.*, unnest(range(0, CAST(ceil((need_pos - i) / pos) AS BIGINT))) AS rep FROM p JOIN need USING (domain) WHERE need_pos > 0 AND i < need_pos),
h AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '22', "left", "right", CAST(rep AS VARCHAR))), 1, 1) AS INT) % 2 = 0 AS first FROM g)
SELECT domain, "left", "right", label FROM pairs
UNION ALL SELECT domain, CASE WHEN first THEN {_paraphrase_sql('"left"')} ELSE "left" END, CASE WHEN first THEN "right" ELSE {_paraphrase_sql('"right"')} END, 1 FROM h
UNION ALL SELECT domain, "left", "right", 0 FROM negs""")
def select_aug(spark, d):
    return augment.augmented(pairs(spark, d), 300, SYNONYMS)


def domain_pairs(spark, d):
    """domain, pair_idx, split, left, right, label: the pairs numbered in their domain."""
    rows = numbered(pairs(spark, d), "domain", "pair_id").withColumnRenamed("idx", "pair_idx")
    return written(rows.withColumn("split", split_of()).select("domain", "pair_idx", "split", "left", "right", "label"), "domain_pairs")


_DOMAIN_PAIRS = """
placed AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY pair_id) - 1 AS pair_idx, "left", "right", label FROM pairs),
dp AS (SELECT *, CASE WHEN pair_idx % 5 <= 2 THEN 'train' WHEN pair_idx % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM placed),
train AS (SELECT * FROM dp WHERE split = 'train')"""


@query("budgeted_dataset", f"""WITH {PAIRS}, {_DOMAIN_PAIRS}, sel AS (WITH x AS (SELECT 1), {fill_sql("SELECT '' AS target, '' AS donor, 0 AS pair_idx, 0.0 AS score WHERE false", 20)})
SELECT target AS domain, 'train' AS split, CAST(out_pos AS BIGINT) AS pos, "left", "right", label FROM sel JOIN train ON domain = donor AND train.pair_idx = sel.pair_idx
UNION ALL SELECT domain, split, CAST(pair_idx AS BIGINT), "left", "right", label FROM dp WHERE split <> 'train'""")
def budgeted_dataset(spark, d):
    """Selected keys become training rows with texts; validation and test rows are carried over."""
    rows = domain_pairs(spark, d)
    return datasets.budgeted(selection.spec(rows.where("split = 'train'"), 20), rows)


def _ids(c):
    """A stand-in for a tokenizer: an id per word, by its first character and length."""
    return F.transform(F.split(c, " ", -1), lambda t: F.lit(1000) + F.ascii(t) * 50 + F.length(t))


_IDS = lambda c: f"list_transform(string_split({c}, ' '), lambda t: 1000 + (CASE WHEN t = '' THEN 0 ELSE unicode(t) END) * 50 + length(t))"
_ENCODED = f"""WITH {PAIRS}, e AS (SELECT pair_id, label, {_IDS('"left"')} AS a, {_IDS('"right"')} AS b FROM pairs),
k AS (SELECT *, len(a) AS n, len(b) AS m, least(len(a), len(b), 8) AS s FROM e),
w AS (SELECT *, CASE WHEN n + m <= 17 THEN n WHEN n <= m THEN s ELSE 17 - s END AS ka, CASE WHEN n + m <= 17 THEN m WHEN n <= m THEN 17 - s ELSE s END AS kb FROM k),
enc AS (SELECT pair_id, label, [101] || a[1:ka] || [102] || b[1:kb] || [102] AS ids, [101] || a[1:6] || [102] AS one FROM w)"""


def encoded(spark, d):
    left, right = _ids("left"), _ids("right")
    return pairs(spark, d).select("pair_id", "label", datasets.encode_pair(left, right, 20, [101], [102], [102]).alias("ids"), datasets.encode_single(left, 8, [101], [102]).alias("one"))


def _shown(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query("encode_pairs", _ENCODED + " SELECT pair_id, label, array_to_string(ids, ' ') AS ids, array_to_string(one, ' ') AS one FROM enc")
def encode_pairs(spark, d):
    return encoded(spark, d).select("pair_id", "label", _shown("ids").alias("ids"), _shown("one").alias("one"))


@query("pad_batch", _ENCODED + """, z AS (SELECT *, max(len(ids)) OVER (PARTITION BY pair_id // 8) AS size FROM enc)
SELECT pair_id, array_to_string(list_resize(ids, size, 0), ' ') AS ids, array_to_string(list_resize(one, greatest(size, len(one)), 0), ' ') AS one, CAST(size AS INT) AS size FROM z""")
def pad_batch(spark, d):
    rows = encoded(spark, d).withColumn("batch", F.expr("pair_id div 8"))
    out = datasets.pad_batch(rows, "batch", ["ids", "one"], ["ids"])
    return out.select("pair_id", _shown("ids").alias("ids"), _shown("one").alias("one"), F.size("ids").alias("size"))


def _sentences(spark, d):
    return pairs(spark, d).select("pair_id", F.concat_ws(" [SEP] ", "left", "right").alias("text"))


def _augmenter(op: str):
    return lambda spark, d: augment.augment_texts(_sentences(spark, d), op).select("pair_id", "augmented")


for _op in augment.OPS:
    query(f"augment_{_op}")(_augmenter(_op))


@query("token_labels", f"""WITH {PAIRS}, t AS (SELECT pair_id, unnest(string_split("left" || ' [SEP] ' || "right", ' ')) AS token FROM pairs)
SELECT pair_id, count(*) FILTER (token IN ('COL', 'VAL')) AS hd, count(*) FILTER (token IN ('[CLS]', '[SEP]')) AS sep, count(*) FILTER (token NOT IN ('COL', 'VAL', '[CLS]', '[SEP]')) AS o FROM t GROUP BY pair_id""")
def token_labels(spark, d):
    kinds = tagging.token_labels(F.col("text"))
    n = lambda k: F.size(F.filter(F.col("k"), lambda x: x == k)).cast("long")
    return _sentences(spark, d).select("pair_id", kinds.alias("k")).select("pair_id", n("HD").alias("hd"), n("<SEP>").alias("sep"), n("O").alias("o"))


@query("tag_products")
def tag_products(spark, d):
    """Entity markers by a recogniser (here: a word list) and tagged tokens."""
    return tagging.tag(_sentences(spark, d), tagging.word_list({"Brand": "PRODUCT"}), "product").select("pair_id", "tagged")


@query("tag_general")
def tag_general(spark, d):
    return tagging.tag(_sentences(spark, d), tagging.word_list({"Brand": "ORG"}), "general").select("pair_id", "tagged")
