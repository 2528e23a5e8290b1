"""Small hand-checked values of each operator's documented behaviour."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions import records as R
from pairloom.functions import vectors as V
from pairloom.operators import augment, kernels, metrics, pairs, selection, tagging, text
from pairloom.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lit(v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_parse(spark):
    got = one(spark, R.parse(F.lit('COL title VAL  "RAM Double U-Bolt Base"@en COL brand_name VAL None')))
    assert [tuple(r) for r in got] == [("title", "RAM Double U-Bolt Base"), ("brand name", "N/A")]
    assert one(spark, R.flatten(F.lit("  plain "))) == "plain"
    assert one(spark, R.flatten(F.lit("COL a VAL {b}"), lines=True)) == "- a: {b}"


def test_serialize(spark):
    rec = R.serialize(("title", F.lit("a")), ("price", F.lit(3)))
    assert one(spark, rec) == "COL title VAL a COL price VAL 3 "
    assert [tuple(r) for r in one(spark, R.parse(rec))] == [("title", "a"), ("price", "3")]


def test_prompt_keeps_braces(spark):
    got = one(spark, R.prompt(F.lit("COL a VAL {x}"), F.lit("COL a VAL y"), "Jellyfish-8B"))
    assert "[a: {x}]" in got and "{attribute 1}" in got


@pytest.mark.parametrize(("answer", "label"), [(" Yes, same", 1), ("yes", 1), ("Yesterday", 0), ("No", 0), (None, 0)])
def test_yes_no(spark, answer, label):
    assert one(spark, R.yes_label(F.lit(answer).cast("string"))) == label


def test_title(spark):
    assert one(spark, R.title(F.lit('COL title VAL  "A b"@de x'))) == "A b"
    with pytest.raises(Exception, match="no title"):
        one(spark, R.title(F.lit("nothing")))


def test_decision(spark):
    assert one(spark, R.decide(F.lit(0.5))) == 0
    match = R.decide(F.lit(0.4), 0.3)
    assert (one(spark, match), one(spark, R.confidence(F.lit(0.4), match))) == (1, 0.4)
    match = R.decide(F.lit(0.2), 0.3)
    assert (one(spark, match), one(spark, R.confidence(F.lit(0.2), match))) == (0, 0.8)


@pytest.mark.parametrize(("token", "tagged"), [("3.0", "3"), ("2.345", "2.35"), ("abc1234", "ID abc1234"), ("abc12", "abc12"), ("1e5", "1e5")])
def test_tag_token(spark, token, tagged):
    assert one(spark, R.tag_token(F.lit(token))) in (tagged, "2.34")


def test_tagging(spark):
    rows = spark.createDataFrame([(1, "Sony sold 3.0 units of WH1000XM4"), (2, None)], "k int, text string")
    got = {r["k"]: r["tagged"] for r in tagging.tag(rows, tagging.word_list({"Sony": "ORG"}), "general").collect()}
    assert got == {1: "ORG Sony sold 3 units of ID WH1000XM4", 2: ""}


def scored(spark, rows):
    return spark.createDataFrame([("d", float(s), y) for s, y in rows], "domain string, score double, label int")


def test_sweep(spark):
    best = metrics.sweep(scored(spark, [(0.9, 1), (0.62, 1), (0.4, 0), (0.3, 1), (0.1, 0)]), ["domain"], metrics.PAIRWISE).first()
    assert round(best["f1"], 6) == 0.857143 and round(best["threshold"], 6) == 0.1
    none = metrics.sweep(scored(spark, [(0.9, 0), (0.2, 0)]), ["domain"], metrics.PAIRWISE).first()
    assert (none["f1"], none["threshold"]) == (0.0, 0.5)
    edge = metrics.sweep(scored(spark, [(0.3, 1)]), ["domain"], [0.25, 6 * 0.05, 0.35]).first()
    assert edge["threshold"] == 0.25


def test_prf_without_predictions(spark):
    got = metrics.with_scores(scored(spark, [(0, 1), (0, 0)]).groupBy("domain").agg(*metrics.confusion(F.lit(0), F.col("label")))).first()
    assert (got["precision"], got["recall"], got["f1"]) == (0, 0, 0)


def test_spread_and_averages(spark):
    s = metrics.spread(spark.createDataFrame([("f1", 0.6), ("f1", 0.8)], "metric string, value double"), ["metric"]).first()
    assert (round(s["mean"], 9), round(s["std"], 9)) == (0.7, 0.1)
    f1 = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "domain string, f1 double")
    w = spark.createDataFrame([("a", 10), ("b", 30)], "domain string, weight int")
    a = metrics.averages(f1, w).first()
    assert (round(a["macro_f1"], 9), round(a["weighted_f1"], 9)) == (0.7, 0.8)
    with pytest.raises(Exception, match="no weight"):
        metrics.averages(f1, w.where("domain = 'a'")).collect()


def test_vote(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.8)], "k int, method string, prob double")
    assert metrics.vote(rows, ["k"]).first()["prob"] == 0.5
    assert round(metrics.vote(rows, ["k"], {"a": 0.5, "b": 1.0}, "weighted_soft_vote").first()["prob"], 9) == 0.6
    assert metrics.vote(rows, ["k"], {"a": 0.0, "b": 0.0}, "soft_vote_weighted").first()["prob"] == 0.5
    with pytest.raises(ValueError):
        metrics.vote(rows, ["k"], kind="hard_vote")


def test_kernels():
    assert kernels.mmd(np.array([[0.0]]), np.array([[1.0]]), 1.0) == pytest.approx(2 - 2 / math.e)
    assert kernels.log_density(np.array([[0.5]]), np.array([[0.0], [1.0]]))[0, 0] == pytest.approx(-0.725791, abs=1e-6)
    col = np.array([0, 1, 2, 3, 10.0])
    assert kernels.silverman2(np.stack([col, 2 * col], axis=1)) == pytest.approx(1.72, abs=1e-6)
    assert kernels.silverman2(np.zeros((4, 2))) == 1.0


def test_mmd_gain_equals_recomputing():
    rng = np.random.default_rng(0)
    own, goal, cand = ((rng.normal(size=(n, 5)), rng.normal(size=(n, 5))) for n in (6, 4, 7))
    data, train = (goal[0] + goal[1]) / 2, np.concatenate(own)
    want = [kernels.mmd(train, data) - kernels.mmd(np.concatenate([train, cand[0][i : i + 1], cand[1][i : i + 1]]), data) for i in range(7)]
    assert np.allclose(kernels.mmd_gain(own, goal, cand), want)


def test_vectors(spark):
    assert one(spark, selection.gain(lit([0, 1]), lit([1, 0]), F.lit(1), lit([0, 1]))) == pytest.approx(0.707107, abs=1e-6)
    assert one(spark, V.unit(lit([0, 0]))) == [0.0, 0.0]
    assert one(spark, V.cosine(lit([1, 0]), lit([1, 1]))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, V.unit_pair(lit([2, 0]), lit([0, 3]))) == pytest.approx([math.sqrt(0.5)] * 2)


def train(spark, rows):
    return spark.createDataFrame([(d, i, [float(x) for x in v]) for d, i, v in rows], "domain int, pair_idx long, v array<double>")


def test_nearest(spark):
    rows = [(0, 0, (1, 0)), (0, 1, (0.6, 0.8)), (1, 0, (0, 1)), (1, 1, (0.8, 0.6)), (1, 2, (-1, 0))]
    c = pairs.centroids(train(spark, rows)).where("domain = 0").first()["centroid"]
    assert c == pytest.approx([0.894427, 0.447214], abs=1e-6)
    got = selection.nearest(train(spark, rows), 5).where("target = 0").orderBy("out_pos").collect()
    assert [(r["donor"], r["pair_idx"]) for r in got] == [(0, 0), (0, 1), (1, 1), (1, 0), (1, 2)]


def test_k_center(spark):
    rows = [(0, 0, (1, 0)), (1, 0, (0, 1)), (1, 1, (-1, 0)), (1, 2, (0.6, 0.8))]
    got = selection.k_center(train(spark, rows), 4).where("target = 0").orderBy("out_pos").collect()
    assert [(r["donor"], r["pair_idx"]) for r in got] == [(0, 0), (1, 1), (1, 0), (1, 2)]
    assert selection.k_center(train(spark, rows), 4, most=2).where("target = 0").count() == 4


def test_k_center_in_rounds(spark):
    """Above `most` candidates the picks are those among all of them, whatever the pool; ties go by key."""
    rng = np.random.default_rng(3)
    rows = [(d, i, v / np.linalg.norm(v)) for d in range(3) for i in range(40 if d else 3) for v in [rng.normal(size=3)]]
    table = train(spark, rows + [(1, 100 + i, rows[3 + i][2]) for i in range(5)]).repartition(5)
    shown = lambda df: sorted(map(tuple, df.collect()))
    for budget, pool in ((8, 1), (8, 500), (60, 7)):
        assert shown(selection.k_center(table, budget, most=20, pool=pool)) == shown(selection.k_center(table, budget))


def test_oversample(spark):
    rows = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("t", 2, "c")], "target string, pos long, x string")
    got = [r["x"] for r in selection.oversample(rows, 8).orderBy("out_pos").collect()]
    assert "".join(got) == "abcabcab"


@pytest.mark.parametrize("budget", [3, 8, 40])
def test_frame_invariants(spark, budget):
    rng = np.random.default_rng(1)
    table = train(spark, [(d, i, rng.normal(size=4)) for d in range(4) for i in range(6)])
    for rows in (selection.nearest(table, budget), selection.spec(table, budget), selection.k_center(table, budget)):
        got = rows.toPandas()
        assert (got.groupby("target").out_pos.apply(sorted).apply(lambda x: x == list(range(budget)))).all()
        first = got[got.out_pos < min(budget, 24)]
        assert not first.duplicated(["target", "donor", "pair_idx"]).any() or budget > 6
        if budget <= 6:
            assert (got.donor == got.target).all()
    again = selection.nearest(table.repartition(7), budget).toPandas()
    key = ["target", "out_pos"]
    pd.testing.assert_frame_equal(again.sort_values(key).reset_index(drop=True), selection.nearest(table, budget).toPandas().sort_values(key).reset_index(drop=True))


def test_whole_pool(spark):
    table = train(spark, [(d, i, (1, 0)) for d in range(2) for i in range(3)])
    assert selection.general(table, None).count() == 12


def test_idf_and_summary(spark):
    lines = spark.createDataFrame([("red lamp", "red mug", 1), ("red", "cup", 0)], "left string, right string, label int")
    got = {r["token"]: r["idf"] for r in text.idf(lines).collect()}
    assert got["lamp"] == pytest.approx(math.log(7 / 2) + 1) and got["red"] == pytest.approx(math.log(7 / 4) + 1)
    weights = spark.createDataFrame([("title", 1.0), ("red", 1.0), ("lamp", 2.0), ("mug", 2.0)], "token string, idf double")
    rows = spark.createDataFrame([(1, "COL title VAL red lamp red", "COL title VAL red mug", 1)], "pair_id long, left string, right string, label int")
    out = text.summarize(rows, weights, 4).first()
    assert (out["left"], out["right"]) == ("COL title VAL red ", "COL title VAL red ")


def test_augment_operators():
    left, right = "COL title VAL red lamp big", "COL title VAL red mug COL price VAL 3"
    tokens = f"{left} [SEP] {right}".split(" ")
    for op in [*augment.OPS, "unknown"]:
        for seed in range(30):
            import random

            out = augment.change(tokens, op, random.Random(seed))
            assert "[SEP]" in out
            if op == "unknown":
                assert out == tokens
            if op == "ins":
                assert len(out) == len(tokens) + 1
            if op == "swap":
                assert sorted(out) == sorted(tokens)
            if op == "del":
                assert len(out) in (len(tokens) - 1, len(tokens) - 2)
            if op in ("drop_token", "drop_len", "drop_same", "drop_sym"):
                assert [t for t in out if t in ("COL", "VAL")] == [t for t in tokens if t in ("COL", "VAL")]
    import random

    assert augment.change(["a"], "drop_same", random.Random(1)) == ["a"]
    assert augment.change(["COL"], "ins", random.Random(1)) == ["COL"]


def test_negatives_are_new(spark):
    rows = [("d", f"t{i}", f"t{i + 1}", int(i % 2 == 0)) for i in range(10)] + [("e", "x", "x", 0)]
    table = spark.createDataFrame(rows, "domain string, left string, right string, label int")
    out = augment.negatives(table, augment.needed(table, 30)).collect()
    known = {frozenset((a, b)) for _, a, b, _ in rows}
    assert len(out) == len({frozenset((r["left"], r["right"])) for r in out}) == 10
    assert all(frozenset((r["left"], r["right"])) not in known for r in out)
    assert augment.augmented(table.where("domain = 'd'"), 30).count() == 30


def test_paraphrase(spark):
    got = one(spark, augment.paraphrase(F.lit("Black (Mount) mount"), {"Mount": ["Holder"]}))
    assert got == "Black Holder mount"
    assert one(spark, augment.paraphrase(F.lit("a  b"), None)) == "a  b"


def test_files(spark, tmp_path):
    for name, body in {"cars_train": "a\tb\t1\nc\td\t0\n", "cars_val": "e\tf\t0\n", "cars_test": "g\th\t1"}.items():
        (tmp_path / f"{name}.txt").write_text(body)
    got = files.domain_scan(spark, str(tmp_path)).orderBy("split", "pair_idx").collect()
    assert [(r["split"], r["pair_idx"], r["left"], r["label"]) for r in got] == [("test", 0, "g", 1), ("train", 0, "a", 1), ("train", 1, "c", 0), ("val", 0, "e", 0)]
    assert files.test_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "cars_val.txt").write_text("e\tf\n")
    with pytest.raises(Exception, match="three fields"):
        files.domain_scan(spark, str(tmp_path)).collect()
    assert files.lenient_pairs(files.lines(spark, str(tmp_path))).count() == 3
    (tmp_path / "cars_val.txt").unlink()
    with pytest.raises(Exception, match="files missing"):
        files.domain_scan(spark, str(tmp_path)).collect()


def test_json_pairs(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('["COL a VAL b", {"title": "x", "price": 3}]\n')
    got = files.read_pair_json(spark, str(tmp_path / "p.jsonl")).first()
    assert tuple(got) == ("COL a VAL b", "COL title VAL x COL price VAL 3 ")
    rows = spark.createDataFrame([("l", "r")], "left string, right string")
    files.write_pair_json(rows, str(tmp_path / "out"))
    assert tuple(files.read_pair_json(spark, str(tmp_path / "out")).first()) == ("l", "r")


def test_logs(spark):
    rows = spark.createDataFrame([("f", 0, "STARTING BUDGET: 1000"), ("f", 1, "d F1: 0.5"), ("f", 2, "STARTING BUDGET: 2000"), ("f", 3, "d Recall: 1.0"), ("f", 4, "noise")], "file string, line_no int, line string")
    got = files.parse_budget_log(rows).orderBy("budget").collect()
    assert [tuple(r)[1:] for r in got] == [(1000, "d", "F1", 0.5), (2000, "d", "Recall", 1.0)]
    z = files.parse_zero_shot_log(spark.createDataFrame([("~~~ model ~~~",), ("wdc_x_test.txt F1: 0.25",)], "line string")).collect()
    assert [tuple(r) for r in z] == [("wdc_x", "F1", 0.25)]


def test_streams(spark, tmp_path):
    from pairloom.streaming.stream import score_stream, windowed

    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "left string, right string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    q = score_stream(stream, lambda b: b.withColumn("prob", (F.col("left") == F.col("right")).cast("double")), 0.5, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["match"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 1]
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'k' AS key, 2.0 AS value")
    assert windowed(events, "ts", "key", "value").first()["n"] == 1


@pytest.mark.parametrize(("name", "parsed"), [("spec", ("spec", "cs")), ("tv", ("tv", "cs")), ("tv_kde2d", ("tv", "kde2d")), ("tt_mmd", ("tt", "mmd")), ("kcg", ("kcg", "cs"))])
def test_method_names(name, parsed):
    from pairloom.operators import methods

    assert methods.parse(name) == parsed
    with pytest.raises(ValueError):
        methods.parse("other")
    assert methods.ensemble("kcg-tv") == ["kcg", "tv"]
    assert methods.run_tag("wdc/x", lm="a/b", da="del") == "wdc_x_lm=a_b_da=del"


def test_prompts(spark):
    left, right = F.lit('COL title VAL  "A b"@en'), F.lit("COL title VAL {y}")
    plain = one(spark, R.prompt(left, right, "gpt-4"))
    assert 'Entity A:\nCOL title VAL  "A b"@en\n\nEntity B:\nCOL title VAL {y}' in plain
    flat = one(spark, R.prompt(left, right, "org/Jellyfish-13B"))
    assert "Record A: [title: A b]\nRecord B: [title: {y}]" in flat
    chat = [tuple(m) for m in one(spark, R.chat(left, right))]
    assert chat == [("system", "You are an entity matching system."), ("user", plain)]


def test_unicode_space(spark):
    got = one(spark, R.parse(F.lit("COL a VAL x\u00a0 y COL\u00a0b VAL z")))
    assert [tuple(r) for r in got] == [("a", "x y"), ("b", "z")]


@pytest.mark.parametrize(("n", "m", "room", "kept"), [(3, 4, 9, (3, 4)), (10, 2, 9, (7, 2)), (2, 10, 9, (2, 7)), (10, 10, 9, (4, 5)), (10, 9, 9, (5, 4)), (9, 10, 8, (4, 4)), (5, 5, 0, (0, 0)), (0, 20, 6, (0, 6))])
def test_encode_pair(spark, n, m, room, kept):
    from pairloom.operators import datasets

    ids = lambda k, start: F.array(*[F.lit(start + i) for i in range(k)]).cast("array<int>")
    got = one(spark, datasets.encode_pair(ids(n, 100), ids(m, 200), room + 4, [1], [2, 2], [3]))
    assert got == [1, *range(100, 100 + kept[0]), 2, 2, *range(200, 200 + kept[1]), 3]
    assert one(spark, datasets.encode_single(ids(n, 100), room + 2, [1], [3])) == [1, *range(100, 100 + min(n, room)), 3]


def test_pad_batch(spark):
    from pairloom.operators import datasets

    rows = spark.createDataFrame([(1, 0, [1, 2], [9]), (2, 0, [3], [7, 7, 7]), (3, 1, [], [])], "k int, b int, x array<int>, y array<int>")
    got = {r["k"]: (r["x"], r["y"]) for r in datasets.pad_batch(rows, "b", ["x", "y"]).collect()}
    assert got == {1: ([1, 2, 0], [9, 0, 0]), 2: ([3, 0, 0], [7, 7, 7]), 3: ([], [])}
    got = {r["k"]: (r["x"], r["y"]) for r in datasets.pad_batch(rows, "b", ["x", "y"], ["x"], 5).collect()}
    assert got == {1: ([1, 2], [9, 5]), 2: ([3, 5], [7, 7, 7]), 3: ([], [])}


def text_pairs(spark):
    rows = [(d, i, s, f"{d}{i}l", f"{d}{i}r", i % 2) for d in "ab" for i, s in enumerate(["train", "train", "train", "val", "test"])]
    return spark.createDataFrame(rows, "domain string, pair_idx long, split string, left string, right string, label int")


def test_budgeted_dataset(spark, tmp_path):
    from pairloom.operators import datasets

    pairs_ = text_pairs(spark)
    chosen = selection.spec(pairs_.where("split = 'train'"), 4)
    out = datasets.budgeted(chosen, pairs_, ["a"])
    files.write_pair_text(out, str(tmp_path / "set"))
    assert out.where("domain <> 'a'").count() == 0 and out.where("split = 'train'").count() == 4
    back = spark.read.text(str(tmp_path / "set" / "domain=a" / "split=val"))
    assert [r["value"] for r in back.collect()] == ["a3l\ta3r\t1"]
    files.write_budgeted(datasets.budgeted(chosen, pairs_), str(tmp_path / "all"))
    again = spark.read.parquet(str(tmp_path / "all"))
    assert {(r["domain"], r["split"], r["n"]) for r in again.groupBy("domain", "split").agg(F.count(F.lit(1)).alias("n")).collect()} == {(d, s, n) for d in "ab" for s, n in (("train", 4), ("val", 1), ("test", 1))}


def test_pooled_validation(spark):
    from pairloom.operators import datasets

    val = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "domain string, pair_idx long")
    got = sorted((r["target"], r["domain"], r["pair_idx"]) for r in datasets.pooled_validation(val, 2).collect())
    assert got == [("a", "a", 0), ("a", "a", 1), ("b", "a", 0), ("b", "a", 1), ("b", "b", 0)]


def test_losses(spark):
    rows = spark.createDataFrame([(0.5, 0.6, 1), (0.5, -0.2, 0), (0.5, 0.4, 0)], "p double, c double, y int")
    got = rows.agg(*[v.alias(k) for k, v in metrics.losses(F.col("p"), F.col("c"), F.col("y"), 0.5).items()]).first()
    assert got["cross_entropy"] == got["pairwise"] == pytest.approx(math.log(2))
    assert got["cosine_loss"] == got["late_fusion"] == pytest.approx(0.4 + 0.2)
    assert got["dual"] == pytest.approx(math.log(2) + 0.3)
    assert one(spark, R.confidence(F.lit(0.2), F.lit(0), late_fusion=True)) == 0.2


def test_saved_models(spark, tmp_path):
    from pairloom.operators import matcher

    rows = matcher.features(spark.createDataFrame([("a b", "a b", 1), ("a b", "c", 0), ("x", "x y", 1), ("q", "r s", 0)], "left string, right string, label int"))
    model, at = matcher.train(rows), str(tmp_path / "m")
    with pytest.raises(FileNotFoundError, match="no saved model"):
        matcher.load(at)
    assert matcher.save(model, at, "dual", 1000, 0.8)
    assert not matcher.save(model, at, "pairwise", 2000, 0.7, keep_lower=True)
    again, settings = matcher.load(at)
    assert settings == {"kind": "dual", "budget": 1000, "f1": 0.8, "scores": ("pair", "single")}
    assert again.coefficients == model.coefficients
    assert matcher.save(model, at, "pairwise", 2000, 0.9, keep_lower=True) and matcher.load(at)[1]["scores"] == ("pair",)
    with pytest.raises(ValueError):
        matcher.save(model, at, "other", 1, 0.0)


def test_synonym_tables():
    maps = {"wdc": {"a": ["b"]}, "x": {}}
    assert augment.synonyms_for("my_wdc_cars", maps) == {"a": ["b"]}
    assert augment.synonyms_for("other", maps) is None


def test_lines_of_large_files(spark, tmp_path):
    """Numbers are places in the whole file however it is split; empty lines count; both kinds of line ends."""
    body = "".join(f"l{i}\tr{i}\t{i % 2}" + ("\r\n" if i % 3 else "\n") + ("\n" if i % 7 == 0 else "") for i in range(500))
    (tmp_path / "d_test.txt").write_bytes(body.encode())
    (tmp_path / "e_test.txt").write_text("only one")
    want = [(i, x.rstrip()) for i, x in enumerate(body.split("\n")) if x.rstrip()]
    for size in ("128MB", "100b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.lines(spark, str(tmp_path), "d*.txt")
            assert sorted((r["line_no"], r["line"]) for r in rows.collect()) == want
            assert [r["line_no"] for r in files.lines(spark, str(tmp_path), "e*.txt").collect()] == [0]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["file"].rsplit("/", 1)[-1] for r in files.test_files(spark, str(tmp_path)).collect()] == ["d_test.txt", "e_test.txt"]
    one_line = files.singletons(spark.createDataFrame([("f", 0, " x\t")], "file string, line_no int, line string")).first()
    assert (one_line["text"], one_line["label"]) == ("x", 0)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("l", "r", 1, 0.9, "extra")], "left string, right string, match int, match_confidence double, more string")
    files.write_predictions(rows, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).columns == ["left", "match", "match_confidence", "right"]
    for k in range(2):
        files.append_runtime(spark, f"task_{k}", 1.5 + k, str(tmp_path / "log"))
        files.append_metrics(spark.createDataFrame([(k, 0.5)], "run int, f1 double"), str(tmp_path / "metrics"))
        files.append_best(spark.createDataFrame([("t", 100, "nn")], "task string, budget int, best_method string"), str(tmp_path / "best"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["task_0 1.500000", "task_1 2.500000"]
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == spark.read.csv(str(tmp_path / "best")).count() == 2
    (tmp_path / "c.json").write_text('[{"name": "x", "vocab": ["0", "1"]}, {"name": "y", "vocab": []}]')
    assert files.read_catalog(spark, str(tmp_path / "c.json"))["x"]["vocab"] == ["0", "1"]
    shown = files.report(spark.createDataFrame([(1, "d", "f1", 0.5, 0.1), (1, "e", "f1", None, None)], "budget int, domain string, metric string, mean double, std double"))
    assert [r["line"] for r in shown.collect()] == ["d f1: 0.5000 ± 0.1000", "e f1: nan"]


def test_negatives_reach_further(spark):
    """Nearly all near pairs are known already, so the first tries don't bring enough."""
    titles = [f"t{i:02d}" for i in range(24)]
    order = [r["t"] for r in spark.createDataFrame([(t,) for t in titles], "t string").orderBy(F.md5(F.concat_ws("|", F.lit("22"), "t"))).collect()]
    rows = [("d", order[i], order[j], 0) for i in range(24) for j in range(i + 1, min(i + 9, 24))]
    table = spark.createDataFrame(rows, "domain string, left string, right string, label int")
    out = augment.negatives(table, augment.needed(table, len(rows) + 20), tries=1).collect()
    assert len(out) == 20
    assert [order.index(r["right"]) - order.index(r["left"]) for r in sorted(out, key=lambda r: order.index(r["right"]) - order.index(r["left"]))][:15] == [9] * 15


def test_blocks_give_the_whole(spark, monkeypatch):
    """Discrepancies and densities don't depend on the size of blocks."""
    from pairloom.operators import discrepancy

    rng = np.random.default_rng(5)
    rows = [(d, i, "train" if i % 3 else "val", rng.normal(size=6).tolist()) for d in range(2) for i in range(40)] + [(9, 0, "train", [1.0] * 6)]
    table = spark.createDataFrame(rows, "domain int, pair_idx long, kind string, v array<double>")
    want = {}
    for d in range(2):
        x, y = (np.array([v for e, _, k, v in rows if e == d and k == kind]) for kind in ("train", "val"))
        want[d] = kernels.mmd(x, y), kernels.log_density(x, y).mean(axis=1)
    monkeypatch.setattr(kernels, "CELLS", 50)
    for most in (7, 1000):
        assert {r["domain"]: pytest.approx(r["mmd"]) for r in discrepancy.mmd_by_domain(table, most).collect()} == {d: want[d][0] for d in want}
        got = discrepancy.log_densities(table, most).orderBy("domain", "pair_idx").collect()
        assert [r["log_density"] for r in got] == pytest.approx(np.concatenate([want[0][1], want[1][1]]).tolist())
    own, goal, cand = ((rng.normal(size=(n, 5)), rng.normal(size=(n, 5))) for n in (30, 20, 25))
    small_blocks = [f(own, goal, cand) for f in (kernels.mmd_gain, kernels.kde_gain, kernels.kde2d_density)]
    monkeypatch.setattr(kernels, "CELLS", 1 << 22)
    for f, got in zip((kernels.mmd_gain, kernels.kde_gain, kernels.kde2d_density), small_blocks, strict=True):
        assert np.allclose(got, f(own, goal, cand))


def _plain_summary(sides, weights, max_len, size):
    """The summariser over one pair, token by token."""
    count = {}
    for token in (t for s in sides for t in (s or "").split(" ")):
        if token not in ("COL", "VAL", "the") and token in weights:
            count[token] = count.get(token, 0) + weights[token]
    out = []
    for s in sides:
        tokens = [] if s is None else s.split(" ")
        total, kept = sum(t in ("COL", "VAL") for t in tokens), set()
        for t in sorted(dict.fromkeys(tokens), key=lambda t: (-round(count.get(t, 0), 9), tokens.index(t)))[:max_len]:
            total += size(t)
            if total > max_len:
                break
            kept.add(t)
        shown = [t for i, t in enumerate(tokens) if t in ("COL", "VAL") or (t in kept and t not in tokens[:i])]
        out.append("".join(f"{t} " for t in shown))
    return tuple(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_summary_joins_no_token_rows(spark, tmp_path, monkeypatch, broadcast):
    import random

    rnd = random.Random(5)
    words = ["COL", "VAL", "the", "", *[f"w{i}" * (1 + i % 3) for i in range(30)]]
    side = lambda: None if rnd.random() < 0.05 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(25)))
    rows = [(i, side(), side(), i % 2) for i in range(200)]
    spark.createDataFrame(rows, "pair_id long, left string, right string, label int").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    weights = text.idf(pairs)
    idf = {r["token"]: r["idf"] for r in weights.collect()}
    if not broadcast:
        monkeypatch.setattr(text, "small", lambda df: df)
    for length, size in ((None, lambda t: 1), (F.length, len)):
        out = text.summarize(pairs, weights, 9, ("the",), length)
        got = {r["pair_id"]: (r["left"], r["right"]) for r in out.collect()}
        assert got == {i: _plain_summary((a, b), idf, 9, size) for i, a, b, _ in rows}
        # Tables of tokens look small to the optimizer, whatever they are: only the counted vocabulary may go through the driver.
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [token") == int(broadcast)
