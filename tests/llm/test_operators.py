"""Edge cases and brute-force comparisons of the operators on small fixtures."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import common, components, exact_dedup, hnsw, labelled, mixing, packing, quality, simhash, token_codec, token_files, tokenize, toxicity, url_filter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, key string, label int, fp string"


def docs(spark, rows):
    """rows of (doc_id, text, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 7, "k", 3, "f") for i, t, s in rows], DOC)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def mess():
    """Nulls, empty texts, copies, near copies, repeated rows, a long text."""
    base = prose(1, 300)
    rows = [(1, "a b c", "s1"), (2, "a  b c", "s1"), (3, None, None), (4, "", "s2"), (5, " \t\n", "s2"), (6, "ab c", "s2"), (7, base, "s1"), (8, base + " tail", "s3")]
    rows += [(9, base.replace("alpha", "ALPHA"), "s3"), (10, prose(2, 60_000), "s1"), (11, "x", "é"), (11, "x", "é"), (None, "null id", "s1"), (12, "Ärger\u00a0ä\U0001f600 x", "s2")]
    rows += [(20 + k, prose(7, 80), f"s{k % 3}") for k in range(12)]
    return rows


def test_exact_dedup(spark):
    rows = mess()
    out = exact_dedup.deduplicate(docs(spark, rows), exact_dedup.new_index(docs(spark, rows))).collect()
    assert len(out) == len(rows)
    group = {}
    for i, t, _ in rows:
        group.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\f\r"), []).append((i, t or ""))
    for r in out:
        own = next(g for g in group.values() if any(i == r["doc_id"] for i, _ in g))
        best = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        assert (r["keep_id"], r["group_size"]) == (best[0], len(own))
    assert sum(r["kept"] for r in out) == len(group)
    stay = exact_dedup.keep_first(docs(spark, rows)).collect()
    assert len(stay) == len(group) and len(stay[0]) == 10


def test_exact_dedup_index_persists(spark, tmp_path):
    first, second = docs(spark, [(1, "a b", "s"), (2, "c", "s")]), docs(spark, [(3, "ab", "s"), (4, "d  d", "s"), (5, "d d", "s")])
    path = f"file://{tmp_path}/index"
    exact_dedup.deduplicate(first, exact_dedup.new_index(first, path, 4)).collect()
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(second, exact_dedup.new_index(second, path, 4)).collect()}
    assert got == {3: (1, False), 4: (4, True), 5: (4, False)}
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(second, exact_dedup.new_index(second, path, 4)).collect()}
    assert again == got


def test_exact_dedup_index_is_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILES", 2)
    path = f"file://{tmp_path}/index"
    for k in range(5):
        rows = docs(spark, [(10 * k + j, f"text {k} {j}", "s") for j in range(9)] + [(900 + k, "text 0 0", "s")])
        got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.deduplicate(rows, exact_dedup.new_index(rows, path, 2)).collect()}
        assert got == {10 * k + j: 10 * k + j for j in range(9)} | {900 + k: 0}
    index = exact_dedup.new_index(rows, path)
    assert index.generation >= 1 and index.buckets == 2 and len(index.read().inputFiles()) <= 4
    assert index.read().count() == 45 == index.read().select("digest").distinct().count()
    index.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name == index.table]


def test_exact_dedup_index_has_a_file_a_bucket_however_keys_are_dealt(spark, tmp_path, monkeypatch):
    frame = type(spark.range(0))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: plain(self, max(13, n) if cols and isinstance(n, int) else n, *cols))
    rows = docs(spark, [(k, f"text {k}", "s") for k in range(200)])
    index = exact_dedup.new_index(rows, f"file://{tmp_path}/index", 3)
    assert exact_dedup.deduplicate(rows, index).where("kept").count() == 200
    assert index.generation == 0 and len(index.read().inputFiles()) == 3 and index.read().count() == 200
    index.close()


def test_kept_rows_by_rule(spark):
    """Rows that repeat a doc_id: the longest text stays, then the smallest; columns that operators use inside are no trouble."""
    rows = [(1, "a b", "z"), (1, "ab", "z"), (1, "a   b", "z"), (1, "a \t b", "z"), (2, "ab", "z"), (None, "n  n", "z"), (None, "nn", "z")]
    named = docs(spark, rows).withColumnsRenamed({"digest": "_key", "size": "_id", "key": "_digest", "label": "_hash", "fp": "_doc_id"})
    for part in (1, 3):
        out = exact_dedup.keep_first(named.repartition(part))
        assert out.columns == named.columns
        assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "n  n"), (1, "a \t b")]
        near = simhash.keep_one(named.where("doc_id IS NOT NULL").repartition(part))
        assert near.columns == named.columns
        # "ab" of 1 and 2 are one component, the texts of two words others.
        assert sorted((r["doc_id"], r["text"]) for r in near.collect()) == [(1, "a \t b")]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(spark):
    rows = [r for r in mess() if r[0] is not None]
    out = simhash.components(docs(spark, rows)).collect()
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert len(out) == len(rows)
    assert all(r["fp"] % 2**64 == prints[r["doc_id"]] for r in out)
    want = brute_components(prints)
    assert all(r["component_id"] == want[r["doc_id"]] for r in out)
    stay = simhash.keep_one(docs(spark, mess()))
    assert sorted(r["doc_id"] for r in stay.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("group", [4096, 8])
def test_links_equal_brute_force(spark, group):
    """Dense clusters, chains and pairs at each distance; small groups force the split of hot keys into blocks."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            prints.add(at)
            flip = at
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6])):
                flip ^= 1 << b
            at = flip if rng.random() < 0.5 else at
            prints.add(flip)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    fps = common.materialize(spark.createDataFrame(signed, "fp long"), "fps")
    found = components.connected_components(simhash.links(fps, group)).collect()
    label = {p: p for p in prints} | {r["node"] % 2**64: r["label"] % 2**64 for r in found}
    want = brute_components({p: p for p in prints})
    same = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert same(label) == same(want)


def test_chain_pass_is_the_pigeonring():
    rng = np.random.default_rng(3)
    for n in range(5):
        bits = np.array([rng.choice(64, n, replace=False) for _ in range(300)])
        x = np.zeros(300, dtype="uint64")
        for j in range(n):
            x |= np.uint64(1) << bits[:, j].astype("uint64")
        hit = np.zeros(300, dtype=bool)
        for start in range(4):
            hit |= simhash.chain_pass(x, start)
        assert hit.all() if n <= 3 else not hit.any()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 3), (200, 201)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_pieces_equal_the_library():
    enc = tokenize.Encoder(tokenize.default_tokenizer())
    rng = random.Random(9)
    hard = ["don't!'s it  is\n\n  ok. a.b,c 'll", "αβγ. test ab1, 12.5 ,, a , b |c| ", " x", "x  ", "\n\n", "a<|endoftext|>b", "日本語。x word、 w", "x\x1cy z", "a\u00a0 b", ""]
    alphabet = "ab .,'!\n\téß1日\u00a0|-<>\x1f"
    texts = hard + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    whole = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == whole
    small = tokenize.Encoder(tokenize.default_tokenizer(), memo=2000)
    assert small.encode(texts) == whole


def test_new_words_go_to_the_library_together():
    """Each different word once, many in a call; with the same ids if no byte is free to join them with."""
    enc = tokenize.Encoder(tokenize.default_tokenizer())
    rng, real, calls = random.Random(4), enc.tokenizer, []
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = [some("abcdeinorstéü", rng.randint(5, 12)) + some(".,$#%&-'_~\x00", rng.choice([0, 0, 1, 3])) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)).replace("e ", "e\n") for _ in range(50)]
    whole = enc._whole(texts)

    class Counting:
        @property
        def model(self):
            return self

        def tokenize(self, text):
            calls.append(text)
            return real.model.tokenize(text)

        def __getattr__(self, name):
            return getattr(real, name)

    enc.tokenizer = Counting()
    assert enc.encode(texts) == whole
    assert len(calls) < 100
    alone = tokenize.Encoder(tokenize.default_tokenizer())
    alone.between = None
    assert alone.encode(texts) == whole


def test_long_texts_equal_the_library(monkeypatch):
    """Cuts of long texts, a memo that turns over inside a text, and packing that is linear in the text's length."""
    import time

    monkeypatch.setattr(tokenize, "PART", 50)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  cé.,\n\u00a0x") for _ in range(rng.randint(0, 900))) for _ in range(100)]
    enc = tokenize.Encoder(tokenize.default_tokenizer(), memo=3000)
    assert enc.encode(texts) == enc._whole(texts)
    assert 2 * (enc.inner.held + enc.first.held + enc.memo.held) < 3000 + 20_000

    def seconds(n):
        packer, began = packing.Packer(16, 2048, 0), time.process_time()
        packer.add(1, 0, bytes(4 * n), n)
        assert len(packer.out) == n // 2048
        return time.process_time() - began

    assert seconds(32 << 20) < 40 * max(seconds(4 << 20), 0.002)


def test_added_tokens_equal_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenize.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny  z", "a <|endof text|> b", "<|endoftext", "plain words. here"]
    enc = tokenize.Encoder(tokenize.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(enc.encode(texts[:1])[0], "<u4").tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("n", [1, 5, 64, 65, 1000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**32, n), np.minimum(rng.zipf(1.3, n), 50000), np.zeros(n, int), np.arange(n) % 3 * 20000, np.arange(n) % 7 // 3):
        stored, base, places = token_codec.base_of(ids.astype("uint32"))
        again = token_codec.stored_base(stored)
        p = token_codec.encode_blocks(places, base, 64)
        sizes = [64] * (n // 64) + ([n % 64] if n % 64 else [])
        back = token_codec.decode_blocks(p, sizes, again)
        assert np.array_equal(again.ids[np.concatenate(back)], ids)
        # Each block is decoded alone.
        assert all(np.array_equal(token_codec.decode_blocks([x], [k], again)[0], y) for x, k, y in zip(p, sizes, back, strict=True))
    assert token_codec.encode_blocks(places[:0], base) == token_codec.decode_blocks([], [], base) == []


def test_codec_of_very_many_ids():
    ids = np.random.default_rng(1).permutation(400_000).astype("uint32") * 9000
    stored, base, places = token_codec.base_of(ids)
    p = token_codec.encode_blocks(places, base)
    back = token_codec.decode_blocks(p, [4096] * (len(p) - 1) + [len(ids) - 4096 * (len(p) - 1)], token_codec.stored_base(stored))
    assert np.array_equal(base.ids[np.concatenate(back)], ids)


def test_codec_learns():
    ids = np.tile(np.arange(50, dtype="uint32") * 7, 200)
    _, base, places = token_codec.base_of(ids)
    assert sum(map(len, token_codec.encode_blocks(places, base))) < len(ids) * 0.1


def test_codec_beats_zlib_and_zstd():
    """On the ids of texts whose words follow a Zipf law, and on the real table: fewer bits than both on the same blocks."""
    import pyarrow.parquet as pq
    import zstandard

    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    texts = [" ".join(vocabulary[k - 1] for k in rng.zipf(1.4, 400) if k <= len(vocabulary)) for _ in range(200)]
    real = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for own in (texts, [t or "" for t in real]):
        ids = np.frombuffer(b"".join(tokenize.encoder(tokenize.default_tokenizer()).encode(own)), "<u4")
        stored, base, places = token_codec.base_of(ids)
        size = len(stored) + 12 + sum(len(p) + 12 for p in token_codec.encode_blocks(places, base))
        blocks = [ids[i : i + token_codec.BLOCK].astype("<u2").tobytes() for i in range(0, len(ids), token_codec.BLOCK)]
        assert size < sum(len(zlib.compress(b, 9)) for b in blocks)
        assert size < sum(len(zstandard.ZstdCompressor(level=3).compress(b)) for b in blocks)


def brute_ids(rows, end):
    enc = tokenize.Encoder(tokenize.default_tokenizer())
    return [np.frombuffer(x, "<u4").tolist() + [end] for x in enc._whole([t or "" for _, t, _ in rows])]


def test_token_files(spark):
    rows = [r for r in mess() if r[0] is not None]
    table = docs(spark, rows)
    files = token_files.write_tokens(table, common.shared_path(spark, "tokens"))
    out = token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).orderBy("start").collect()
    order = sorted(zip(rows, brute_ids(rows, 2), strict=True), key=lambda x: x[0][0])
    start = 0
    for r, ((i, _, _), ids) in zip(out, order, strict=True):
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    with_null = token_files.read_tokens(token_files.write_tokens(docs(spark, mess()), common.shared_path(spark, "tokens"))).collect()
    assert len(with_null) == len(mess()) and max(with_null, key=lambda r: r["start"])["doc_id"] is None


def test_damaged_token_file_is_found(spark, tmp_path):
    from pairloom.llm import store

    counts = {}
    import pyarrow as pa

    store.write_file(f"{tmp_path}/a", token_codec.file_chunks(iter([(1, np.arange(5000, dtype="<u4").tobytes())]), pa.int64(), counts))
    data = bytearray((tmp_path / "a").read_bytes())
    data[40] ^= 255
    (tmp_path / "b").write_bytes(data)
    with store.Reader(f"{tmp_path}/b") as r, pytest.raises(ValueError):
        list(token_codec.read_file(r))


def check_packed(out, rows, size):
    ids = brute_ids(rows, 1)
    pieces = {}
    for r in out:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    seen = sum(r["length"] for r in out)
    assert seen == sum(map(len, ids))
    own = {}
    for (i, _, _), x in zip(rows, ids, strict=True):
        own.setdefault((i, len(x)), []).append(x)
    for key, many in own.items():
        assert sorted(r["start"] for r in pieces[key])[0] == 0
        for r in pieces[key]:
            want = {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in many}
            assert zlib.crc32(r["ids"]) in want
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0


@pytest.mark.parametrize(("size", "windows"), [(64, 3), (2048, 16)])
def test_packing(spark, size, windows):
    rows = mess()
    out = packing.pack(docs(spark, rows).repartition(5), size=size, windows=windows).collect()
    check_packed(out, rows, size)


def test_packing_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)
    rows = [(k, prose(k, 30), "s") for k in range(40)]
    out = packing.pack(docs(spark, rows).repartition(9), size=128, windows=2).collect()
    check_packed(out, rows, 128)


def test_mixing(spark):
    rows = [r for r in mess() if r[0] != 10] + [(100 + k, prose(k, 5 + k % 40), f"s{k % 3 + 1}") for k in range(300)] + [(500, prose(1, 3), "tiny")]
    out = mixing.mix(docs(spark, rows), piece=50).collect()
    assert len(out) == len(rows)
    sizes, n = {}, {}
    for i, t, s in rows:
        n.setdefault(s, []).append(len((t or "").encode().split()))
    sizes = {s: sum(x) for s, x in n.items()}
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    goal, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 3 * sizes[s]}
        if not full:
            goal |= share
            break
        for s in full:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        free -= full
    taken = dict.fromkeys(order, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(6, 0.05 * goal[s]), s
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(7), piece=50).collect()), key=str)
    copied = mixing.apply_mix(docs(spark, rows), piece=50)
    assert copied.columns == docs(spark, rows).columns
    assert copied.count() == sum(r["copies"] for r in out)


def test_mixing_equals_a_plain_solver(spark):
    """Rates of 300 documents against a solver of the dual in one process, with null and one-document sources."""
    rng = random.Random(8)
    sizes = [(k, int(rng.paretovariate(1.1) * 20) if k % 9 else 0, rng.choice(["a", "a", "a", "b", "c", None, "d"])) for k in range(299)] + [(299, 5, "e")]
    table = docs(spark, [(k, " ".join(["w"] * n), s) for k, n, s in sizes])
    out = mixing.mix(table).collect()
    assert len(out) == 300
    for source in {s for _, _, s in sizes}:
        own = [r for r in out if r["source"] == source]
        x = np.array([r["size"] for r in own], dtype=float)
        goal = own[0]["target"]
        lo, hi = -50.0, 50.0
        rate = lambda l: np.exp(np.minimum(l * x, np.log(3)))
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (x * rate(mid)).sum() < goal else (lo, mid)
        want = rate(hi) if goal < 3 * x.sum() * (1 - 1e-9) else np.where(x > 0, 3.0, 1.0)
        got = np.array([r["rate"] for r in own])
        assert np.abs(got - want).max() < 1e-6
        assert all(r["copies"] == 1 for r in own if r["size"] == 0)
        if len(own) > 20 and goal < 2.9 * x.sum():
            assert len(set(got.round(6))) > 10  # rates differ inside a source
            assert abs((x * got).sum() - goal) <= 1e-6 * goal
            taken = sum(r["size"] * r["copies"] for r in own)
            assert abs(taken - goal) <= max(0.01 * goal, min(z for z in x if z))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.net/en/a?x#y", "https://a.example.com/de/1", "http://example.com", "ftp://b.org/fr/", "http://x.net", "http://x.net/", "a://b://c.net/d"]
    urls += [f"http://spam.example.com/de/{k}" for k in range(60)] + [f"http://good.example.com/en/{k}" for k in range(60)] + [f"http://spam.example.com/xx/{k}" for k in range(6)]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        cut = min([len(rest)] + [rest.find(c) for c in "/?#" if c in rest])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([len(tail)] + [tail.find(c) for c in "?#" if c in tail])]
        fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=lambda x: len(x[0])) if fit else None

    for k, u in enumerate(urls):
        host, path, rule = brute(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule and rule[0])
        if rule:
            assert got[k]["verdict"] == rule[1]
    # 60 of 66 pages of the host are blocked by rule, so the mined rule blocks the others; the good host stays.
    assert all(got[k]["verdict"] == "block" and got[k]["confidence"] > 0.8 for k in range(len(urls) - 6, len(urls)))
    assert all(got[k]["verdict"] == "allow" for k in range(70, 130))
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_nulls_ties_and_long_urls(spark):
    """Null ids, repeated rows, clashing names, a very long URL; of equal mined rules the first by tokens and verdict decides."""
    long = "http://bad.example.net/" + "p/" * 5000 + "?" + "&".join(f"k{i}=1" for i in range(500))
    urls = [(None, "http://a.net/"), (None, None), (1, "http://a.net/"), (1, "http://a.net/"), (2, long), (3, "://"), (4, "http://")]
    urls += [(10 + k, f"http://x.example.com/de/tie/{k}") for k in range(30)] + [(50 + k, f"http://x.org/fr/knot/{k}") for k in range(30)]
    urls += [(90, "http://other.info/a/tie"), (91, "http://other.info/tie"), (92, "http://x.info/tie/knot")]
    pages = spark.createDataFrame([(i, u, "rule", 1, []) for i, u in urls], "page_id long, url string, tokens string, confidence int, items array<string>")
    runs = [sorted(map(str, url_filter.judge(pages.repartition(k)).collect())) for k in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(urls)
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert (got[1]["rule"], got[1]["verdict"], got[2]["rule"]) == ("net/", "block", "net/")
    assert got[2]["path"] == "/" + "p/" * 5000 and (got[3]["host"], got[4]["path"]) == ("", "")
    matcher = url_filter.Matcher([{"antecedent": ["b"], "verdict": "block", "confidence": 1.0}, {"antecedent": ["a"], "verdict": "allow", "confidence": 1.0}])
    assert matcher.best(["a", "b"]) == ("block", 1.0) and matcher.best(["c"]) == (None, None)
    ties = spark.createDataFrame([(["a", "b"], "block")] * 5 + [(["c"], "allow")] * 5 + [(["b", "c"], None)], "tokens array<string>, verdict string")
    mined = url_filter.mine(ties, 0.1, 0.5)
    assert [(r["antecedent"], r["verdict"]) for r in mined] == [(["a"], "block"), (["b"], "block"), (["c"], "allow")]


def test_tokens_of_the_whole_url(spark):
    urls = ["http://a.b.c.d.e.f.g.h.org/p/q/r/s7/t.html?id=1&page2=x;id=3&&=v&flag#z?no=1", "http://x.de/a#b://c?d=1", None, "none?x=1"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.host_of().alias("host"), url_filter.path_of().alias("path"), url_filter.query_of().alias("query"))
    got = [r[0] for r in rows.select(url_filter.tokens_of()).collect()]
    assert got[0] == ["t:org", "d:h.org", *(f"h:{x}" for x in "abcdefg"), "p1:p", "p2:q", "p3:r", "p4:s#", "p5:t.html", "q:id", "q:page#", "q:flag", "x:html"]
    assert got[1:] == [["t:de", "d:x.de", "p1:a"], [], []]


def test_rules_of_deep_segments_and_keys(spark):
    """What tells blocked URLs lies in the fourth segment, a deep host label or the query."""
    urls = [f"http://bad.example.net/a/b/c/spam?ad={k}" for k in range(40)] + [f"http://good.example.com/a/b/c/fine?id={k}" for k in range(40)]
    urls += ["http://other.org/a/b/c/spam", "http://other.org/?ad=1", "http://other.org/a/b/c/fine", "http://1.2.3.4.5.6.bad.other.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert [got[k] for k in range(80, 84)] == ["block", "block", "allow", "block"]


def plain_rules(rows, support, confidence):
    """All rules by counting every set of tokens of every row."""
    from itertools import combinations
    from math import ceil

    least, known, hits = max(1, ceil(support * len(rows))), {}, {}
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for own in combinations(sorted(tokens), k):
                known[own] = known.get(own, 0) + 1
                if verdict:
                    hits[own, verdict] = hits.get((own, verdict), 0) + 1
    good = {(own, v): n / known[own] for (own, v), n in hits.items() if n >= least and n / known[own] >= confidence}
    for (own, v), chance in sorted(good.items()):
        if not any(good.get((part, v), 0) >= chance for k in range(1, len(own)) for part in combinations(own, k)):
            yield own, v, chance, hits[own, v] / len(rows)


@pytest.mark.parametrize("sets", [10**9, 0])
def test_mining_equals_all_rules(spark, sets):
    """FP-growth and the way by levels, against an enumeration; ties, repeated rows, rows without tokens or label."""
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        own = {f"t:{rng.randint(0, 2)}", f"d:{rng.randint(0, 4)}", *(f"p{k}:{rng.randint(0, 1)}" for k in range(rng.randint(0, 4)))}
        bad = "p0:1" in own and ("d:1" in own or rng.random() < 0.3)
        rows.append((sorted(own), rng.choice(["block", "block", None]) if bad else rng.choice(["allow", "allow", "allow", "block", None])))
    rows += [(["a", "b", "c"], "block")] * 40 + [([], "allow")] * 9 + [(["a"], None)] * 7 + [([], None)] * 5
    table = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = url_filter.mine(table, 0.02, 0.6, sets)
    want = list(plain_rules([r for r in rows if r[0] or r[1]], 0.02, 0.6))
    assert len(want) > 5
    assert sorted((tuple(r["antecedent"]), r["verdict"], r["confidence"], r["support"]) for r in got) == sorted(want)


def test_mined_rules_of_hot_patterns(spark):
    """Two patterns of 14 tokens, a third of all rows each, don't cost an unrelated host its rule: no cap, no doubled support."""
    rows = [([f"{x}{k}" for k in range(14)], v) for x, v in (("a", "block"), ("b", "allow")) for _ in range(300)] + [([f"a{k}" for k in range(14)], None)] * 30
    rows += [(["d:rare", "p1:x"], "block")] * 6 + [(["d:rare"], None)] * 30 + [(["p1:x"], None)] * 30 + [(["d:other"], None)] * 200
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert {"antecedent": ["d:rare", "p1:x"], "verdict": "block", "confidence": 1.0, "support": 6 / len(rows)} in got
    assert len(got) == 14 + 14 + 1


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(4)
    rows = [(sorted(rng.sample("abcdefg", rng.randint(0, 5))), rng.choice(["block", "allow", None])) for _ in range(150)]
    rows = [(t + ["z"] if "a" in t else t, "block" if {"a", "b"} <= set(t) and rng.random() < 0.9 else v) for t, v in rows]
    total, kept = sum(bool(t) or v is not None for t, v in rows), []
    for size in range(1, 9):
        level = []
        for own in map(list, combinations("abcdefgz", size)):
            hit = [v for t, v in rows if set(own) <= set(t)]
            for v in ("allow", "block"):
                n = hit.count(v)
                if n >= 0.02 * total and n / len(hit) >= 0.5 and not any(w == v and c >= n / len(hit) and set(k) < set(own) for k, w, c, _ in kept):
                    level.append((own, v, n / len(hit), n / total))
        kept += level
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support=0.02, confidence=0.5)
    assert sorted((r["antecedent"], r["verdict"], r["confidence"], r["support"]) for r in got) == sorted(kept) and len(kept) > 5


def test_matcher_equals_all_rules():
    rng = random.Random(1)
    rules = [{"antecedent": rng.sample("abcdefgh", rng.randint(1, 3)), "verdict": rng.choice(["block", "allow"]), "confidence": 0.9, "support": 0.1} for _ in range(40)]
    index = url_filter.Matcher(rules)
    for _ in range(200):
        own = set(rng.sample("abcdefgh", rng.randint(0, 6)))
        first = next((r for r in rules if set(r["antecedent"]) <= own), None)
        assert index.best(own)[0] == (first and first["verdict"])


def test_warc(spark):
    big = "<html>" + "x" * 200
    rows = [(5, "http://b.org/1", big), (3, "http://a.b.org/2?q= 1", big), (9, None, big), (7, "http://b.org/1", None), (8, "http://b.org/1", ""), (2, "x", "short"), (1, "y", "short")]
    rows += [(4, "http://ü.de/é\n", "é" * 80), (6, "http://z.de", "é" * 80), (11, "http://z.de", "é" * 80), (11, "http://z.de", "é" * 80)]
    rows += [(1000 + k, f"http://host.de/{k % 7}", "page %d " % k * 30) for k in range(1500)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    folder = common.shared_path(spark, "warc")
    captures = warc.write_archives(pages, f"{folder}/a")
    files = warc.write_index(captures, f"{folder}/i")
    found = warc.lookup(files, captures.select("key").distinct())
    got = warc.fetch(found).collect()
    assert len(got) == len(rows)
    import hashlib

    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for r in got:
        h = next(x[2] for x in rows if x[0] == r["page_id"]) or ""
        data = h.encode()
        revisit = len(data) >= 100 and first[h] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else data)
    some = spark.createDataFrame([(warc.surt("http://host.de/3"),), ("nothing",), ("zzz",)], "key string")
    hit = warc.lookup(files, some).collect()
    assert sorted(r["page_id"] for r in hit) == [1000 + k for k in range(1500) if k % 7 == 3]
    empty = warc.write_archives(pages.limit(0), f"{folder}/e")
    assert warc.fetch(warc.lookup(warc.write_index(empty, f"{folder}/ei"), empty.select("key").distinct())).count() == 0


def test_hnsw(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)).round(3)
    x[100:400] = x[7]  # very many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [1.0] * 7 + [None]), (1300, [1.0] * 7 + [float("nan")]), (1400, [float("inf")] * 8), (1500, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "q") for i, v in [*rows, *bad, rows[0]]], "vec_id long, embedding array<double>, score int, v string")
    out = hnsw.nearest(table).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-12 for _, i, s in found)
        hit += len(set(want) & {f[1] for f in found})
    assert hit >= 0.9 * 10 * len(got)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["vec_id"]) for r in hnsw.nearest(few).collect()} == {(0, 1), (0, 100), (100, 0), (100, 1)}
    assert hnsw.nearest(few.limit(0)).count() == 0


@pytest.mark.parametrize(("offset", "scale"), [(0, 1.0), (1e5, 1.0), (0, 1e25), (0, 1e-25), (0, 1e200)])
def test_graph_recall(offset, scale):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(2000, 32)) + offset) * scale
    x = np.ldexp(v, -int(np.floor(np.log2(np.abs(v).max()))))
    graph, hits = hnsw.build(x), 0
    for q in x[:100]:
        found, dist = graph.search(q, 10, hnsw.EF)
        d = ((x - q) ** 2).sum(1)
        assert len(found) >= 10 and np.allclose(dist, np.sort(d[found]), rtol=1e-12) and (np.diff(dist) >= 0).all()
        hits += len(set(found[:10].tolist()) & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 1000


def test_graph_is_stored_whole(tmp_path):
    from pairloom.llm import store

    x = np.random.default_rng(2).normal(size=(500, 4))
    graph = hnsw.build(x)
    ids = [[p, 1000 + p][: 1 + p % 2] for p in range(500)]
    store.write_file(f"{tmp_path}/a", hnsw.stored(graph, ids))
    again, ends, flat = hnsw.load(f"{tmp_path}/a")
    assert [flat[ends[p - 1] if p else 0 : ends[p]].tolist() for p in range(500)] == ids
    for q in x[:20]:
        assert [y.tolist() for y in graph.search(q, 10, 50)] == [y.tolist() for y in again.search(q, 10, 50)]


def test_hnsw_lengths_scales_and_ties(spark):
    """Two vector lengths, far points that a walk doesn't reach, equal distances across shards; all candidates if there are few."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)) * 1e25)]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(301, 3)))] + [(5000, [1.0]), (5001, [4.0]), (5002, [-2.0]), (5100, [7.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    by_id = {i: np.array(v) for i, v in rows}
    for q in (i for i in by_id if i % 100 == 0):
        want = sorted((float(np.sqrt(((by_id[i] - by_id[q]) ** 2).sum())), i) for i in by_id if i != q and len(by_id[i]) == len(by_id[q]))[:10]
        found = sorted(got.get(q, []))
        assert [f[1] for f in found] == [i for _, i in want]
        assert all(abs(f[2] - d) <= 1e-12 * d for f, (d, _) in zip(found, want, strict=True))
    ring = [(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(1, 40)] + [(100, [0.0, 1e-300])]
    ties = [(k, [1.0 if k % 2 else -1.0, float(k % 3 - 1)]) for k in range(1, 60)] + [(200, [0.0, 50.0])]
    for own in (ring, ties):
        out = hnsw.nearest(spark.createDataFrame(own, "vec_id long, embedding array<double>")).collect()
        q = own[-1]
        want = sorted((float(np.sqrt(((np.array(v) - np.array(q[1])) ** 2).sum())), i) for i, v in own[:-1])[:10]
        assert [round(r["score"], 12) for r in sorted(out, key=lambda r: r["rank"])] == [round(d, 12) for d, _ in want]
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == [i for _, i in want]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    rng = random.Random(2)
    texts, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        sentences = [prose(i * 10 + k, 8) for k in range(6)]
        if toxic:
            sentences[rng.randrange(6)] += " you " + rng.choice(["blarg", "fnords", "blargish"]) + " now"
        texts.append(". ".join(sentences) + ".")
        marks.append((i, int(toxic), 1))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s"), (None, "text", "s"), (902, "123 !!", "s")]
    table = docs(spark, rows)
    model = toxicity.fit(labelled.labelled_sample(table, labels(spark, [*marks, (None, 1, 1), (950, 1, 1)]), "toxic", 150))
    got = {r["doc_id"]: r for r in toxicity.score(table, model, spans=True).collect()}
    assert len(got) == len(rows)
    right = sum((got[i]["score"] >= 0.5) == bool(m) for i, m, _ in marks)
    assert right >= 0.97 * len(marks)
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] == 0.0
    hits = [(i, s) for i, m, _ in marks if m for s in got[i]["offending"]]
    assert len(hits) >= 90 and all(any(w in texts[i][s["start"] : s["end"]] for w in ("blarg", "fnord")) for i, s in hits)
    none = toxicity.fit(labelled.labelled_sample(table, labels(spark, []), "toxic", 10))
    assert toxicity.score(table, none).where("score <> 0").count() == 0


def test_toxicity_equals_a_plain_noisy_or(spark):
    """Scores recomputed sentence by sentence from the weights; weights that no small change improves; rows and labels that repeat."""
    import math
    import re

    texts = [prose(k, 12) + ". " + ("ugh blarg. " if k % 3 == 0 else "") + prose(k + 500, 9) for k in range(120)]
    sample = [(t, int(k % 3 == 0), 1.0) for k, t in enumerate(texts)]
    model = toxicity.fit(sample)

    def plain(text):
        none = 1.0
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = set(re.findall(r"[^\W\d_]+", sentence))
            if words:
                shown = {f for w in words for f in ["=" + w, *(w[:k] for k in range(3, 7) if len(w) >= k)] if f in model["weights"]}
                none *= 1 - 1 / (1 + math.exp(-(model["bias"] + sum(model["weights"][f] for f in shown))))
        return 1 - none

    long = ". ".join(texts) * 40
    rows = [(k, t, "s") for k, t in enumerate([*texts, long, "", "?!"])] + [(0, texts[0], "s")] * 3
    got = toxicity.score(docs(spark, rows).withColumnsRenamed({"digest": "score", "fp": "bias"}), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(plain(dict((i, t) for i, t, _ in rows)[r["doc_id"]]), abs=1e-9)
    # Labels: those of one id count by their mean, none of held-out rows count, the sample is whole texts within the bytes.
    marks = labels(spark, [(1, 1, 1), (1, 0, 1), (2, 0, 0), (2, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 1), (7, None, None)])
    table = docs(spark, [(k, f"text {k}", "s") for k in range(10)] + [(1, "text 1", "s")])
    found = labelled.labelled_sample(table, marks, "toxic", 10)
    want = {f"text {k}": v for k, v in ((1, 1), (2, 0), (3, 1)) if zlib.crc32(str(k).encode()) % 5}
    assert {t: v for t, v, _ in found} == want and len(found) == len(want)
    big = docs(spark, [(k, "x" * (1000 if k % 2 else 10), "s") for k in range(200)])
    some = labelled.labelled_sample(big, labels(spark, [(k, 1, 1) for k in range(200)]), "toxic", 200, 3000)
    assert sum(len(t) for t, _, _ in some) <= 3000 and {len(t) for t, _, _ in some} == {10, 1000}


def test_quality_equals_plain_sizes(spark):
    """Scores recomputed from the sizes that zstandard gives piece by piece with each dictionary."""
    import zstandard

    sample = [(prose(k, 60), 1, 1.0) if k % 2 else (" ".join(f"BUY{k % 5} NOW{j}" for j in range(40)), 0, 1.0) for k in range(90)]
    model = quality.fit(sample)
    texts = [t for t, _, _ in sample[:20]] + ["", prose(3, 5000), "\u00e9\U0001f600 x"]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(0, texts[0], "s")] * 2 + [(77, None, "s")]
    got = quality.score(docs(spark, rows).withColumnsRenamed({"digest": "score", "fp": "good"}), model).collect()
    assert len(got) == len(rows)

    def size(text, dictionary):
        raw = text.encode()
        pieces = [raw[i : i + 1000] for i in range(0, len(raw), 1000)]
        own = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(own.compress(p)) for p in pieces)

    for r in got:
        text = {i: t for i, t, _ in rows}[r["doc_id"]] or ""
        x = [0.0, 0.0, 0.0]
        if text:
            good, bad, n = size(text, model["good"]), size(text, model["bad"]), len(text.encode())
            x = [(bad - good) / (bad + good), (bad - good) / n, (bad + good) / 2 / n]
        z = [min(4, max(-4, (a - m) / s)) for a, m, s in zip(x, model["curve"].mean, model["curve"].spread, strict=True)]
        terms = [1.0, *z, *(z[i] * z[j] for i in range(3) for j in range(i, 3))]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-float(np.dot(terms, model["curve"].beta)))), abs=1e-9)


def test_quality(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, prose(i, 150) if not bad else " | ".join(f"BUY!! {k % 5} NOW{k}" for k in range(i % 7, 60)), "s"))
        marks.append((i, 0, int(not bad)))
    rows += [(900, None, "s"), (901, "", "s"), (None, "t", "s")]
    table = docs(spark, rows)
    model = quality.fit(labelled.labelled_sample(table, labels(spark, marks), "quality", 150))
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [(i, q) for i, _, q in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(q) for i, q in held) >= 0.97 * len(held)
    stay = quality.accept(table, model)
    assert stay.columns == table.columns
    assert {r["doc_id"] for r in stay.collect()} == {i for i, s in got.items() if s >= 0.3}
    one = quality.fit(labelled.labelled_sample(table, labels(spark, [(1, 0, 1)]), "quality", 10))
    assert quality.accept(table, one).count() == len(rows)


def test_held_out_is_crc32(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", common.held_out("id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.deduplicate(none, exact_dedup.new_index(none)).count() == 0
    assert exact_dedup.keep_first(none).count() == 0
    assert simhash.components(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.apply_mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(none, common.shared_path(spark, "t"))).count() == 0
    model = toxicity.fit([])
    assert toxicity.score(none, model).count() == 0
    assert quality.score(none, quality.fit([])).count() == 0


def test_warc_nulls_and_large_payloads(spark):
    """Records without an id, payloads of megabytes, long and odd URLs; all come back whole."""
    import hashlib

    large, same = "<p>" + prose(3, 300_000), "z" * 150
    rows = [(None, "http://a.de/", same), (5, "http://a.de/" + "x" * 20_000, large), (6, None, large), (None, "http://b.de/", "only without an id " * 10), (7, "http://a.de/", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.shared_path(spark, "warc")
    captures = warc.write_archives(pages, f"{folder}/a")
    files = warc.write_index(captures, f"{folder}/i")
    got = warc.fetch(warc.lookup(files, captures.select("key").distinct())).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(5, "response", None, len(large), digest(large)), (6, "revisit", 5, len(large), digest(large)), (7, "response", None, 150, digest(same)),
            (None, "revisit", 7, 150, digest(same)), (None, "response", None, 190, digest(rows[3][2]))}
    assert {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got} == want and len(got) == 5
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 5} == {large.encode()}


@pytest.mark.parametrize("limit", [1, 3, 10**6])
def test_split_join(spark, limit):
    rows = [(k, ["a", "a", "a", None, "b"][k % 5]) for k in range(50)] + [(None, "a"), (7, "a"), (7, "a"), (1, "alone")]
    many = spark.createDataFrame(rows, "doc_id long, key string")
    one = spark.createDataFrame([("a", 33, 1.0), (None, 10, 2.0), ("b", 10, 3.0), ("c", 0, 4.0)], "key string, n long, x double")
    got = sorted((str(r["doc_id"]), str(r["key"]), r["x"]) for r in common.split_join(many, one, "key", "n", "doc_id", limit).collect())
    assert got == sorted((str(i), str(k), {"a": 1.0, None: 2.0, "b": 3.0}[k]) for i, k in rows if k != "alone")


def test_hot_groups_are_split(spark, monkeypatch):
    """Results with every group split are those without."""
    shown = lambda df: sorted(map(str, df.collect()))
    runs = []
    for limit in (common.SPLIT, 2):
        monkeypatch.setattr(common, "SPLIT", limit)
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0 if limit == 2 else 8 << 20)
        table = docs(spark, mess())
        runs.append((shown(exact_dedup.deduplicate(table, exact_dedup.new_index(table))), shown(simhash.components(table)), shown(mixing.mix(table))))
    assert runs[0] == runs[1]


def test_op_queries_and_pipeline(spark, tmp_path):
    """Each opN_ query has its columns and a row per row; each stage of the pipeline does what it says with the stage's own input."""
    import corpus_pipeline
    from pairloom.llm.queries import QUERIES

    rng = random.Random(4)
    rows = [(k, ". ".join(prose(k * 7 + j, 12) for j in range(rng.randint(1, 30))), f"s{k % 4}") for k in range(250)]
    rows += [(300 + k, " | ".join(f"BUY!! {k % 5} NOW{j}" for j in range(k % 7, 60)), "s1") for k in range(80)]
    rows += [(400 + k, rows[k][1].replace(" ", "  ", 1), "s2") for k in range(20)] + [(430 + k, rows[k][1].replace("alpha", "ALPHA"), None) for k in range(20)]
    rows += [(500, None, None), (501, "", "s9"), (None, prose(5, 30), "s1"), (502, prose(2, 30_000), "s3"), *[(9, rows[9][1], "s1")] * 3]
    marks = [(i, 0, int(not 300 <= i < 400)) for i, _, _ in rows[:330]]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, marks).write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    for name in ("op2_simhash", "op4_token_files", "op5_packing", "op6_toxicity", "op7_quality", "op9_exact_dedup", "op10_mixing"):
        out = QUERIES[name](spark, d).collect()
        assert name == "op5_packing" or len(out) == len(rows), name

    table, kept = docs(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in table.collect()]
        table = common.materialize(stage(spark, table, d), "test_stage")
        assert table.columns == docs(spark, []).columns, name
        kept[name] = before, [tuple(r) for r in table.collect()]

    before, after = kept["quality_classifier"]
    good = {r["doc_id"]: r["score"] >= quality.ACCEPT for r in quality.score(docs(spark, rows), quality.learned(spark, docs(spark, rows), d)).collect()}
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(after, key=key) == sorted((r for r in before if good[r[0]]), key=key)
    assert sum(300 <= (r[0] or 0) < 400 for r in after) < 8 and sum((r[0] or 0) < 250 for r in after) > 240
    before, after = kept["exact_dedup"]
    best = {}
    for r in before:
        own = "".join(c for c in r[1] or "" if c not in " \t\n\x0b\f\r")
        best[own] = min(best.get(own, r), r, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
    assert sorted(after, key=key) == sorted(best.values(), key=key)
    before, after = kept["simhash_near_dedup"]
    component = brute_components({r[0]: brute_fingerprint(r[1]) for r in before if r[0] is not None})
    assert sorted(after, key=key) == sorted((r for r in before if r[0] is None or component[r[0]] == r[0]), key=key)
    before, after = kept["mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs(spark, []).unionByName(spark.createDataFrame(before, DOC))).collect()}
    assert sorted(after, key=key) == sorted((r for r in before for _ in range(plan[r[0]])), key=key)
    check_packed(packing.pack(table).collect(), [(r[0], r[1], r[2]) for r in after], packing.SIZE)
    whole = corpus_pipeline.run(spark, d).collect()
    assert sum(r["length"] for r in whole) == sum(map(len, brute_ids([(r[0], r[1], r[2]) for r in after], 1)))
    docs(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_compiled_coder(spark):
    """The JVM's coder gives the plain one's bytes and reads them, for narrow and wide places, several pieces and a short last block."""
    import pyarrow as pa

    from pairloom.llm import jvm_codec

    jvm_codec.register(spark)
    rng = np.random.default_rng(3)
    some = (rng.zipf(1.3, 20_000) % 50_000).astype("u4")
    kinds = (np.concatenate([some, some[:5000]]), rng.permutation(np.arange(70_000, dtype="u4") * 61_000), np.zeros(9000, "u4"), np.array([2**32 - 1, 0, 7], "u4"))
    for ids in kinds:
        chunks = list(token_codec.file_chunks(iter([(1, ids.astype("<u4").tobytes())]), pa.int64(), {}))
        blocks = b"".join(chunks[2:-1])
        _, known, counts, places = token_codec.counted(ids)
        row = [x.tobytes() for x in (places.astype("<u2" if len(known) <= 1 << 16 else "<u4"), known.astype("<u4"), counts.astype("<u4"))]
        table = spark.createDataFrame([tuple(map(bytearray, (*row, blocks)))], "places binary, ids binary, counts binary, blocks binary")
        out = table.select(jvm_codec.encoded("places", "ids", "counts").alias("blocks"), jvm_codec.decoded("blocks", "ids", "counts").alias("ids")).first()
        assert bytes(out["blocks"]) == blocks and bytes(out["ids"]) == ids.astype("<u4").tobytes()
    broken = table.withColumn("blocks", F.lit(bytearray(blocks[:8] + bytes([blocks[8] ^ 1]) + blocks[9:])))
    with pytest.raises(Exception, match="damaged"):
        broken.select(jvm_codec.decoded("blocks", "ids", "counts")).collect()


def test_token_files_are_plain_files(spark, tmp_path):
    """The files are those that token_codec writes, and it reads them."""
    import pyarrow as pa

    from pairloom.llm import store

    table = docs(spark, mess()).repartition(3)
    files = token_files.write_tokens(table, f"file://{tmp_path}/t").orderBy("part").collect()
    back = [(r["doc_id"], bytes(r["ids"])) for r in token_files.read_tokens(spark.createDataFrame(files)).orderBy("start").collect()]
    found = []
    for f in files:
        with store.Reader(f["path"]) as r:
            plain = list(token_codec.read_file(r))
            data = r.read(0, r.size)
        assert len(plain) == f["n_docs"] and sum(len(ids) // 4 for _, ids in plain) == f["n_tokens"] and len(data) == f["n_bytes"]
        assert data == b"".join(token_codec.file_chunks(iter(plain), pa.int64(), {}))
        found += plain
    assert back == found and len(found) == table.count()


def test_pieces_of_groups(monkeypatch):
    """What goes to the JVM in pieces of some blocks is the whole group, and so is what comes back from a file."""
    import zlib

    import pyarrow as pa

    monkeypatch.setattr(token_files, "PIECE", 2)
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 9999, n))) for n in (20_000, 1, 9000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": texts})
    *pieces, last = [r for b in token_files._groups(iter([batch]), tokenize.default_tokenizer(), 2) for r in b.to_pylist()]
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4")[np.frombuffer(r["places"], "<u2")] for r in pieces]).tobytes()
    own = [e + np.array([2], "<u4").tobytes() for e in tokenize.encoder(tokenize.default_tokenizer()).encode(texts)]
    assert ids == b"".join(own) and len(pieces) > 3 and [r["stored"] is None for r in pieces] == [False] + [True] * (len(pieces) - 1)
    assert list(token_codec.documents_of(last["docs"], iter([ids[:999], ids[999:]]))) == list(zip([1, 2, 3], own, strict=True))
    chunks = list(token_codec.file_chunks(iter(zip([1, 2, 3], own, strict=True)), pa.int64(), {}))
    stored, parts = token_codec.split_group(b"".join(chunks[1:-1]), len(chunks) - 3, 2)
    assert chunks[1] == token_codec.framed(len(np.unique(np.frombuffer(ids, "<u4"))), stored, zlib.crc32(stored)) == pieces[0]["stored"]
    assert b"".join(parts) == b"".join(chunks[2:-1]) and len(parts) == len(pieces)
