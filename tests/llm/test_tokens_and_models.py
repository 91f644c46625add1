"""BPE, token counts, language ID, URL filters, top-k and sharding."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, shards, tokens, topk, urlfilter

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello  world", "it's they'll 'll '", "a\n\n  b \t c", "x<|endoftext|>y", "<|endo", "naïve café 中文字 🙂", "tab\u00a0nbsp\u2003em", "ends with space ", "word " * 5000, "z" * 3000, "12345 6 78", "\x1c\x1f\x85", "don't<|endoftext|> stop"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    alphabet = "abcdeABC'slltre0123\n\t  .,!?éèñ中🙂\u00a0thion "
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)


def test_encode_decode(spark, docs, texts, library):
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids = tokens.encode_texts(docs, tokens.default_path())
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == dict(enumerate(want))
    back = {r.doc_id: r.text for r in tokens.decode_ids(ids, tokens.default_path()).collect()}
    assert back == {i: library.decode(w, skip_special_tokens=False) for i, w in enumerate(want)}
    assert {r.doc_id: r.n_tokens for r in tokens.round_trip(docs, tokens.default_path()).collect()} == {i: len(w) for i, w in enumerate(want)}


def test_decode_of_broken_bytes(spark, library):
    rows = spark.createDataFrame([(1, [171, 253, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in tokens.decode_ids(rows, tokens.default_path()).collect()}
    assert got == {1: library.decode([171, 253, 50256], skip_special_tokens=False), 2: None, 3: ""}


def test_counts_of_every_prefix(spark, docs, texts, library):
    short = [(i, t) for i, t in enumerate(texts) if len(t or "") < 90]
    got = tokens.count_tokens(docs, tokens.default_path(), budgets=[3], prefixes=True).collect()
    own = {r.doc_id: r for r in got}
    for i, t in short:
        counts = [len(library.encode((t or "")[:k], add_special_tokens=False).ids) for k in range(len(t or "") + 1)]
        assert list(own[i].prefix_tokens) == counts
        assert own[i].n_tokens == counts[-1] and own[i].cut[0] == max(k for k, c in enumerate(counts) if c <= 3)
        assert own[i].n_bytes == len((t or "").encode())


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)) * np.array([8] + [1] * 15)
    x[50:90] = x[50]  # ties
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [None] + [0.0] * 15), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, [1.0]), (None, [1.0] * 16)]
    again = [(0, x[0].tolist())]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows + bad + again], "id long, vec array<double>, score string").repartition(3)
    monkeypatch.setattr(topk, "CANDIDATES", 250)
    monkeypatch.setattr(topk, "QUERIES", 13)
    got = topk.exact_top_k(topk.whole_vectors(df, "id", "vec"), F.col("id") % 20 == 0).collect()
    v = np.floor(64 * x).astype(np.int64)
    want = []
    for q in range(0, 700, 20):
        s = v @ v[q]
        want += [(q, r + 1, int(j), int(s[j])) for r, j in enumerate([j for j in np.lexsort((np.arange(700), -s)) if j != q][:20])]
    assert sorted(map(tuple, got)) == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, vec array<double>")
    assert [tuple(r) for r in topk.exact_top_k(topk.whole_vectors(few, "id", "vec"), F.col("id") == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.exact_top_k(topk.whole_vectors(few.limit(0), "id", "vec"), F.col("id") == 0).count() == 0


def test_prefixes_of_long_white_space(library):
    """White space of all kinds and lengths, up to a run of 40,000: one table for each run."""
    from quarry.llm.bpe import Counter

    rng, count = random.Random(9), Counter(tokens.codec(tokens.default_path()))
    texts = ["".join(rng.choice(" \n\t\u00a0\u3000ab'") for _ in range(60)) for _ in range(60)] + ["a" + " " * 40, "\n" * 30 + "x  ", " \n \n  b"]
    for t in texts:
        assert count.prefix_table(t) == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    long = "x" + " \n" * 20_000
    table = count.prefix_table(long)
    assert table[-1] == len(library.encode(long, add_special_tokens=False).ids)


def brute_top(q, x, k, own=-1):
    s = x @ q
    best = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != own][:k]
    return best, s[best].tolist()


@pytest.mark.parametrize("kind", ["even", "decaying", "ties", "zeros"])
def test_threshold_algorithm(kind):
    """64 dimensions, blocks of thousands: every result comes from the lists, and equals the plain product."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    if kind == "decaying":  # a few dimensions carry most of the length
        x *= 0.6 ** np.arange(64)
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    if kind == "ties":
        x[500:900] = x[3]
    if kind == "zeros":
        x[:, 5:] = 0
        x[40] = 0
    ids, some, read = np.arange(3000), np.arange(0, 3000, 37), []
    if kind == "zeros":
        some = np.append(some, 40)
    for q, got, scores in topk.block_top_k(some, x[some], ids, x, 20, read):
        assert (got.tolist(), scores.tolist()) == (lambda w: (list(w[0]), w[1]))(brute_top(x[q], x, 20, q))
    assert len(read) == len(some) and max(read) <= 3000 * 64
    if kind == "decaying":
        assert np.median(read) < 0.5 * 3000 * 64


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    x = np.zeros((5000, 4), np.int64)
    x[:, 0] = rng.permutation(5000)
    read: list[int] = []
    got = list(topk.block_top_k(np.array([-1]), np.array([[3, 0, 0, 0]]), np.arange(5000), x, 5, read))
    assert got[0][2].tolist() == [3 * k for k in range(4999, 4994, -1)] and read == [topk.STEP]


def test_top_k_of_other_lengths_and_huge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0]), (20, [6.0]), (40, [1e17, 1.0, 1.0])]
    df = spark.createDataFrame(rows[:4], "id long, vec array<double>")
    got = topk.exact_top_k(topk.whole_vectors(df, "id", "vec"), F.col("id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 64 * 64 * 11), (20, 1, 2, 64 * 64 * 30)]
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(topk.whole_vectors(spark.createDataFrame(rows[4:], "id long, vec array<double>"), "id", "vec"), F.col("id") == 40).collect()


def brute_host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:n], rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:m]


def test_url_rules(spark):
    rules = [urlfilter.rule("block", "com/en/"), urlfilter.rule("allow", "example.com/en/7"), urlfilter.rule("allow", "net/de/"), urlfilter.rule("block", "example.net/de/8"), urlfilter.rule("block", "org/es/")]
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/71?x", "http://example.com/en/6", "http://notexample.com/en/7", "x://com/en/", "x://com", "http://b.example.net/de/80#f", "http://b.net/de/7", "http://É.org/es/", "http://a.org?/es/", "a://b://c.com/en/", "http://xcom/en/", "http://a.com/EN/"] * 2
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urlfilter.judge(rows, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = brute_host_path(r.url)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.text if best else None)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")
    assert urlfilter.judge(rows.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(rows, []).collect()} == {"allow"}


def test_url_trees_learn(spark):
    """Labels by digits and depth are learned: held-out accuracy above 0.95."""
    rng = random.Random(6)

    def url(bad):
        parts = ["".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(9)) for _ in range(4 if bad else rng.choice([1, 2, 4]))]
        return f"http://h{rng.randrange(50)}.{rng.choice(['com', 'net'])}/" + "/".join(parts)

    rows = [(i, url(i % 2), i % 2) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, url string, label int")
    host, path = urlfilter.split_url(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    model = urlfilter.fit(df.where("id < 1200"))
    out = urlfilter.judge(df.where("id >= 1200"), [], model=model)
    assert out.where((F.col("verdict") == "block") == (F.col("label") == 1)).count() >= 0.95 * 400
    plan = urlfilter.judge(df, [], model=model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_features(url, host, path):
    url = url or ""
    n = max(len(url), 1)
    query = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
    parts = path.split("/")
    entropy = -sum(c / n * math.log2(c / n) for c in (url.count(x) for x in set(url)))
    return [
        len(url), sum(p != "" for p in parts), sum(c in "0123456789" for c in url) / n, entropy, query.count("&") + 1 if query else 0,
        host.count("."), len(parts[1]) if len(parts) > 1 else 0, len(parts[-1]), sum(c in "-_" for c in url),
    ]


def test_verdicts_against_plain_python(spark):
    """The registered query's verdicts over all pages, from the fitted trees by plain Python."""
    from quarry.llm import catalog

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages = pages.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "http://x.zz/" + "a1-" * 40_000 + "?q=1&r=2#f")], "page_id long, url string"))
    host, path = urlfilter.split_url(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", urlfilter.first_rule(catalog.RULES, F.col("host"), F.col("path")))
    kind = {r.text: r.verdict for r in catalog.RULES}
    blocked = F.col("rule").isin([t for t, v in kind.items() if v == "block"]).cast("int")
    model = urlfilter.fit(rows.where("rule IS NOT NULL").select("url", "host", "path", blocked.alias("label")))
    assert model.trees

    def leaf(tree, bins):
        while not isinstance(tree, float):
            feature, cut, left, right = tree
            tree = left if bins[feature] <= cut else right
        return tree

    got = {r.page_id: r for r in urlfilter.judge(pages, catalog.RULES, model=model).collect()}
    for r in got.values():
        h, p = brute_host_path(r.url)
        values = [*plain_features(r.url, h, p), model.suffix.get(h.rsplit(".", 1)[-1], model.base)]
        bins = [sum(v > e for e in edges) for v, edges in zip(values, model.edges, strict=True)]
        margin = model.base + sum(leaf(t, bins) for t in model.trees)
        assert r.verdict == (kind[r.rule] if r.rule else "block" if margin > 0 else "allow"), r
    assert {r.verdict for r in got.values() if not r.rule} == {"allow", "block"} or len(got) < 50


def test_url_sample_is_bounded_when_one_url_is_in_half_of_all_rows(spark, monkeypatch):
    rows = [("http://a.com/en/same", 1)] * 3000 + [(f"http://h{i}.com/{'en' if i % 3 else 'x1'}/{i}", i % 3 // 1 and 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "url string, label int")
    host, path = urlfilter.split_url(F.col("url"))
    seen = []
    keep = urlfilter.materialize
    monkeypatch.setattr(urlfilter, "materialize", lambda d, tag: seen.append(keep(d, tag)) or seen[-1])
    model = urlfilter.fit(df.withColumns({"host": host, "path": path}), train_rows=500)
    assert 300 < seen[0].count() < 700 and model.trees


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.model_for(spark, docs)
    assert model[0] == sorted(model[0]) and len(model[0]) == 4
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_language_mixture_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.model_for(spark, docs)
    one = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).where("lang in ('en', 'de')").collect()}
    half = min(len(t) for t in one.values())
    mixed = one["en"][:half] + "\n" + one["de"][:half]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, mixed), (5, "é"), (6, "a"), (7, one["en"] * 30), (None, one["de"])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(i, t, "zz") for i, t in rows], "doc_id long, text string, lang string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert {x.lang for x in got[4].languages} == {"en", "de"} and all(0.3 < x.share < 0.7 for x in got[4].languages)
    assert got[7].lang_pred == "en" and got[None].lang_pred == "de" and got[5].lang_pred in model[0]
    nothing = langid.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")))
    assert {r.doc_id for r in kept.collect()} >= {4, 7, None} and not {r.doc_id for r in kept.collect()} & {1, 2, 3}


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([0, 5, 100, 900])) for i in range(3000)] + [(5000 + i, "hot text of a third of all") for i in range(1500)] + [(9000, None), (None, "n"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int").repartition(5)
    got = shards.shard_documents(df).collect()
    assert len(got) == len(rows)
    sums, slots = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sums) == set(range(16)) and max(sums.values()) - min(sums.values()) <= 2 * 901
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(sums.values()) == sum(len((t or "").encode()) + 1 for _, t in rows)
    again = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in shards.shard_documents(df.repartition(2)).collect()}
    assert again == {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got}  # however the table is dealt out
    assert shards.shard_documents(df.limit(0)).count() == 0
    tiny = shards.shard_documents(df.where("doc_id = 9000")).collect()
    assert [(r.size, r.slot, r.text_crc32) for r in tiny] == [(1, 0, 0)]


def test_shards_of_rows_that_tie(spark):
    """1,600 rows without an id and with one text: they are spread like any others."""
    df = spark.createDataFrame([(None, "the same text")] * 1600 + [(i, f"text {i}") for i in range(160)], "doc_id long, text string").repartition(3)
    got = shards.shard_documents(df).collect()
    sums, slots = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 1760 and len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 2 * 15
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_columns_against_plain_python(spark):
    import zlib

    rows = [(1, "é x"), (2, None), (None, ""), (3, "z" * 100_000), (3, "z" * 100_000)]
    got = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)


def test_splitters_that_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(shards, "MAX_ROUNDS", 1)
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    with pytest.raises(RuntimeError, match="settle"):
        shards.shard_documents(df)


def test_write_shards_keeps_every_row(spark, tmp_path):
    rows = [(None, "a", 1), (None, None, 2), (5, "b", 3), (5, "b", 3), (6, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tie int")
    shards.write_shards(df, str(tmp_path / "s"), n_shards=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(((r.doc_id, r.text, r.tie) for r in back.collect()), key=repr) == sorted(rows, key=repr)
    assert back.columns == ["doc_id", "text", "tie", "slot", "shard"]


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 7} " * 20) for i in range(400)], "doc_id long, text string")
    shards.write_shards(df, str(tmp_path / "s"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 400 and back.select("shard").distinct().count() == 4


def test_ids_of_any_type_and_empty_tables(spark):
    model = langid.fit(spark.createDataFrame([("en", "the cat and the dog"), ("de", "der Hund und die Katze")], "lang string, text string"))
    path = tokens.default_path()
    for fields, i in (("doc_id string, text string", "a-1"), ("doc_id int, text string", 7), ("doc_id decimal(20,0), text string", None)):
        df = spark.createDataFrame([(i, "the dog"), (None, None), (i, "the dog")], fields)
        kind = df.schema["doc_id"].dataType
        for out in (tokens.count_tokens(df, path), tokens.round_trip(df, path), tokens.encode_texts(df, path), tokens.decode_ids(tokens.encode_texts(df, path), path), langid.identify(df, model)):
            assert out.schema["doc_id"].dataType == kind
            assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([i, i, None], key=repr)
        assert tokens.count_tokens(df.limit(0), path).count() == tokens.round_trip(df.limit(0), path).count() == langid.identify(df.limit(0), model).count() == 0


def test_queries_on_token_counts(spark, library):
    """over_limit and decoded_sha256 of the registered queries against the library, over the whole table."""
    import hashlib

    from quarry.llm import catalog

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in catalog.op5_token_counts(spark, SF).collect()} == {i: (len(docs[i].encode()), len(w), len(w) > 1024) for i, w in want.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.op7_bpe_round_trip(spark, SF).collect()}
    assert got == {i: (len(w), sha(np.array(w, "<u4").tobytes()), sha(library.decode(w, skip_special_tokens=False).encode())) for i, w in want.items()}


def test_text_in_twelve_languages(spark):
    """Twelve made-up languages in equal parts: all twelve are found, and labels past the model's limit leave the most counted ones."""
    rng = random.Random(21)
    tongues = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for _ in range(12)]
    speak = lambda i, n: " ".join(rng.choice(tongues[i]) for _ in range(n))
    rows = [(f"l{i:02}", speak(i, 400)) for i in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    mixed = " ".join(speak(i, 300) for i in range(12))
    got = langid.identify(spark.createDataFrame([(1, mixed), (2, speak(3, 50))], "doc_id long, text string"), model).collect()
    assert sorted(x.lang for x in got[0].languages) == [f"l{i:02}" for i in range(12)]
    assert [x.lang for x in got[1].languages] == ["l03"]


def test_more_labels_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    model = langid.fit(spark.createDataFrame([("x", "some words here"), ("y", "a"), ("z", "more words over there")], "lang string, text string"))
    assert model[0] == ["x", "z"]


def test_mixture_against_plain_em():
    """Settled shares and likelihood against ten thousand plain rounds."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        k, n = int(rng.integers(2, 6)), int(rng.integers(3, 40))
        logs = np.log(rng.dirichlet(np.ones(50), k).T[:n])
        counts = rng.integers(1, 9, n).astype(float)
        share = np.full(k, 1 / k)
        for _ in range(10_000):
            share = share * ((counts / (np.exp(logs) @ share)) @ np.exp(logs)) / counts.sum()
        got, value = langid.mixture(logs, counts)
        best = float((counts * np.log(np.exp(logs) @ share)).sum())
        assert best - langid.SETTLED - 1e-9 <= value <= best + 1e-9 and math.isclose(got.sum(), 1)


def test_shares_sum_to_one():
    logs = np.log(np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]]))
    share, value = langid.mixture(logs, np.array([7.0, 2.0, 1.0]))
    assert math.isclose(share.sum(), 1) and share[0] > 0.9 and value < 0
