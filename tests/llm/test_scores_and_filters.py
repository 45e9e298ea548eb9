"""Language-model and toxicity scores, quality rules, URL filters and the pipeline."""

import math
import zlib
from collections import Counter
from datetime import date

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference, oracle_rows, spark_rows
from odd_tables import ROWS, odd_documents
from pyspark.sql import functions as F

from tablewright.llm import context_mixing, quality_rules, toxicity, url_filters
from tablewright.llm.common import parts_of
from tablewright.llm.registry import ORACLES, QUERIES, table


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, key):
    assert difference(spark_rows(QUERIES[key](spark, sf)), oracle_rows(connect(sf), ORACLES[key])) is None


# -- language-model scores --------------------------------------------------------------------


def words(text):
    return (text or "").encode().lower().split()


def baseline(documents):
    train = [t for d, t in documents if d is None or remainder(d, 7) != 2]
    counts = Counter(w for t in train for w in words(t))
    total, distinct = sum(counts.values()) + len(train), len(counts) + bool(train)
    out = []
    for d, t in documents:
        c = [counts[w] for w in words(t)] + [len(train)]
        score = sum(math.log10((x + 1) / (total + distinct + 1)) for x in c)
        out.append((d, d is not None and remainder(d, 7) == 2, len(c), sum(x > 0 for x in c), total, score))
    return out


def check_scores(got, documents):
    mine = sorted((tuple(r)[:6] for r in got), key=repr)
    wanted = sorted(baseline(documents), key=repr)
    assert [x[:5] for x in sorted(mine, key=lambda x: repr(x[:5]))] == [x[:5] for x in sorted(wanted, key=lambda x: repr(x[:5]))]
    assert np.allclose(sorted(x[5] for x in mine), sorted(x[5] for x in wanted))


def test_mixing_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = QUERIES["op1_context_mixing"](spark, sf).collect()
    check_scores([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got], docs)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got if r["n_tokens"] > 1)


def test_mixing_beats_the_baseline_on_unseen_texts(spark):
    """The baseline gives every unknown word the same share of nothing, so it takes some text to beat it."""
    row = QUERIES["op1_context_mixing"](spark, "/root/testdata/sf0.1").where("held_out").agg(
        F.sum("score").alias("own"), F.sum("base_score").alias("base")).first()
    assert row["own"] > row["base"]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_scores_of_odd_documents(spark, odd, none, monkeypatch, hot):
    monkeypatch.setattr(context_mixing, "HOT_SHARE", hot)  # with 3, nearly all words take the join
    got = context_mixing.score(odd).collect()
    check_scores([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got],
                 [(r[0], r[1]) for r in ROWS])
    if hot == 3:
        assert context_mixing.score(none).count() == 0


def small_mixer(texts):
    pairs = np.zeros(1 << 16, np.int64)
    for t in texts:
        data = np.frombuffer(b"\0" + context_mixing.stream(t), np.uint8)
        np.add.at(pairs, data[:-1].astype(np.int64) << 8 | data[1:], 1)
    code = context_mixing.Code(pairs.reshape(256, 256))
    rng = np.random.default_rng(0)
    return context_mixing.Mixer(code, [rng.integers(-60, 60, 1 << w).astype(np.int8) for w in context_mixing.TABLE_BITS])


def test_byte_probabilities_sum_to_one():
    mixer = small_mixer(["the cat sat", "on the mat"])
    # streams of one byte: their probabilities under the model are those of the first byte
    scores = mixer.scores([bytes((b,)) for b in range(256)])
    assert abs((10 ** scores).sum() - 1) < 1e-5


def test_scores_do_not_depend_on_the_neighbours(monkeypatch):
    texts = ["the cat sat on the mat " * n for n in (1, 40, 400)] + ["", "x"]
    mixer = small_mixer(texts)
    alone = [mixer.scores([context_mixing.stream(t)])[0] for t in texts]
    together = mixer.scores([context_mixing.stream(t) for t in texts])
    assert np.allclose(alone, together, rtol=1e-6)


def test_long_texts_are_refined_to_their_end_in_bounded_slices(monkeypatch):
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"], 60_000))
    mixer = small_mixer([text[:2_000]])
    whole = mixer.scores([context_mixing.stream(text), b"x\x00"])
    seen, block = [], context_mixing.Mixer._block

    def noted(self, doc, *rest):
        seen.append((len(doc), rest[-1] is not None))
        block(self, doc, *rest)

    monkeypatch.setattr(context_mixing.Mixer, "_block", noted)
    monkeypatch.setattr(context_mixing, "CHUNK", 5_000)
    assert np.allclose(mixer.scores([context_mixing.stream(text), b"x\x00"]), whole, rtol=1e-5)
    assert max(n for n, _ in seen) == 5_000
    assert sum(n for n, learns in seen if learns) > 131_072


def plainly_mixed(mixer, data):
    """log10 probability of one stream, decision by decision."""
    padded = np.frombuffer(b"\0" * 5 + data, np.uint8)
    contexts = context_mixing._contexts(padded)
    weights, slopes, cost = context_mixing.START.astype(float).copy(), np.zeros((4, 4)), 0.0
    counts = [{} for _ in range(4)]
    for i in range(len(data)):
        if i and i % context_mixing.BLOCK == 0:
            weights -= np.clip(context_mixing.RATE * slopes, -context_mixing.CHANGE, context_mixing.CHANGE)
            slopes[:] = 0
        pair = np.array([int(padded[i + 4]) << 8 | int(padded[i + 5])])
        bits, slots, _ = context_mixing._decisions(mixer.code, pair, [c[i: i + 1] for c in contexts])
        for j, bit in enumerate(bits):
            x = []
            for k in range(4):
                place = int(slots[k][j])
                odds = mixer.odds[k][place] / context_mixing.SCALE
                zeros, ones = counts[k].get(place, (0, 0))
                if zeros + ones:
                    seen = min(2 ** (mixer.sizes[k][place] / context_mixing.STEPS) - 1, context_mixing.TRUST)
                    size, share = seen + 2 * context_mixing.PRIOR, 1 / (1 + np.exp(-odds))
                    odds = np.log((size * share + ones) / (size * (1 - share) + zeros))
                counts[k][place] = zeros + (bit == 0), ones + (bit == 1)
                x.append(odds)
            gate = max((k for k in range(1, 4) if x[k]), default=0)
            logit = weights[gate] @ x
            cost -= np.log1p(np.exp(-logit if bit else logit))
            slopes[gate] += (1 / (1 + np.exp(-logit)) - bit) * np.array(x)
    return cost / np.log(10)


@pytest.mark.parametrize("chunk", [1 << 16, 300])
def test_predictors_and_weights_learn_through_the_text(monkeypatch, chunk):
    monkeypatch.setattr(context_mixing, "CHUNK", chunk)
    texts = ["wherha onthe stin wherha ed " * 30, "the cat sat on the mat", ""]
    plain = small_mixer(texts[1:])
    rng = np.random.default_rng(1)
    sizes = [rng.integers(0, 80, 1 << w).astype(np.int8) for w in context_mixing.TABLE_BITS]
    mixer = context_mixing.Mixer(plain.code, plain.odds, sizes)
    streams = [context_mixing.stream(t) for t in texts]
    assert np.allclose(mixer.scores(streams), [plainly_mixed(mixer, s) for s in streams], rtol=1e-4)
    # what comes again costs less, at its last places too
    half, whole = mixer.scores([streams[0][: len(streams[0]) // 2], streams[0]])
    assert whole - half > 0.5 * half


def test_batches_are_cut_by_bytes():
    column = pa.array(["ab", None, "", "c" * 50, "d", "e" * 9])
    parts = list(parts_of(pa.RecordBatch.from_arrays([column], ["text"]), 10))
    assert [t for p in parts for t in p["text"].to_pylist()] == column.to_pylist()
    assert len(parts) == 3 and all(p.num_rows for p in parts[:-1])
    assert sum(p.num_rows for p in parts_of(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"]), 10)) == 0


def test_code_is_a_prefix_code():
    code = context_mixing.Code(np.random.default_rng(1).integers(0, 50, (256, 256)))
    assert np.allclose((0.5 ** code.size.reshape(256, 256)).sum(1), 1)


# -- toxicity --------------------------------------------------------------------------------------


def test_gradients_match_differences():
    net = toxicity.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, _ = net.embed([b"", b"one", b"two", b"three"])
    gates = net.project(x.astype(float))
    index, slope = np.array([[1, 2, 3], [2, 3, 0], [3, 1, 0], [1, 0, 0]]), np.array([1.0, -0.5, 0.3])
    grads, d_gates = net.gradients(gates, index, slope)

    def loss():
        return float((net.run(gates, index) * slope).sum())

    for name, at in [("h", 1), ("h", 40), ("a", 3), ("v", 2), ("o", 5), ("o0", 0)]:
        param = net.p[name]
        old = param.flat[at]
        param.flat[at] = old + 1e-2
        up = loss()
        param.flat[at] = old - 1e-2
        down = loss()
        param.flat[at] = old
        if name != "h" or toxicity._block().flat[at]:
            assert abs((up - down) / 2e-2 - grads[name].flat[at]) < 2e-3
    for at in (50, 100, 150):
        old = gates.flat[at]
        gates.flat[at] = old + 1e-2
        up = loss()
        gates.flat[at] = old - 1e-2
        down = loss()
        gates.flat[at] = old
        assert abs((up - down) / 2e-2 - d_gates.flat[at]) < 2e-3


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 55, 56, 57, 1000):
        starts = toxicity.windows_of(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(starts) >= 1


def test_the_highest_of_all_overlapping_windows_counts():
    net, rng = toxicity.Network.fresh(), np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], n)) for n in (0, 1, 31, 32, 33, 57, 100, 700)]
    got = toxicity.Scorer(net).logits(texts)
    for text, logit in zip(texts, got):
        words = text.encode().split()
        gates = net.project(np.vstack([np.zeros((1, 16), np.float32), *([net.embed(words)[0]] if words else [])]))
        starts = range(max(1, len(words) - 31))
        index = np.array([[s + t + 1 if s + t < len(words) else 0 for s in starts] for t in range(32)])
        assert abs(net.run(gates, index).max() - logit) < 1e-4


def test_training_reads_every_window_of_long_texts(monkeypatch):
    seen = []
    sweep = toxicity.Network.sweep

    def noted(self, gates, numbers, threads=1):
        logits = sweep(self, gates, numbers, threads)
        seen.append(len(logits))
        return logits

    monkeypatch.setattr(toxicity.Network, "sweep", noted)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], 2_000)) for _ in range(4)]
    toxicity.train(texts, np.array([0, 1, 0, 1], np.float32), 0.5, visits=16)
    assert seen and min(seen) >= 4 * (2_000 - 31)


def test_a_learned_word_is_found_anywhere():
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(80)]
    texts, toxic = [], []
    for i in range(400):
        text = list(rng.choice(plain, rng.integers(5, 150)))
        if i % 2:
            text[rng.integers(len(text))] = "vermin!"
        texts.append(" ".join(text))
        toxic.append(i % 2)
    net = toxicity.train(texts, np.array(toxic, np.float32), 0.5)
    scorer = toxicity.Scorer(net)
    long = list(rng.choice(plain, 3_000))
    clean = scorer.scores([" ".join(long), "word1 word2"])
    long[2_345] = "vermin"
    assert (clean < 0.5).all() and (scorer.scores([" ".join(long), "word1 Vermin word2"]) >= 0.5).all()


def test_toxicity_on_unseen_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = QUERIES["op6_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert len(got) > 300 and right > 0.96
    assert all(0 <= r["score"] <= 1 for r in got)


def test_training_reads_a_sample_bounded_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 40 * (i % 7)) for i in range(1, 200)] + [(1, "other"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, toxic int")
    written = []
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df: written.append(df) or df)
    net = toxicity.fit(docs, labels, sample=50, most=3_000, visits=8)
    assert isinstance(net, toxicity.Network) and written[0].count() == 100
    assert all(np.isfinite(v).all() for v in net.p.values())
    # one text of each class trains even if it alone exceeds the bound
    assert isinstance(toxicity.fit(docs, labels, sample=50, most=0, visits=8), toxicity.Network)


def test_toxicity_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 0), (1, 0), (2, 1), (None, 1), (3, None), (6, 0), (7, 1), (77, 1)], "doc_id long, toxic int")
    for docs in (odd, none):
        for given in (labels, labels.where("toxic = 1"), labels.where("false")):
            done = toxicity.keep_civil(docs, given, limit=2.0, visits=8)
            assert done.schema == docs.schema and done.count() == docs.count()
    assert toxicity.fit(odd, labels.where("false")) == 0.0


# -- quality rules ------------------------------------------------------------------------------------


def test_rates_are_compared_uncapped(spark, tmp_path):
    """Words of 20,000 characters are usual in this group; one text has words of 90,000."""
    sizes = [(i, (20_000 if i else 90_000) + i) for i in range(12)]
    spark.createDataFrame([(i, " ".join(["x" * n + str(k) for k in range(60)]), "zh", "a", "g", "l") for i, n in sizes],
                          "doc_id long, text string, lang string, source string, g_lang string, g_source string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.sql("SELECT doc_id, kept FROM (" + ORACLES["op5_quality_rules"] + ") ORDER BY 1").fetchall()
    assert [tuple(r) for r in got.select("doc_id", "kept").orderBy("doc_id").collect()] == wanted
    assert [kept for _, kept in wanted] == [False] + [True] * 11


def test_quality_of_odd_documents(spark, odd, none):
    kept = quality_rules.keep_good(odd)
    assert kept.schema == odd.schema
    assert {r["doc_id"] for r in kept.collect()} <= {6, 7}
    assert quality_rules.keep_good(none).count() == 0
    rows = {r["doc_id"]: r for r in quality_rules.measure(odd.where("doc_id IN (3, 4, 5, 8)")).collect()}
    assert [rows[d]["n_words"] for d in (3, 4, 5)] == [0, 0, 0]
    assert rows[8]["n_symbols"] == 4


def test_a_group_sets_its_own_fence(spark):
    def rows(source, symbols, n, first):
        return [(first + i, " ".join(f"w{i}x{j}" for j in range(60)) + " #" * symbols, "en", source) for i in range(n)]

    docs = rows("plain", 0, 250, 0) + rows("tables", 30, 250, 1_000) + rows("plain", 30, 20, 2_000) + rows("rare", 30, 3, 3_000)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good(frame).collect()}
    assert kept == set(range(250)) | set(range(1_000, 1_250)) | {3_000, 3_001, 3_002}


def test_repeated_words_count_every_window(spark):
    texts = ["a b c a b c", "a b c d", "a a a a a", "x a b c y a b c z", "", "a b"]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measure(frame).collect()}
    assert got == {0: 6, 1: 0, 2: 5, 3: 6, 4: 0, 5: 0}


# -- URL filters ------------------------------------------------------------------------------------------


def test_lists_in_force_on_the_day_of_the_fetch(spark):
    day = lambda n: date(2024, 1, n)
    entries = [("adult", "bad.com", True, day(5)), ("adult", "bad.com", True, day(7)), ("adult", "bad.com", False, day(10)),
               ("malware", "bad.com", True, day(8)), ("adult", "sub.ok.org", True, day(3)), ("adult", "x.net", True, day(4)),
               ("adult", "x.net", False, day(4)), ("adult", None, True, day(1)), ("adult", "y.net", True, None)]
    intervals = url_filters.validity(spark.createDataFrame(entries, "list string, domain string, added boolean, day date"))
    assert {tuple(r) for r in intervals.select("list", "domain", "from", "until").collect()} == {
        ("adult", "bad.com", day(5), day(10)), ("malware", "bad.com", day(8), None), ("adult", "sub.ok.org", day(3), None)}
    captures = [(1, "http://bad.com/", day(4)), (2, "https://u:p@WWW.bad.com:80/x", day(5)), (3, "http://bad.com", day(9)),
                (4, "http://bad.com?q", day(10)), (5, "http://notbad.com/", day(9)), (6, "http://ok.org", day(9)),
                (7, None, day(9)), (8, "nonsense", day(9)), (9, "http://bad.com", None), (9, "http://bad.com", None)]
    frame = spark.createDataFrame([(*c, "x", 1) for c in captures], "page_id long, url string, day date, host2 string, salt int").drop("salt")
    got = sorted((r["page_id"], r["n_lists"], r["kept"]) for r in url_filters.evaluate(frame, intervals).collect())
    assert got == [(1, 0, True), (2, 1, False), (3, 2, False), (4, 1, False), (5, 0, True), (6, 0, True),
                   (7, 0, True), (8, 0, True), (9, 0, True), (9, 0, True)]
    assert url_filters.evaluate(frame.where("false"), intervals).count() == 0
    assert url_filters.evaluate(frame, intervals.where("false")).where("kept").count() == len(captures)


def test_native_operators_run_no_python(spark, sf):
    for key in ("op3_url_filters", "op5_quality_rules"):
        plan = QUERIES[key](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs, counts = table(spark, sf, "documents"), []
    schema = docs.schema
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.schema == schema, name
    assert table(spark, sf, "documents").count() > counts[0] > counts[1] > counts[2] == counts[3] > 0
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == counts[3]


def test_pipeline_stages_on_odd_tables(spark, none, sf):
    import corpus_pipeline

    for docs in (odd_documents(spark), none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, docs, sf)
            assert done.columns == docs.columns, name
            assert done.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
