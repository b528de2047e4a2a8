"""Ops 2, 6 and 7: held-out accuracy on the test tables, and defined results at the edges."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality, ranking, toxicity
from tessera.llm import queries as q
from tessera.llm.runtime import fold

SF = "/root/testdata/sf0.1"


def held_out(spark, df, label):
    y = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return df.filter("held_out").join(y, "doc_id").toPandas()


def test_quality(spark):
    got = held_out(spark, q.op2_quality(spark, SF), "quality")
    assert (got["predicted"] == got["y"]).mean() > 0.98
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_toxicity(spark):
    got = held_out(spark, q.op7_toxicity(spark, SF), "toxic")
    hit = got[got["y"] == 1]["predicted"].mean()
    false = got[got["y"] == 0]["predicted"].mean()
    assert hit > 0.85 and false < 0.06
    assert got["score"].between(0, 1).all()


def test_language(spark):
    df = q.op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert df.filter("lang = lang_pred").count() / df.count() > 0.99


TEXTS = [None, "", " \n\t", "One word", "THE the The the cat 12 12 12!!", "a b c a b c a b c\nsame\nsame\n\nother, (end).", "Ünï 漢字 <b> $$$ ~~~", "x" * 5000, "\n".join(f"line {i % 7} of many" for i in range(300))]


def plain_statistics(text):
    """The statistics by plain Python."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    k = len(words)
    if not k:
        return [0.0] * len(quality.STATISTICS)
    upper, digits = sum(65 <= b < 91 for b in raw), sum(48 <= b < 58 for b in raw)
    letters = upper + sum(97 <= b < 123 or b >= 128 for b in raw)
    symbols = [b for b in raw if 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()"]
    lines = [x for x in raw.split(b"\n") if x]
    lower = sum(not any(65 <= b < 91 for b in w) and any(97 <= b < 123 or b >= 128 for b in w) for w in words)
    distinct = len(set(words))
    return [
        math.log1p(k), math.log(len(raw) / k), upper / max(1, letters), digits / len(raw), len(symbols) / k, max((symbols.count(s) for s in set(symbols)), default=0) / k,
        sum(chr(b) in ".,;:'\"-()" for b in raw) / k, distinct / k, math.log(distinct) / math.log1p(k), sum(a == b for a, b in zip(words, words[1:])) / k,
        len(set(zip(words, words[1:], words[2:]))) / (k - 2) if k > 2 else 1.0, len(lines) / k, len(set(lines)) / max(1, len(lines)), letters / len(raw), lower / k,
    ]


def test_quality_features_are_the_plain_ones(monkeypatch):
    for rows in (1024, 2):
        monkeypatch.setattr(quality, "ROWS", rows)
        got = quality.features(pa.array(TEXTS, pa.string()))
        assert np.allclose(got[:, : len(quality.STATISTICS)], [plain_statistics(t) for t in TEXTS])
        # a word's bucket depends on the word, and their squares sum up to one
        assert np.allclose((got[3:, len(quality.STATISTICS) :] ** 2).sum(1), 1)


def test_quality_scores_are_the_plain_ones(spark, docs):
    table = docs(*TEXTS)
    labels = spark.createDataFrame([(d, d % 2) for d in range(3, 9)], "doc_id long, quality int")
    ranker = quality.fit(table, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.score(table, ranker).collect()}
    for d, t in enumerate(TEXTS):
        x = quality.features(pa.array([t], pa.string()))[0]
        z = np.clip((x - ranker.mean) / ranker.scale, -6, 6)
        s = z[: len(quality.STATISTICS)]
        raw = sum(w * v for w, v in zip(ranker.weights, [*z, *(s * s / 4), *np.tanh(2 * s)], strict=True))
        at = (raw - ranker.cut) / ranker.spread + math.log(0.3 / 0.7)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, at)))))


def test_toxicity_scores_are_the_plain_ones(spark, docs):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" hateful slurs here" if d < 25 else "") for d in range(120)]
    labels = spark.createDataFrame([(d, int(d < 25)) for d in range(0, 120)], "doc_id long, toxic int")
    model = toxicity.fit(docs(*texts), labels, F.lit(True))
    assert len(model.index)
    weights = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))

    def plain(text):
        found = set()
        for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""):
            raw = np.frombuffer(w.encode(), np.uint8)
            found.update(toxicity.feature_hashes(raw, np.array([0, len(raw)]))[0].astype(np.int64).tolist())
        return 1 / (1 + math.exp(-max(-40, min(40, model.bias + sum(weights.get(h, 0.0) for h in found)))))

    more = [*texts, *TEXTS, "HATEFUL, slurs; here!"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(*more), model).collect()}
    assert all(got[d] == pytest.approx(plain(t)) for d, t in enumerate(more))


def test_predictions_are_the_plain_forward_pass():
    rng = np.random.default_rng(4)
    f = 5
    net = langid.Network(["a", "b", "c"], 16, [rng.normal(size=(w, langid.CLASSES, f)).astype(np.float32) for w in langid.WIDTHS], [rng.normal(size=f).astype(np.float32) for _ in langid.WIDTHS], rng.normal(size=(f * 3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    texts = [t.encode() for t in ("short", "x" * 16, "A longer text, of several windows: 漢字 and ünï.", "")]

    def window(x):
        h = []
        for w, table, bias in zip(langid.WIDTHS, net.tables, net.biases, strict=True):
            best = [max(sum(table[j][x[i + j]][k] for j in range(w)) for i in range(len(x) - w + 1)) + bias[k] for k in range(f)]
            h += [max(0.0, b) for b in best]
        z = np.array([sum(h[i] * net.out[i][k] for i in range(len(h))) + net.out_bias[k] for k in range(3)], float)
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    want = []
    for t in texts:
        x = langid.windows_of(np.frombuffer(t, np.uint8), 16)
        weight = [1.0] * (len(x) - 1) + [max(1, len(t) - (len(x) - 1) * 16) / 16]
        mean = sum(window(w) * v for w, v in zip(x, weight, strict=True)) / sum(weight)
        p = np.exp(mean - mean.max())
        want.append(p / p.sum())
    data = np.frombuffer(b"".join(texts), np.uint8)
    which, score = langid.Predictor(net).documents(data, np.cumsum([0, *map(len, texts)]))
    assert which.tolist() == [int(np.argmax(p)) for p in want]
    assert np.allclose(score, [p.max() for p in want], atol=1e-4)


def test_pairs_rank_better_above_worse():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 1, (300, len(quality.FEATURES))), rng.normal(-1, 1, (100, len(quality.FEATURES)))])
    good = np.arange(400) < 300
    model = quality.fit_pairs(x, good, quality.Fit())
    s = model.score(x)
    assert s[good].min() > s[~good].mean()
    assert abs((s < quality.CUT).mean() - 0.25) < 0.01  # the quantile cut


def test_quality_learns_from_every_labelled_row(spark):
    rng = random.Random(5)
    words = [f"{'Abc'[i % 3]}w{i}" for i in range(50)]
    n = 24_000
    rows = []
    for d in range(n):
        good = rng.random() < 0.8
        rows.append((d, " ".join(rng.choice(words[: 40 if good else 50]) for _ in range(rng.randint(3, 12))), int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    got = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"), F.lit(True))
    x = quality.features(pa.array([t for _, t, _ in rows], pa.string()))
    good = np.array([g == 1 for *_, g in rows])
    assert got.share_good == good.mean()
    assert np.allclose(got.mean, x.mean(0), rtol=1e-9) and np.allclose(got.scale, np.maximum(x.std(0), 1e-6), rtol=1e-7)
    # the same as in the driver, and the cut is the quantile of all rows
    want = quality.fit_pairs(x, good, quality.Fit())
    assert np.allclose(got.weights, want.weights, atol=1e-3)
    assert got.cut == pytest.approx(want.cut, abs=1e-3)
    assert (got.raw(x) < got.cut).sum() == (~good).sum()


def test_ranking_is_the_optimum_over_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4))
    marked = rng.random(200) < 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1]))
    # rows may be marked several times, also as both
    good, bad = marked + (rng.random(200) < 0.1) * 2.0, (~marked) * 1.0
    shrink = np.full(4, 1e-3)
    packed = ranking.pack(spark.createDataFrame([(r.tolist(), int(g), int(b)) for r, g, b in zip(x, good, bad, strict=True)], "features array<double>, good long, bad long").repartition(3))
    packed.persist()
    for rows in ([(x[:70], good[:70], bad[:70]), (x[70:], good[70:], bad[70:])], packed):
        w = ranking.learn(rows, lambda v: v, shrink, 50, 1e-7)
        s = x @ w
        p = good[:, None] * bad / (1 + np.exp(s[:, None] - s)) / good.sum() / bad.sum()
        assert np.abs(p.sum(0) @ x - p.sum(1) @ x + shrink * w).max() < 1e-5
        assert ranking.loss(ranking._by_score(rows, lambda v: v, w)) == pytest.approx((good[:, None] * bad * np.logaddexp(0, s - s[:, None])).sum() / good.sum() / bad.sum(), abs=1e-5)
        ranks = [0, 56, 57, 150, int((good + bad).sum()) - 1]
        assert ranking.order_statistics(rows, lambda v: v[:, 0], ranks) == np.sort(np.repeat(x[:, 0], (good + bad).astype(int)))[ranks].tolist()
    packed.unpersist()


def test_non_negative_risk_learns_from_positives_and_the_rest():
    rng = np.random.default_rng(1)
    noise = lambda: rng.choice(np.arange(100, 3000), 40, replace=False)
    toxic = [np.unique(np.append(noise(), rng.choice(20, 6))) for _ in range(200)]
    rest = [noise() if i % 10 else np.unique(np.append(noise(), rng.choice(20, 6))) for i in range(1000)]
    model = toxicity.fit_nnpu(toxic, rest, 0.1, toxicity.Fit())
    assert set(model.index.tolist()) >= set(range(20))
    assert (model.weights[model.index < 20] > 0).all()


def test_toxic_words_of_long_texts_are_learned_whatever_their_hash(spark, docs):
    def high(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(toxicity.feature_hashes(raw, np.array([0, len(raw)]))[0].min())

    # every feature of this word comes behind the first 2,500 of a long text
    bad = max((f"bad{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"), key=high)
    filler = " ".join(f"n{i}x" for i in range(4000))
    table = docs(*[f"{filler} {bad}" if d < 30 else filler for d in range(120)])
    labels = spark.createDataFrame([(d, int(d < 30)) for d in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels, F.lit(True))
    raw = np.frombuffer(bad.encode(), np.uint8)
    assert set(model.index.tolist()) >= set(toxicity.feature_hashes(raw, np.array([0, len(raw)]))[0].astype(np.int64).tolist())


def test_edges(spark, odd, none, docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    everyone = F.lit(True)
    for table in (odd, none):
        n = table.count()
        ranker = quality.fit(table, labels, everyone)
        assert quality.score(table, ranker).filter("score between 0 and 1").count() == n
        assert quality.keep_good(table, ranker).columns == table.columns
        model = toxicity.fit(table, labels, everyone)
        assert toxicity.score(table, model).filter("score between 0 and 1").count() == n
        net = langid.fit(table, everyone)
        got = langid.predict(table, net).collect()
        assert len(got) == n
    und = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, langid.fit(odd, everyone)).filter("doc_id < 3").collect()}
    assert und == {0: "und", 1: "und", 2: "und"}
    assert langid.fit(none, everyone) is None


def test_without_labels_of_both_kinds(docs, spark):
    table = docs("a b c", "d e f")
    ones = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(table, quality.fit(table, ones, F.lit(True))).collect()} == {1.0}
    none_toxic = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.score(table, toxicity.fit(table, none_toxic, F.lit(True))).collect())


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    may = fold("doc_id", 5) != 0
    flipped = labels.withColumn("quality", F.when(may, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = quality.fit(docs, labels, may), quality.fit(docs, flipped, may)
    assert a.cut == pytest.approx(b.cut) and np.allclose(a.weights, b.weights)
