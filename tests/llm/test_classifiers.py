import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import language, quality, toxicity


def test_isotonic_pools_violators():
    assert quality.isotonic(np.array([1, 3, 2, 4.0]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    assert quality.isotonic(np.array([3, 2, 1.0]), np.array([1, 1, 2.0])).tolist() == [1.75] * 3
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 5))
    waves, phases = rng.standard_normal((5, 40_000)) / 2.0, rng.uniform(0, 2 * np.pi, 40_000)
    z = quality.lifted(x, waves, phases)[:, :-1]
    want = np.exp(-((x[:, None] - x) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - want).max() < 0.03


def test_quality_fit_equals_plain_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    part = rng.integers(0, quality.FOLDS, 500)
    rows = [(x[k].tolist(), float(y[k]), int(part[k])) for k in range(500)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, y double, part int").repartition(7), features=24)
    z = quality.lifted((x - x.mean(0)) / x.std(0), model.waves, model.phases)

    def ridge(rows):
        return np.linalg.solve(z[rows].T @ z[rows] + quality.RIDGE * np.eye(25), z[rows].T @ y[rows])

    assert np.allclose(model.weights, ridge(np.ones(500, bool)), atol=1e-8)
    raw = np.zeros(500)
    for p in range(quality.FOLDS):
        raw[part == p] = z[part == p] @ ridge(part != p)
    at = np.clip((raw + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(at)
    n = np.array([(at == b).sum() for b in bins])
    rate = np.array([y[at == b].mean() for b in bins])
    # the isotonic value is the largest of the least means of what begins before and ends after it
    total, ones = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * rate)]
    for k in range(len(bins)):
        ends = range(k + 1, len(bins) + 1)
        want = max(min((ones[e] - ones[s]) / (total[e] - total[s]) for e in ends) for s in range(k + 1))
        assert model.values[k] == pytest.approx(want, abs=1e-9)
    assert np.allclose(model.cuts, [raw[at == b].mean() for b in bins])


def test_quality_on_held_out(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_quality_of_odd_rows(spark, odd, labels):
    got = quality.quality_scores(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    unlabelled = quality.quality_scores(odd, labels.limit(0))
    assert {r.score for r in unlabelled.collect()} == {0.5}
    assert quality.quality_scores(odd.limit(0), labels).count() == 0


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def test_grams_count_whole_texts():
    a = language.grams("x" * language.CHUNK + " abc")
    assert set(language.grams(" abc")) <= set(a)
    assert language.grams("ab").tolist() == language.grams("AB!").tolist()
    assert len(language.grams("123 !?")) == 0 and len(language.grams(None)) == 0
    same = language.grams("Ünïcode ж 漢字")
    assert len(same) and language.has_letter("漢") and not language.has_letter("١٢")


@pytest.mark.parametrize("text", ["ab      cd ", "  x", "İi ßẞ  a1b", "a" * 40, "1 2 3 \n ж漢 字   q", "...", "é" + " " * 30])
def test_grams_of_chunks_are_those_of_the_whole(monkeypatch, text):
    whole = language.grams(text)
    for chunk in (1, 2, 3, 5, 7):
        monkeypatch.setattr(language, "CHUNK", chunk)
        assert language.grams(text).tolist() == whole.tolist()


def test_more_languages_than_landmarks_are_all_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANDMARKS", 20)
    letters = [chr(0x430 + k) for k in range(30)]
    rows = [(k * 10 + j, f"{a}{a}{a} {a * (j + 2)}", f"l{k}") for k, a in enumerate(letters) for j in range(4)]
    rows += [(9000 + j, "und und", "und") for j in range(3)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    got = language.sample(docs)
    assert len(got) == len(rows)  # identical rows count once
    model = language.fit(got)
    assert len(model.languages) == 31
    assert [model.languages[k] for k in model.scores([r[1] for r in rows]).argmax(1)] == [r[2] for r in rows]


def test_language_fit_equals_kernel_ridge_on_the_landmarks():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd "), 30)) for _ in range(30)] + ["".join(rng.choice(list("cdef "), 30)) for _ in range(30)]
    rows = [(language.grams(t), "xy"[k // 30]) for k, t in enumerate(texts)]
    model = language.fit(rows, landmarks=60)
    kernel = np.array([[len(set(a) & set(b)) / np.sqrt(len(a) * len(b)) for b, _ in rows] for a, _ in rows])
    y = np.where(np.arange(60)[:, None] // 30 == [0, 1], 1.0, -1.0)
    # all rows are landmarks, so Nystroem's kernel is the kernel; the constant is a feature of its own
    whole = kernel + 1
    want = whole @ np.linalg.solve(whole + language.RIDGE * np.eye(60), y)
    assert np.abs(model.scores(texts) - want).max() < 2e-3


def test_kernel_scores_are_products_with_landmarks():
    rows = [(language.grams(t), g) for t, g in [("aa ab aa", "x"), ("ab ab ba", "x"), ("cd dd dc", "y"), ("dd cd", "y")]]
    model = language.fit(rows)
    assert [model.languages[k] for k in model.scores(["aa aa", "dd dd"]).argmax(1)] == ["x", "y"]
    assert language.fit([]) is None


def test_language_of_odd_rows(odd):
    got = language.language_of(odd).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 6)} == {"und"}
    assert language.language_of(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language.language_of(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


@pytest.fixture(scope="module")
def toxic(spark):
    clean = ["good day to you. it rains.", "we walk home\nit is late", "no one is here!"]
    rows = [(k, clean[k % 3] + f" w{k % 17}.", 0.0) for k in range(60)] + [
        (100 + k, clean[k % 3] + " you vile" + "abc"[k % 3] + " thing. then more.", 1.0) for k in range(30)
    ]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y double"))


def test_toxicity_fit_is_an_optimum(spark):
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in "abcdefgh"]
    docs, labels = [], []
    for _ in range(150):
        bags = [list(rng.choice(words, 3)) for _ in range(rng.integers(1, 4))]
        docs.append(bags)
        labels.append(float(any("worda" in b and "wordb" in b or "wordc" in b for b in bags)))
    rows = [(". ".join(" ".join(b) for b in bags), y) for bags, y in zip(docs, labels, strict=True)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, y double"), steps=3000)
    names = sorted(model.weights)

    def loss(weights, bias):
        out = 0.0
        for bags, y in zip(docs, labels, strict=True):
            none = 1.0
            for bag in bags:
                held = {f for w in bag for f in toxicity.features(w.encode())}
                none *= 1 - 1 / (1 + np.exp(-bias - sum(weights.get(f, 0.0) for f in held)))
            q = min(max(1 - none, 1e-9), 1 - 1e-9)
            out -= (y * np.log(q) + (1 - y) * np.log(1 - q)) / len(docs)
        return out + toxicity.PENALTY * sum(map(abs, weights.values()))

    best = loss(model.weights, model.bias)
    assert best < loss({}, np.log(np.mean(labels) / (1 - np.mean(labels)))) / 2
    for _ in range(40):
        moved = {k: model.weights[k] + 0.3 * rng.standard_normal() for k in names}
        assert loss(moved, model.bias + 0.3 * rng.standard_normal()) > best - 2e-3


def test_fit_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append(rows.count()))
    docs = spark.createDataFrame([(1, f"text {k % 900}") for k in range(3000)] + [(3, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    toxicity.learnt(docs, labels, held_out=F.lit(False), at_most=100)
    assert 0 < seen[0] <= 150


def test_noisy_or_of_sentences(toxic):
    text = b"good day. you vileb thing! it rains."
    p = toxic.sentence_scores(toxicity.sentences(text))
    assert toxic.score(text) == pytest.approx(1 - np.prod(1 - p)) and toxic.score(text) > 0.7
    assert toxic.score(b"good day to you. it rains.") < 0.3
    assert toxic.score(None) == toxic.score(b"") == toxic.score(b"... !") == 0


def test_offending_sentences_are_located_and_stems_generalise(toxic):
    text = "Schön. It rains. You VILEC thing! More é you vilexyz thing. End"
    score, places = toxic.judged(text.encode())
    assert [text[s:e].strip() for s, e, _ in places] == ["You VILEC thing", "More é you vilexyz thing"]
    assert score == toxic.score(text.encode()) and toxic.judged(None) == toxic.judged(b" .") == (0.0, [])


def test_toxicity_on_held_out(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.96
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_toxicity_of_odd_rows(odd, labels):
    got = toxicity.toxicity(odd, labels, spans=True).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (3, 4, 6)} == {0.0}
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0}
    kept = toxicity.without_toxic(odd, labels)
    assert kept.schema == odd.schema and kept.count() == odd.count()
