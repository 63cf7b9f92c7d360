"""Models and bands come from every labelled row, however many there are."""

import zlib

import numpy as np

from quaystone.llm import quality, toxicity


def own_word(i):
    """Four letters that no other row has."""
    return "".join("abcdefghijklmnop"[i >> s & 15] for s in (12, 8, 4, 0))


def test_toxicity_counts_every_labelled_row(spark):
    """Each row has a word of its own: the model knows the last gram of each labelled one, and none of the others."""
    n = 20_000
    data = [(i, own_word(i) + (" vilewordy" if i % 5 == 0 else " sunnyday")) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(n) if i % 10], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    known = set(model.grams.tolist())
    ends = toxicity.grams([own_word(i) for i in range(n)])[0][4::5].tolist()
    assert {i for i in range(n) if ends[i] in known} == {i for i in range(n) if i % 10 and zlib.crc32(str(i).encode()) % 4 != 2}
    found = model.scores(["qqqq vilewordy", "qqqq sunnyday"], {})
    assert found[0] > 0.9 and found[1] < 0.1


def test_logistic_fit_takes_all_rows(spark):
    """Newton's sums over parts of the rows lead to the optimum of all of them."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(3000, len(toxicity.FEATURES)))
    y = (draw.random(3000) < 1 / (1 + np.exp(-(x[:, 0] - 2 * x[:, 3] - 0.5)))).astype(int)
    rows = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "y int, " + ", ".join(f"{c} double" for c in toxicity.FEATURES)).repartition(5)
    w = toxicity.fit_logistic(rows)
    p = 1 / (1 + np.exp(-(np.c_[x, np.ones(3000)] @ w)))
    penalty = np.append(np.full(len(w) - 1, 1e-2), 1e-6)
    assert np.abs(np.c_[x, np.ones(3000)].T @ (y - p) - penalty * w).max() < 1e-6
    assert abs(w[0] - 1) < 0.2 and abs(w[3] + 2) < 0.3


def test_bands_come_from_every_good_row(spark):
    """Bands equal those of exact percentiles over all rows labelled good, more than any former sample took."""
    draw = np.random.default_rng(8)
    n = 15_000
    words = ["".join(draw.choice(list("aeioubcdlmnrst"), 5)) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(draw.choice(words, 20 + i % 7))) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 != 0)) for i in range(n)], "doc_id long, quality int")
    rows = [r for r in quality.quality_rules(docs).collect() if r["doc_id"] % 50 and not r["base_failed"]]
    assert len(rows) > 12_500 and {r["script"] for r in rows} == {"latin"}
    (a, b), (c, d), (e, f) = (np.quantile([r[m] for r in rows], [quality.TAIL, 1 - quality.TAIL]) for m in ("chars_per_token", "fallback_share", "token_entropy"))
    k = quality.MARGIN
    assert np.allclose(quality.fit_bands(docs, labels)["latin"], (a - k * (b - a), b + k * (b - a), d + max(0.02, k * (d - c)), e - k * (f - e)), rtol=0, atol=1e-12)


def test_ranked_values(spark):
    """Ranks of negative, equal and widely spread values, zeros of both signs among them."""
    draw = np.random.default_rng(9)
    values = np.concatenate([draw.normal(size=500) * 10.0 ** draw.integers(-300, 300, 500), np.zeros(50), -np.zeros(50), np.full(100, 1.5)])
    rows = spark.createDataFrame([("ab"[i % 2], float(v), float(-v), float(i)) for i, v in enumerate(values)], "script string, " + ", ".join(f"{m} double" for m in quality.MEASURES)).repartition(4)
    columns = {(g, m): np.sort([v * s if s else i for i, v in enumerate(values) if "ab"[i % 2] == g]) for g in "ab" for m, s in zip(quality.MEASURES, (1, -1, 0), strict=True)}
    wanted = {k: {0, 1, 117, 200, len(c) - 1} for k, c in columns.items()}
    found = quality.ranked_values(rows, wanted)
    assert len(found) == 30 and all(v == columns[g, c][r] for (g, c, r), v in found.items())
