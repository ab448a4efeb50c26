"""The fitted text encoder, and training of logistic heads, against plain numpy."""

import numpy as np
import pytest

from strataloom.operators import encoder, training, vectors


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def encoded(got) -> dict:
    return {r["id"]: np.array(r["embedding"]) for r in got.collect()}


# ---------------------------------------------------------------- encoder


@pytest.fixture(scope="module")
def topics():
    """(texts, pairs): a text has 5 words of one of 20 topics of 14 words each, and 3 of 40 words of all; the two texts of a pair share no word of their topic."""
    draw = np.random.default_rng(7)
    topic = [[f"t{k}w{i}" for i in range(14)] for k in range(20)]
    noise = [f"n{i}" for i in range(40)]
    line = lambda own: " ".join([*own, *draw.choice(noise, 3, replace=False)])
    texts = [line(draw.choice(topic[k % 20], 5, replace=False)) for k in range(1200)]
    pairs = []
    for k in range(20):
        mixed = draw.permutation(topic[k])
        pairs.append((line(mixed[:5]), line(mixed[5:10])))
    return texts, pairs


def test_paraphrases_rank_above_random_texts(spark, topics):
    texts, pairs = topics
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + 2 * k + s, t) for k, p in enumerate(pairs) for s, t in enumerate(p)]
    df = spark.createDataFrame(rows, "id long, text string").cache()
    fitted = encoder.fit(df, rank=24)
    share = {}
    for name, encode in (("fitted", fitted), ("hashed", None)):
        v = encoded(vectors.embedded(df, encode))
        above = []
        for k in range(20):
            others = np.stack([v[i] for i in range(len(texts)) if i % 20 != k])
            above.append((others @ v[10_000 + 2 * k] < v[10_000 + 2 * k] @ v[10_000 + 2 * k + 1]).mean())
        share[name] = np.mean(above)
    assert share["fitted"] > 0.98 and share["fitted"] > share["hashed"] + 0.2, share


def test_axes_are_those_of_a_dense_svd(spark, topics):
    rows = [(i, t) for i, t in enumerate(topics[0][:300])]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    rank = 19
    got = encoded(encoder.fit(df, rank=rank, passes=40, size=250, shared=64)(df))
    enc = encoder.fit(df, rank=rank, passes=1, size=250, shared=64)
    terms = {r["term"]: (r["n"], r["key"], r["idf"]) for r in encoder.term_weights(df).selectExpr("term", "n", "xxhash64(term) as key", "idf").collect()}
    own = sorted(terms, key=lambda t: (-terms[t][0], terms[t][1]))[:250]
    place = {t: i for i, t in enumerate(own)}
    idf = [terms[t][2] for t in own] + [0.0] * 64
    for t in set(terms) - set(own):
        place[t] = 250 + terms[t][1] % 64
        idf[place[t]] = min(idf[place[t]] or np.inf, terms[t][2])
    dense = np.zeros((300, 314))
    for i, t in rows:
        for w in t.split():
            dense[i, place[w]] += 1
    dense = unit(np.where(dense > 0, 1 + np.log(np.maximum(dense, 1)), 0) * np.array(idf))
    _, s, vt = np.linalg.svd(dense, full_matrices=False)
    want = dense @ vt[:rank].T
    mine = np.stack([got[i] for i in range(300)])
    assert len(enc.keys) == 250 and s[rank - 1] - s[rank] > 1e-3
    np.testing.assert_allclose(mine @ mine.T, want @ want.T, atol=1e-3)


def test_matrices_of_many_tasks_add_up(spark, topics, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(topics[0][:400])], "id long, text string").repartition(8)
    fit = lambda: encoder.fit(df, rank=3, size=30, shared=4, extra=2, passes=3)
    monkeypatch.setattr(encoder, "FAN", 2)
    monkeypatch.setattr(encoder, "BLOCK", 16)
    many = fit()
    monkeypatch.setattr(encoder, "BLOCK", 1024)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = fit()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many.axes.any()
    np.testing.assert_allclose(many.axes, one.axes, atol=1e-9)


def test_encoder_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "A  b"), (None, "...")], "id long, text string")
    fitted = encoder.fit(df, rank=4)
    got = encoded(fitted(df))
    assert set(got) == {1, 2, 3, 4, None}
    assert not any(got[1]) and not any(got[2]) and not any(got[None])
    assert (got[3] == got[4]).all() and np.isclose(np.linalg.norm(got[3]), 1)
    long = spark.createDataFrame([("x", " ".join(f"w{i}" for i in range(100_000)))], "id string, text string")
    assert len(encoded(fitted(long))["x"]) == 4  # words that were never seen share columns
    empty = encoder.fit(df.where("id = 99"), rank=4)
    assert not any(encoded(empty(df))[3])


def test_encoder_is_saved(spark, tmp_path, topics):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(topics[0][:50])], "id long, text string")
    fitted = encoder.fit(df, rank=8, size=100, shared=16)
    fitted.save(spark, str(tmp_path / "enc"))
    again = encoder.Encoder.load(spark, str(tmp_path / "enc"))
    one, two = encoded(fitted(df)), encoded(again(df))
    assert all((one[i] == two[i]).all() for i in one)


# ---------------------------------------------------------------- heads


def points(spark, n=300, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, 5))
    y = (x @ draw.standard_normal((5, 3)) + 0.3 * draw.standard_normal((n, 3)) > 0).astype(float)
    return x, y, spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>")


def by_numpy(x, y, cell, vx, vy, by):
    """(history, weights) of the same training in plain numpy."""
    x, vx = np.c_[x, np.ones(len(x))], np.c_[vx, np.ones(len(vx))]
    w = np.zeros((y.shape[1], x.shape[1]))
    m, v, n, lr, best, bad, out = w, w, 0, by.lr, np.inf, 0, []
    loss = lambda p, t: -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for epoch in range(1, by.epochs + 1):
        losses = []
        for c in by.order(epoch):
            bx, t = x[cell == c], y[cell == c]
            p = sigmoid(bx @ w.T)
            losses.append(loss(p, t))
            g = (p - t).T @ bx / t.size + by.decay * w
            n += 1
            m, v = by.betas[0] * m + (1 - by.betas[0]) * g, by.betas[1] * v + (1 - by.betas[1]) * g * g
            w = w - lr * m / (1 - by.betas[0] ** n) / (np.sqrt(v / (1 - by.betas[1] ** n)) + by.eps)
        val = loss(sigmoid(vx @ w.T), vy)
        out.append((epoch, lr, np.mean(losses), val))
        bad = 0 if val < best * (1 - by.threshold) else bad + 1
        best = min(best, val)
        if bad > by.patience:
            lr, bad = lr * by.factor, 0
    return out, w


BY = training.Schedule(epochs=7, batches=3, lr=0.8, patience=0, threshold=0.1)


def test_heads_learn_as_in_numpy(spark, tmp_path):
    x, y, df = points(spark)
    run = training.train(df.where("id < 240"), df.where("id >= 240"), str(tmp_path / "run"), BY)
    cell = np.array([r[0] for r in df.where("id < 240").orderBy("id").select(BY.cell(df["id"])).collect()])
    want, weights = by_numpy(x[:240], y[:240], cell, x[240:], y[240:], BY)
    np.testing.assert_allclose([tuple(r) for r in run.history(BY.lr).orderBy("epoch").collect()], want, rtol=1e-9)
    np.testing.assert_allclose(run.load(BY.epochs).weights, weights, rtol=1e-8)
    assert len({lr for _, lr, _, _ in want}) > 1  # the rate fell on the way
    assert run.best().epoch == min(want, key=lambda r: r[3])[0]


def test_a_stopped_run_goes_on_with_the_same_weights(spark, tmp_path, monkeypatch):
    _, _, df = points(spark)
    rows, held = df.where("id < 240"), df.where("id >= 240")
    whole = training.train(rows, held, str(tmp_path / "whole"), BY)
    real = training.Run.save

    def fails(self, state):
        if state.epoch == 4:
            self.spark.createDataFrame([(1,)], "cls int").write.parquet(self.folder(4))  # files, but not the mark
            (tmp_path / "part" / "epoch-00004" / "_SUCCESS").unlink()
            raise OSError("stopped")
        real(self, state)

    monkeypatch.setattr(training.Run, "save", fails)
    with pytest.raises(OSError):
        training.train(rows, held, str(tmp_path / "part"), BY)
    monkeypatch.setattr(training.Run, "save", real)
    part = training.Run(spark, str(tmp_path / "part"))
    assert part.epochs() == 3
    part = training.train(rows, held, str(tmp_path / "part"), BY)
    one, two = whole.load(7), part.load(7)
    np.testing.assert_allclose(one.weights, two.weights, rtol=1e-9)
    assert (one.step, one.lr, one.best_epoch, one.bad) == (two.step, two.lr, two.best_epoch, two.bad)
    assert part.history(BY.lr).count() == 7
    assert training.train(rows, held, str(tmp_path / "part"), BY).epochs() == 7  # nothing left to do


def test_heads_of_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, None], [1.0]), (2, None, [1.0]), (3, [1.0, 2.0], None), (4, [0.5, 0.5], [None]), (4, [0.5, 0.5], [0.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    by = training.Schedule(epochs=2, batches=4, lr=0.1)
    run = training.train(df, df.where("id = 99"), str(tmp_path / "odd"), by)
    history = run.history(by.lr).orderBy("epoch").collect()
    assert [r["val_loss"] for r in history] == [None, None] and run.best().epoch == 2
    assert run.load(2).weights.shape == (1, 3) and np.isfinite(run.load(2).weights).all()
    assert training.scores(df, run.best(), ["a"]).count() == 3
    with pytest.raises(ValueError, match="no rows"):
        training.train(df.where("id = 99"), df.where("id = 99"), str(tmp_path / "none"), by)
    with pytest.raises(ValueError, match="different lengths"):
        training.train(df.union(spark.createDataFrame([(5, [1.0], [1.0])], df.schema)), df, str(tmp_path / "mixed"), by)
