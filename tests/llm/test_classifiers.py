"""Toxicity, quality and language: held-out accuracy, exact parts by brute force, edge cases."""

import itertools

import numpy as np
import pytest

from stratocast.llm import language, quality, recurrent, toxicity

from .cases import SF, edge_rows


def big(spark, name):
    return spark.read.parquet(SF.replace("0.001", "0.01") + f"/{name}.parquet")


@pytest.mark.parametrize("op,label,least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, op, label, least):
    docs, labels = big(spark, "documents"), big(spark, "labels")
    got = op.digest(op.score(docs, op.fit(docs, labels))).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got[label]).mean() >= least


def test_language_held_out_accuracy(spark):
    docs = big(spark, "documents")
    got = language.digest(language.score(docs, language.fit(docs, steps=250))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.9


@pytest.mark.parametrize("op", [toxicity, quality])
def test_edge_cases(documents, labels, op):
    docs = documents(edge_rows(), extra=True)
    lab = labels([(6, 1, 0), (7, 0, 1), (7, 1, 1), (None, 1, 1), (3, None, None), (9, 1, 0)])
    for model in (op.fit(docs, lab), op.fit(docs, lab.limit(0))):
        got = op.digest(op.score(docs, model)).toPandas()
        assert len(got) == 11 and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
        assert not got[got.doc_id.isna()].held_out.any()
        assert got[got.doc_id == 4].score.nunique() == 1
        assert op.score(docs.limit(0), model).count() == 0


def test_language_edge_cases(documents):
    docs = documents(edge_rows() + [(20, "123 456"), (21, "²½"), (22, "é")], extra=True)
    net = language.fit(docs.limit(0))
    assert set(r.lang_pred for r in language.score(docs, net).collect()) == {"und"}
    net = language.fit(docs.unionByName(documents([(i, "ab cd " * 9) for i in range(40, 60)], lang="fr", extra=True)), steps=5)
    got = {r.doc_id: r for r in language.score(docs, net).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[20].lang_pred == got[21].lang_pred == "und"
    assert got[22].lang_pred in net["langs"] and 0 <= got[5].score <= 1


def test_noisy_or_is_that_of_its_sentences():
    model = (-3.0, {"bad": 4.0, "wors*": 2.0})
    text = "All fine. Bad here!\nWorst of all bad. End"
    p = [1 / (1 + np.exp(-z)) for z in (-3, 1, -3 + 2 + 4, -3)]
    total, worst = toxicity.log_none(text, *model)
    assert -np.expm1(-total) == pytest.approx(1 - np.prod(1 - np.array(p)))
    assert text[worst[1]:worst[2]] == "Worst of all bad."


def test_offending_sentences_are_located(documents):
    text = "All fine. Bad here!\nWorst of all bad. End"
    got = toxicity.offending(documents([(1, text), (2, None)]), (-3.0, {"bad": 4.0})).collect()
    assert [text[r.start:r.end] for r in got] == [" Bad here!\n", "Worst of all bad."] and all(r.score > 0.5 for r in got)


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    z, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    weight, good = 0.0, np.zeros(5)
    for path in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(z[t] for t in range(5) if path[t]) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        weight, good = weight + w, good + w * np.array(path)
    padded = np.full((2, 7), np.nan)
    padded[0, :5], padded[1] = z, rng.normal(size=7)
    assert quality.marginals(padded, trans)[0][0, :5] == pytest.approx(good / weight)


def test_lines_of_a_batch_do_not_mix():
    rng = np.random.default_rng(2)
    model = {k: rng.normal(size=quality.N_FEATURE) for k in ("w", "wp", "wn", "mean")} | {"b": np.ones(1), "scale": np.ones(quality.N_FEATURE), "trans": rng.normal(size=(2, 2))}
    texts = [b"", b"one\ntwo\n\nthree three three", b"x" * 5000, b"\n" * 400, b"A\nb"]
    together = quality.document_scores(texts, model)
    assert together == pytest.approx([quality.document_scores([t], model)[0] for t in texts], abs=1e-5)


@pytest.mark.parametrize("init,run,gradient", [(recurrent.init_gru, recurrent.gru, recurrent.gru_gradient), (recurrent.init_lstm, recurrent.lstm, recurrent.lstm_gradient)])
def test_gradients_by_differences(init, run, gradient):
    rng = np.random.default_rng(3)
    p = {k: v * 0.3 for k, v in init(6, 3, rng).items()}
    ids, w = rng.integers(0, 6, (7, 4)), rng.normal(size=(7, 3, 4)).astype(np.float32)
    states = []
    run(ids, p, states)
    got = gradient(ids, p, states, w)
    for k in p:
        for at in [tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(6)]:
            up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            up[k][at] += 1e-2
            down[k][at] -= 1e-2
            want = float(((run(ids, up) - run(ids, down)).astype(float) * w).sum()) / 2e-2
            assert got[k][at] == pytest.approx(want, abs=2e-2)


def test_windows_label_every_byte_once():
    lengths = np.array([0, 5, 224, 225, 1000])
    owner, at = recurrent.windows(lengths, 224, 16)
    ids, inside = recurrent.symbols(np.arange(lengths.sum()), np.cumsum(lengths) - lengths, lengths, owner, at, 224, 16, -1)
    core = ids[16:-16][inside[16:-16]]
    assert sorted(core) == list(range(lengths.sum()))
