"""What training brings to the driver."""

import random

import numpy as np

from quarry.llm import toxicity


def test_only_telling_features_reach_the_driver(spark, monkeypatch):
    """Words that both classes have alike stay on the executors; the models are those of all features."""
    r = random.Random(3)
    texts = [(k, " ".join([f"common{w}" for w in range(200)] + [f"w{r.randrange(500)}" for _ in range(40)] + ([f"bad{r.randrange(4)}"] if k % 4 == 0 else []) + ([f"odd{r.randrange(4)}"] if k % 3 == 0 else []))) for k in range(240)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 4 == 0)) for k, _ in texts], "doc_id long, quality int, toxic int")
    got, fit = [], toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda *x: got.append(x) or fit(*x))
    chain = toxicity.train(frame, labels)
    rows, y, names, fold = got[0]
    assert sum(map(len, rows)) < 20 * len(texts) and all(len(m.names) for m in chain.models)
    out = next(iter(toxicity._features_of(iter([frame.toArrow().combine_chunks().to_batches()[0]]))))
    every = {doc: np.sort(np.asarray(x.values, np.int64) & 0xFFFFFFFF) for doc, x in zip(out.column("doc_id").to_pylist(), out.column("features"), strict=True)}
    whole = fit([every[k] for k in range(240)], y, names, fold)
    for a, b in zip(chain.models, whole.models, strict=True):
        assert a.names.tolist() == b.names.tolist() and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias
    assert chain.threshold == whole.threshold
