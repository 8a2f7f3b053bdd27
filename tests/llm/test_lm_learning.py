"""The mixing model's weights and refinement are learned from every decision of every training text."""

import numpy as np
from pyspark.sql import functions as F

from eventlake.llm import lm
from eventlake.llm.common import crc_of_id


def test_weights_and_refinement_meet_every_decision_of_all_training_texts(spark, monkeypatch):
    n = 3_000
    # Texts end in bytes of their own, beyond the first few kilobytes.
    text = F.concat(F.repeat(F.lit("some words "), 400), F.md5(F.col("id").cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 != 0, text).alias("text"))
    trained = F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 1
    met, codes, learn, of = {}, [], lm.learn, lm.Code.of

    def watched(*counts):
        met["joint"], met["by_node"] = counts
        return learn(*counts)

    def kept(counts):
        codes.append(of(counts))
        return codes[-1]

    monkeypatch.setattr(lm, "learn", watched)
    monkeypatch.setattr(lm.Code, "of", kept)
    assert lm.score(docs, trained).count() == n
    expected = sum(
        int(codes[0].length[np.frombuffer((r.text or "").encode(), np.uint8)].sum() + codes[0].length[lm.END])
        for r in docs.where(trained).collect()
    )
    assert met["joint"].sum() == met["by_node"].sum() == expected
    assert (met["joint"].sum(axis=(1, 2)) > 0).all()


def test_weights_follow_the_predictor_that_is_right():
    rng = np.random.default_rng(0)
    gate, inputs = lm.cells()
    full = np.flatnonzero(gate == lm.LEVELS ** len(lm.ORDERS) - 1)
    cell = rng.choice(full, 200_000)
    ones = rng.random(len(cell)) < 1 / (1 + np.exp(-inputs[cell, 1]))  # the second one's log odds are the true ones
    joint = np.zeros((lm.GROUPS, lm.CELLS, 2), dtype=np.int64)
    np.add.at(joint, (np.arange(len(cell)) % lm.GROUPS, cell, ones.astype(int)), 1)
    by_node = np.zeros((lm.END + 1, lm.BINS, 2), dtype=np.int64)
    by_node[3, 5] = 30, 10
    mixer = lm.learn(joint, by_node)
    assert np.allclose(mixer.weights[-1], [0, 1, 0, 0], atol=0.05)
    assert np.allclose(mixer.weights[:-1], lm.Mixer.new().weights[:-1])  # gates that met nothing
    assert abs(mixer.refined[3, 5] + np.log(3)) < 0.3
    assert np.allclose(mixer.refined[4], lm.Mixer.new().refined[4], atol=1e-3)


def test_codes_tell_levels_and_log_odds():
    zeros, ones = np.array([0, 1, 0, 1, 2, 0, 30, 0, 15]), np.array([0, 0, 1, 1, 0, 3, 0, 1000, 15])
    gate, inputs = lm.cells()
    found = lm.codes(zeros, ones)
    assert (gate[found] == [0, 1, 1, 1, 1, 2, 3, 3, 3]).all()
    odds = np.log((ones + 0.4) / (zeros + 0.4))
    assert np.abs(inputs[found, len(lm.ORDERS) - 1] - odds).max() < 0.9
