import numpy as np
from pyspark.sql import functions as F

from eventlake.llm import language
from eventlake.llm.common import crc_of_id


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    network = language.Network.random(["a", "b", "c"], 4, 3)
    for field in ("inputs", "gates", "candidate"):
        setattr(network, field, [v.astype(np.float64) for v in getattr(network, field)])
    windows = rng.integers(97, 110, (5, 7)).astype(np.uint8)
    labels = rng.integers(0, 3, 5)

    def loss():
        return -np.log(network.label(windows)[:, np.arange(5), labels]).mean()

    for value, grad in zip(network.parameters(), network.gradients(windows, labels)):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        step, old = 1e-2, value[at]
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert np.isclose((up - down) / (2 * step), grad[at], rtol=0.05, atol=1e-4)


def test_held_out_accuracy(docs):
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    network = language.train(docs.where(~held_out), steps=250)
    assert network.languages == ["de", "en", "es", "fr"]
    rows = language.predict(docs.where(held_out), network, keep=("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd, none):
    network = language.train(odd, steps=5)
    found = language.predict(odd, network).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (2, 3, 4, 7))
    assert by_id[5].lang_pred in network.languages
    assert {r.score for r in found if r.doc_id == 1} == {by_id[1].score}
    unlearned = language.predict(odd, language.train(none)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}
    assert language.predict(none, network).collect() == []


def test_what_is_told_goes_by_the_least_score_of_labelled_rows(spark):
    rows = [
        (1, "text", "en", "en", 0.9), (2, "text", "de", "en", 0.6), (3, "junk", None, "en", 0.59),
        (4, "text", None, "de", 0.7), (5, "123", "en", "und", 0.0), (6, None, None, "und", 0.0),
    ]
    schema = "doc_id INT, text STRING, lang STRING, lang_pred STRING, score DOUBLE"
    found = spark.createDataFrame(rows, schema)
    assert {r.doc_id for r in language.told(found).collect()} == {1, 2, 4}
    unlearned = found.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'und' AS lang_pred", "0D AS score")
    assert {r.doc_id for r in language.told(unlearned).collect()} == {1, 2, 3, 4}
    assert language.told(found.limit(0)).collect() == []


def test_stage_keeps_lettered_text_without_labels(spark):
    import corpus_pipeline
    from tests.llm.conftest import SCHEMA, SF

    docs = spark.createDataFrame([(1, "clean words", None, "a", 11), (2, "12 3", None, "a", 4), (None, "more", None, None, None)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} == {1, None}


def test_labels_the_network_does_not_find_set_no_limit(spark, monkeypatch):
    from tests.llm.conftest import SCHEMA

    scores = {"sure": ("en", 0.9), "least": ("de", 0.6), "low": ("en", 0.5), "unsure": ("en", 0.59), "between": ("fr", 0.7)}
    rows = [(1, "sure", "en", "a", 4), (2, "least", "de", "a", 5), (None, "low", "de", "a", 3), (4, "unsure", None, "b", 6)]
    rows += [(5, "between", "en", "b", 7), (6, "12", "en", "b", 2), (7, None, "en", None, None), (8, "least", None, "b", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)

    def predicted(docs, network, keep):
        known = spark.createDataFrame([(t, *x) for t, x in scores.items()], "text STRING, lang_pred STRING, score DOUBLE")
        # Of copies the one without a label scores less in the last digits.
        score = F.coalesce("score", F.lit(0.0)) - F.when(F.col("lang").isNull(), 1e-9).otherwise(0)
        found = docs.join(known, "text", "left")
        return found.select(*keep, F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))

    monkeypatch.setattr(language, "predict", predicted)
    kept = language.keep_told(docs, None)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(rows[i] for i in (0, 1, 4, 7))
    # No label is found: all text with letters stays.
    wrong = docs.withColumn("lang", F.lit("es"))
    assert {r.doc_id for r in language.keep_told(wrong, None).collect()} == {1, 2, None, 4, 5, 8}


def test_network_rejects_labelled_text_it_cannot_tell(spark):
    import corpus_pipeline
    from tests.llm.conftest import SCHEMA, SF

    english = "the quick brown fox jumps over the lazy dog and then it goes home to sleep"
    german = "der schnelle braune fuchs springt \u00fcber den faulen hund und geht nach hause"
    rows = [(i, english, "en", "a", 0) for i in range(40)] + [(i, german, "de", "a", 0) for i in range(40, 80)]
    # Half of either language, and a label that the text doesn't bear out.
    rows += [(80, " ".join(w for pair in zip(english.split(), german.split()) for w in pair), "fr", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    network = language.train(docs.where("lang <> 'fr'"))
    assert {r.doc_id for r in language.keep_told(docs, network).collect()} == set(range(80))
    assert corpus_pipeline.identify_language(spark, docs.limit(0), SF).count() == 0
