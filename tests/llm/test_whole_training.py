"""Models are fitted, and words counted, on all rows of tables of more than 20,000 documents."""

from pyspark.sql import functions as F

from eventlake.llm import private, secrets


def rows_written(monkeypatch, module):
    """How many rows ``module`` has written, by purpose."""
    seen, write = {}, module.written

    def counted(df, purpose):
        found = write(df, purpose)
        seen[purpose] = found.count()
        return found

    monkeypatch.setattr(module, "written", counted)
    return seen


def test_trees_see_the_candidates_of_all_documents(spark, monkeypatch):
    n = 30_000
    digits = F.lpad((F.col("id") * 7919 % 100_000_007).cast("string"), 12, "1")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("write to u"), "id", F.lit("@mail.org now")))
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.coalesce(text, F.concat(F.lit("number "), digits, F.lit(" of many"))).alias("text")
    )
    whole = private.with_candidates(private.with_base(docs)).where(F.size("candidates") > 0).count()
    seen = rows_written(monkeypatch, private)
    assert private.train(docs, trees=2, depth=2) is not None
    assert whole > 25_000 and seen["private-candidates"] >= whole


def test_dictionary_and_forest_see_all_documents(spark, monkeypatch):
    n = 30_000
    # 300 words of close counts: any sample would choose others among them.
    word = F.translate((F.col("id") % 300).cast("string"), "0123456789", "abcdefghij")
    twice = F.when(F.col("id") < 300 * (F.col("id") % 300), F.concat(F.lit(" word"), word)).otherwise("")
    secret = F.concat(F.lit(" AKIA"), F.upper(F.substring(F.md5(F.col("id").cast("string")), 1, 16)))
    harmless = F.concat(F.lit(" 4111"), F.lpad(F.col("id").cast("string"), 12, "0"))
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("word"), word, twice, F.when(F.col("id") % 2 == 0, secret).otherwise(harmless)).alias("text"),
    )
    seen = rows_written(monkeypatch, secrets)
    forest = secrets.train(docs, trees=2, depth=2)
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("w"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(secrets.DICTIONARY_WORDS)
    assert set(forest.words) == {r.w for r in top.collect()}
    assert seen["secrets-findings"] == secrets.labelled(docs).count() >= 25_000
