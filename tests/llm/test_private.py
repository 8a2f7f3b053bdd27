import re

from pyspark.sql import functions as F

from eventlake.llm import private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.com_c@d.org x", "x@y", "1.2.3.4.5.6.7.8 999.1.1.1", "+1+1 222 333 4444-+49 (30) 1234.567 ",
    "4111 1111 1111 1111 4111-1111-1111-1112", "é\U0001f600 jo@ex.co.uk 10.0.0.1", "0@0.0.0.0", " a@-.- ..@a.b..c",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "a" * 50_000, "a@" + "b." * 20_000 + "c", "1." * 20_000 + "1", "7" * 50_000,
    "+1" + " (" * 20_000,
]


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        if kind == "email" and "@" not in text:  # quadratic in long runs, and finds nothing
            continue
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p[-9:]) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_are_those_of_the_plain_patterns(spark, docs):
    texts = docs.select("doc_id", "text").union(
        spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(HARD)], "doc_id BIGINT, text STRING")
    )
    for r in private.with_base(texts).select("text", private.listed(F.col("base")).alias("b")).collect():
        assert r.b == brute(r.text)


def test_trees_add_spans_and_keep_the_base(spark):
    rows = []
    for i in range(400):
        rows.append((i, f"and write to ab{i}.x@mail{i % 7}.example.com or call +1 ({200 + i}) 555-{1000 + i} today"))
        rows.append((1000 + i, f"the count was {i * 977 % 9999} then 20{i % 100:02d}-0{i % 9}-1{i % 9} 12:30 and x{i}y{i * 31}z12345678"))
    train = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    model = private.train(train)
    assert model is not None and len(model.trees) == private.TREES
    found = private.find(train.where("doc_id < 1000"), model)
    extra = found.where(F.size("spans") != F.size("base")).count()
    assert found.where(F.size(F.array_except("base", "spans")) > 0).isEmpty() and extra == 0


def spelled(i):
    return (
        f"please write to bob.smith{i}[at]mail{i % 5}[dot]example today",
        f"please ask kim{i} (at) host-{i % 9} (dot) org about it",
        f"the server 10[.]{i % 200}[.]3[.]{i % 250} answers",
    )


def test_trees_add_other_spellings_however_common_they_are(spark):
    plain = [(i, f"please write to ab{i}.x@mail{i % 7}.example.com or ask 10.0.{i % 250}.{i % 99} today") for i in range(400)]
    noise = [(1000 + i, f"the count was {i * 977 % 9999} then 20{i % 100:02d}-0{i % 9}-1{i % 9} 12:30 and x{i}y{i * 31}z12345678") for i in range(400)]
    asked = [(5000 + i, text) for i in range(50) for text in spelled(100 + i)]
    schema = "doc_id BIGINT, text STRING"
    other = spark.createDataFrame(asked, schema)
    for many in (0, 100):
        table = plain + noise + [(2000 + i, text) for i in range(many) for text in spelled(i)]
        train = spark.createDataFrame(table, schema)
        model = private.train(train)
        if many:
            found = private.find(other, model).select(private.redacted(F.col("text"), F.col("spans")).alias("r"))
            assert {r.r for r in found.collect()} == {
                "please write to <EMAIL> today", "please ask <EMAIL> about it", "the server <IP> answers"
            }
        clean = private.find(spark.createDataFrame(noise, schema), model)
        assert clean.where(F.size("spans") > 0).isEmpty()


def test_normal_form(spark):
    rows = [
        (0, "a.b [at] c (dot) d", True), (0, "a@b", False), (0, "a{at}b-c.d", True), (1, "1[.]2[.]3[.]255", True),
        (1, "1.2.3.256", False), (1, "1:2:3:4", False), (2, "4111/1111.1111_1111", True), (2, "4111/1111.1111_1112", False),
        (3, "0049 30 1234567", True), (3, "+49 (30)/1234.567", True), (3, "2024-01-12 12", False), (3, "+1 2", False),
    ]
    df = spark.createDataFrame(rows, "kind INT, value STRING, expected BOOLEAN")
    found = df.select("value", "expected", private.is_private(F.struct("kind", "value")).alias("found")).collect()
    assert [(r.value, r.found) for r in found] == [(r.value, r.expected) for r in found]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "jo@ex.co.uk")], "doc_id INT, text STRING").selectExpr(
        "*", "1 AS base", "2 AS spans", "3 AS candidates", "4 AS __text", "5 AS __email", "6 AS row"
    )
    model = private.Trees(("Predict: 0.0",), (1.0,), (1.1,) * 4)
    for known in (None, model):
        (r,) = private.find(df, known).collect()
        assert (r.candidates, r["__text"], r["__email"], r["row"]) == (3, 4, 5, 6)
        assert [s.value for s in r.base] == [s.value for s in r.spans] == ["jo@ex.co.uk"]


def test_odd_rows(odd, none):
    model = private.train(odd)
    assert model is None  # nothing to learn from: only base spans
    found = private.find(odd, model)
    assert found.count() == odd.count() and set(odd.columns) < set(found.columns)
    assert found.where(F.size("spans") > 0).isEmpty()
    assert private.find(none, private.train(none)).count() == 0


def test_redaction(spark):
    text = "é\U0001f600 jo@ex.co.uk 10.0.0.1, x 0@0.0.0.0"
    df = private.find(spark.createDataFrame([(1, text), (2, None)], "doc_id INT, text STRING"), None)
    found = {r.doc_id: r.r for r in df.select("doc_id", private.redacted(F.col("text"), F.col("spans")).alias("r")).collect()}
    assert found == {1: "é\U0001f600 <EMAIL> <IP>, x <EMAIL>", 2: None}
