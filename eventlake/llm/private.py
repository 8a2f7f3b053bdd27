"""Personal data: candidate spans, boosted trees over format and context, calibrated selection.

Everything is DataFrame expressions over scans; the trees are fitted by Spark ML on the candidates of all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import seeded_unit, written

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repetition and a look-behind (or the end of the last match) keep
# each linear in the text; they match what the plain patterns match from the left.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators of high recall: other spellings and separators, and plain runs of digits.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[({]at[\])}]\x20?)"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]++(?:(?:[.:]|\[\.\])[0-9]++){3}+",
    "card": r"[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}+",
    "phone": r"[+(]?[0-9](?:[\x20()./_-]{0,3}[0-9]){6,14}+",
}
_NEEDS = {"email": r"@|[\[({]at[\])}]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"\+"}
# Words before a span that speak for it.
CUES = r"(?i)(?:mail|contact|write|ip|host|server|addr\w*|card|visa|credit|pay\w*|tel|phone|call|fax|mobile)[\x20:=#.]*$"

TREES = 12
DEPTH = 3
LEAST_EXAMPLES = 20  # of either class; with fewer no span is added
PASS_BY = 0.995  # of other candidates held out from fitting, how many the threshold must keep out
LEAST_SCORE = 0.6
SEED = 2
CONTEXT = 24


def spans(text: Column, pattern: str, kind: int, needs: str | None = None) -> Column:
    """Non-overlapping matches from the left: array of (start, kind, end, value), in code points.

    The gaps between matches give the places. ``needs`` is a cheap test that texts without a match fail.
    """
    none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int,value:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(hits.alias("hit"), F.split(text, pattern, -1).alias("gap"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        one = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value")
        )
        return F.struct(
            end.alias("at"),
            F.when(pair["hit"].isNull(), state["found"])
            .otherwise(F.concat(state["found"], F.array(one)))
            .alias("found"),
        )

    found = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda state: state["found"]
    )
    test = text.rlike(needs or pattern)
    return F.when(test, found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        doubled = digit * 2
        value = F.when(place % 2 == 1, digit).otherwise(
            F.when(doubled > 9, doubled - 9).otherwise(doubled)
        )
        return total + value

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The rule that a match of a base pattern has to pass."""
    n = F.length(_digits(value))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


# How other spellings of the same data are written back to what the base rules read (pattern, replacement).
NORMAL = {
    "email": ((r"\x20?[\[({]at[\])}]\x20?", "@"), (r"\x20?[\[({]dot[\])}]\x20?", ".")),
    "ip": ((r"\[\.\]", "."),),
    "card": ((r"[./_-]", ""), (r"\x20", "")),
    "phone": ((r"^\(?00", "+"), (r"[/_]", "-")),
}
_WHOLE = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$",
    "ip": r"^[0-9]+(\.[0-9]+){3}$",
    "card": r"^[0-9]+$",
    "phone": r"^\+[0-9(][\x20().0-9-]+[0-9]$",
}


def is_private(span: Column) -> Column:
    """Whether a candidate, written back to the base rules' form, passes the rules of its kind."""
    out = F.lit(False)
    for k, kind in enumerate(KINDS):
        value = span["value"]
        for pattern, plain in NORMAL[kind]:
            value = F.regexp_replace(value, pattern, plain)
        out = F.when(span["kind"] == k, value.rlike(_WHOLE[kind]) & holds(kind, value)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: array of the spans of the four base kinds, by start, then kind."""
    found = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    for k, kind in enumerate(KINDS):
        found = found.withColumn(f"__{kind}", spans(F.col("__text"), BASE[kind], k, _NEEDS[kind]))


    def kept(kind: str) -> Column:
        return F.filter(F.col(f"__{kind}"), lambda span: holds(kind, span["value"]))

    return found.withColumn("base", F.array_sort(F.concat(*map(kept, KINDS)))).drop(
        "__text", *(f"__{kind}" for kind in KINDS)
    )


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (text, base) with ``candidates``: spans of the generators, overlapping ones included."""
    found = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    for k, kind in enumerate(KINDS):
        needs = _NEEDS[kind] if kind == "email" else r"[0-9][^0-9]{0,3}[0-9]"
        found = found.withColumn(f"__{kind}", spans(F.col("__text"), CANDIDATES[kind], k, needs))
    return found.withColumn("candidates", F.concat(*(F.col(f"__{kind}") for kind in KINDS))).drop(
        "__text", *(f"__{kind}" for kind in KINDS)
    )


FEATURES = (
    "kind", "length", "digits", "letters", "separators", "kinds_of_separator", "plus", "brackets",
    "at", "dots", "longest_digits", "groups", "before_space", "before_word", "after_space", "after_word", "cue",
)


def features(text: Column, span: Column) -> list[Column]:
    """Format and context of a span; none of the base rules' tests are among them."""
    value = span["value"]
    before = F.substring(
        text, F.greatest(F.lit(1), span["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), span["start"])
    )
    after = F.substring(text, span["end"] + 1, F.lit(1))
    runs = F.split(value, "[^0-9]+")
    return [
        c.cast("double")
        for c in (
            span["kind"],
            F.length(value),
            F.length(_digits(value)),
            F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
            F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")),
            F.size(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), ""))),
            F.startswith(value, F.lit("+")),
            value.rlike(r"[()\[\]{}]"),
            F.contains(value, F.lit("@")),
            F.length(F.regexp_replace(value, "[^.]", "")),
            F.array_max(F.transform(runs, lambda r: F.length(r))),
            F.size(F.filter(runs, lambda r: F.length(r) > 0)),
            before.rlike(r"(?:^|\s)$"),
            before.rlike(r"[A-Za-z0-9]$"),
            after.rlike(r"^\s?$"),
            after.rlike(r"^[A-Za-z0-9]"),
            before.rlike(CUES),
        )
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees as text, their weights, and the calibrated threshold of each kind."""

    trees: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def score(self, values: list[Column]) -> Column:
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            margin = margin + weight * tree_column(tree, values)
        return 1 / (1 + F.exp(-2 * margin))

    def passes(self, kind: Column, values: list[Column]) -> Column:
        limit = F.element_at(F.array(*(F.lit(t) for t in self.thresholds)), kind + 1)
        return self.score(values) >= limit


def tree_column(description: str, values: list[Column]) -> Column:
    """A fitted tree, as its description prints it, as an expression over the features."""
    lines = [x.strip() for x in description.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    place = 0

    def node() -> Column:
        nonlocal place
        line = lines[place]
        place += 1
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        place += 1  # Else
        return F.when(values[int(feature)] <= float(limit), low).otherwise(node())

    return node()


def train(
    docs: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
) -> Trees | None:
    """Boosted trees that tell personal data from other candidates.

    A candidate is personal data if the base rules confirm it, or do once it is written back to their form
    (``[at]`` to ``@``, separators removed; see `NORMAL`). The trees see neither the rules nor that form, but
    shape and context. The candidates of all documents take part: two thirds fit the trees, and a third is held
    out, where a kind's threshold is the score that ``PASS_BY`` of its other candidates stay below, ``LEAST_SCORE``
    at least; a kind without personal data there adds nothing. None if there are too few of either class.
    """
    seen = with_candidates(with_base(docs.select("doc_id", "text"))).where(F.size("candidates") > 0)
    rows = seen.select("doc_id", "text", "base", F.explode("candidates").alias("span")).select(
        (
            F.exists(
                "base",
                lambda b: (b["kind"] == F.col("span.kind"))
                & (b["start"] == F.col("span.start"))
                & (b["end"] == F.col("span.end")),
            )
            | is_private(F.col("span"))
        ).cast("double").alias("label"),
        F.exists(
            "base", lambda b: (b["start"] < F.col("span.end")) & (F.col("span.start") < b["end"])
        ).alias("known"),
        F.col("span.kind").alias("k"),
        seeded_unit(seed + 1, F.col("doc_id"), F.col("span.start")).alias("u"),
        *(c.alias(name) for c, name in zip(features(F.col("text"), F.col("span")), FEATURES)),
    )
    # A candidate that overlaps a confirmed span of another shape says nothing either way.
    rows = written(rows.where((F.col("label") == 1) | ~F.col("known")), "private-candidates")
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(classes.get(0.0, 0), classes.get(1.0, 0)) < LEAST_EXAMPLES:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed
    ).fit(vectors.where("u < 0.67").select("label", "features"))
    plain = Trees(
        tuple(t.toDebugString for t in model.trees), tuple(model.treeWeights), (0.0,) * len(KINDS)
    )
    held_out = rows.where("u >= 0.67").select(
        "k", "label", plain.score([F.col(c) for c in FEATURES]).alias("score")
    )
    reached = {
        r["k"]: r["others"] or 0.0
        for r in held_out.groupBy("k")
        .agg(
            F.percentile(F.when(F.col("label") == 0, F.col("score")), F.lit(PASS_BY)).alias("others"),
            F.sum("label").alias("n"),
        )
        .where("n > 0")
        .collect()  # one row for each kind
    }
    limits = tuple(max(LEAST_SCORE, reached[k] + 1e-9) if k in reached else 1.1 for k in range(len(KINDS)))
    return Trees(plain.trees, plain.weights, limits)


def find(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end, value), by start, then kind.

    ``spans`` holds the base spans and the candidates the trees select beside them. Of candidates
    that overlap, the best stays; none that overlaps a base span is added. ``docs`` needs a text; other columns
    stay as they are, but for columns called base or spans, which give way. A null text
    is empty and has no span. Equal texts have equal spans.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    inner = with_base(docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "text"))
    if model is None:
        return inner.select("row.*", "base", F.col("base").alias("spans"))
    found = with_candidates(inner).withColumn(
        "candidates",
        F.filter(
            F.col("candidates"),
            lambda c: ~F.exists(
                "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
            ),
        ),
    )
    scored = F.transform(
        F.col("candidates"),
        lambda c: F.struct(
            (-model.score(features(F.col("text"), c))).alias("rank"),
            c["start"].alias("start"),
            c["kind"].alias("kind"),
            c["end"].alias("end"),
            c["value"].alias("value"),
        ),
    )
    limits = F.array(*(F.lit(t) for t in model.thresholds))
    found = found.withColumn(
        "candidates",
        F.when(F.size("candidates") == 0, F.expr("array()").cast(
            "array<struct<rank:double,start:int,kind:int,end:int,value:string>>"
        )).otherwise(
            F.array_sort(F.filter(scored, lambda c: -c["rank"] >= F.element_at(limits, c["kind"] + 1)))
        ),
    )
    none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int,value:string>>")
    added = F.aggregate(
        "candidates",
        none,
        lambda chosen, c: F.when(
            F.exists(chosen, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])), chosen
        ).otherwise(
            F.concat(
                chosen, F.array(F.struct(*(c[x].alias(x) for x in ("start", "kind", "end", "value"))))
            )
        ),
    )
    return found.select("row.*", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(
                ":",
                F.element_at(names, s["kind"] + 1),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.when(
            span["start"] >= state["at"],
            F.struct(
                span["end"].alias("at"),
                F.concat(state["out"], F.array(gap, F.element_at(names, span["kind"] + 1))).alias("out"),
            ),
        ).otherwise(
            F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["out"].alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<string>").alias("out"))
    done = F.aggregate(
        found,
        start,
        step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(found) > 0, done).otherwise(text)
