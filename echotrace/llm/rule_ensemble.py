"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``statistics`` measures every text with Spark column expressions (lengths,
   shares of symbols, capitals and digits, repetition of words and lines, ...).
2. A random forest of shallow trees is grown on a bounded sample of labelled
   texts; every path from a root to a node is a conjunctive rule: an interval for
   each statistic that it asks about.
3. A logistic regression with lasso penalty over the rules' truth values gives
   most rules weight zero; the others are the model.
4. The model is compiled into one Spark column expression over the statistics, so
   scoring is a projection: no Python, no shuffle, nothing broadcast.

Bounded sample (documented parameter): ``sample_docs`` labelled ids in the order of
their hash; their statistics are all that the fit sees.  Only a document's text
counts: labels, languages, sources and ids are no inputs.

Defined results: a null or empty text has statistics of zero (distinct shares of
one) and gets the score that the rules give these; repeated rows get equal scores;
an empty table gives an empty result; labels that are null or not 0/1 are ignored,
a document with several labels is poor if one of them says so, and of several texts
with one id the one with the least statistics is learned from; without labels of both
classes the score is the share of good ones (0.5 without any).  A hot id or group of
copies is map-side combined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.llm.common import cut

_SPACE = r"[\x20\x09-\x0D]+"
#: Fixed names of the statistics columns.
STATISTICS = ("n_words", "n_lines", "word_length", "line_words", "symbols", "exclaims", "pipes", "capitals", "digits",
              "letters", "sentence_ends", "commas", "distinct_words", "distinct_lines", "doubled_words")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with a double ``stat_<name>`` for each of ``STATISTICS``.

    The arrays of words and lines and the plain sums are projections of their own:
    each is computed once a row, however many statistics and rules refer to it.
    """
    rest = [c for c in docs.columns if c != text]
    t = F.col("_text")
    arrays = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        *rest, "_text", F.array_remove(F.split(t, _SPACE), "").alias("_words"), F.split(t, "\n").alias("_lines"))

    def without(pattern: str) -> Column:  # characters that match
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    def single(mark: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))

    sums = arrays.select(
        *rest, F.length(t).alias("_chars"), F.size("_words").alias("_n"), F.size("_lines").alias("_l"),
        F.size(F.array_distinct("_words")).alias("_dw"), F.size(F.array_distinct("_lines")).alias("_dl"),
        without(r"[#*$%&<>{}\[\]~^=+\\]+").alias("_symbols"), single("!").alias("_exclaims"), single("|").alias("_pipes"),
        without(r"[A-Z\xC0-\xDE]+").alias("_capitals"), without("[0-9]+").alias("_digits"), without(r"[\p{L}]+").alias("_letters"),
        without("[.?]+").alias("_ends"), single(",").alias("_commas"), without(_SPACE).alias("_space"),
        F.regexp_count(t, F.lit(r"(?<!\S)(\S++)\s\1(?!\S)")).alias("_doubled"))

    def share(part: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of)), F.lit(0.0))

    values = {
        "n_words": F.col("_n").cast("double"), "n_lines": F.col("_l").cast("double"),
        "word_length": F.coalesce(F.try_divide((F.col("_chars") - F.col("_space")).cast("double"), F.col("_n")), F.lit(0.0)),
        "line_words": share("_n", "_l"), "symbols": share("_symbols", "_chars"), "exclaims": share("_exclaims", "_n"),
        "pipes": share("_pipes", "_n"), "capitals": share("_capitals", "_letters"), "digits": share("_digits", "_chars"),
        "letters": share("_letters", "_chars"), "sentence_ends": share("_ends", "_n"), "commas": share("_commas", "_n"),
        "distinct_words": F.when(F.col("_n") > 0, share("_dw", "_n")).otherwise(1.0),
        "distinct_lines": share("_dl", "_l"), "doubled_words": share("_doubled", "_n"),
    }
    return sums.select(*rest, *[values[k].alias(f"stat_{k}") for k in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """All of ``low < statistic <= high``; an open side is infinite."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low != float("-inf"):
                out = out & (F.col(f"stat_{name}") > F.lit(low))
            if high != float("inf"):
                out = out & (F.col(f"stat_{name}") <= F.lit(high))
        return out

    def holds(self, values: dict[str, float]) -> bool:
        return all(low < values[name] <= high for name, low, high in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of good quality over the statistics columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", sample_docs: int = 20_000) -> DataFrame:
    """Statistics and ``label`` of at most ``sample_docs`` labelled documents (``labels``: doc_id, quality)."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
                   .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label")))
    picked = (known.join(docs.select("doc_id"), "doc_id", "left_semi")
                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    some = docs.select("doc_id", text).join(F.broadcast(picked), "doc_id")  # at most sample_docs ids
    names = [f"stat_{k}" for k in STATISTICS]
    one = statistics(some, text).groupBy("doc_id", "label").agg(F.min(F.struct(*names)).alias("s"))
    return one.select("label", *[F.col(f"s.{c}") for c in names])


def tree_rules(forest) -> list[Rule]:
    """The path to every node of every tree, each rule once; of a root's two sides only the first."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]], keep: bool) -> None:
        if bounds and keep:
            found.setdefault(Rule(tuple((k, *bounds[k]) for k in STATISTICS if k in bounds)))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, at = STATISTICS[split.featureIndex()], split.threshold()
        low, high = bounds.get(name, (float("-inf"), float("inf")))
        walk(node.leftChild(), bounds | {name: (low, min(high, at))}, True)
        walk(node.rightChild(), bounds | {name: (max(low, at), high)}, bool(bounds))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {}, False)
    return list(found)


def fit(rows: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.001, rounds: int = 50,
        seed: int = 7) -> RuleModel:
    """Rules and weights from ``training_rows``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = cut(rows)
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).collect()[0]
    if not n or good in (0, n):
        return RuleModel(0.0 if not n else math.inf if good else -math.inf, ())
    few = rows.coalesce(4)  # a bounded sample
    vectors = few.select("label", array_to_vector(F.array(*[f"stat_{k}" for k in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird",
                                    maxBins=64, minInstancesPerNode=5, seed=seed).fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        return RuleModel(math.log(good / (n - good)), ())
    truth = cut(few.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=rounds).fit(truth)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights) if w))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample_docs: int = 20_000, **options) -> RuleModel:
    return fit(training_rows(docs, labels, text, sample_docs), **options)


def classify(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs`` but the text (and columns named like results) with ``score`` and ``predicted``."""
    rest = [c for c in docs.columns if c not in ("score", "predicted", text) and not c.startswith("stat_")]
    found = statistics(docs.select(*rest, text), text).select(*rest, model.score().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether a row's label is kept for testing: crc32 of the id as text is divisible by ``parts``; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))
