"""Cross-validated probes: small models that show whether a handicapped view of the data predicts the label."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import learners
from .relational import counts
from .splitting import stem

#: Classes with fewer rows are left out.
LEAST = 5
FOLDS = 5
#: Steps towards the minimum of a model of file names, at most; its ranks hardly change after them.
TEXT_STEPS = 30
#: Rows of a probe of file names, about.
TEXT_SAMPLE = 8_000
#: Rows of a probe, about, whatever the number of classes.
SAMPLE = 20_000
#: How many times the rows wanted of a class are sorted to find those with the smallest hashes.
SPARE = 4


@dataclass(frozen=True)
class ProbeResult:
    auc: float
    balanced_accuracy: float
    n: int
    classes: int


def subsample(df: DataFrame, label: str, most: int, seed: int, *key: str, least: int = LEAST) -> DataFrame:
    """At most ``most`` rows per class, those with the smallest hashes of the key, without classes under ``least`` rows. ``place`` is the row's
    place in its class. Of a class with many more rows only those with small hashes are sorted, in expectation ``SPARE`` times as many as are
    kept."""
    order = [F.xxhash64(F.lit(seed), *key), *map(F.col, key)]
    df = df.where(F.col(label).isNotNull())
    enough = counts(df, label, name="_n").where(F.col("_n") >= least)
    df = df.join(enough, label)
    low = F.shiftrightunsigned(order[0], 1) / F.lit(float(2**63)) <= F.lit(float(SPARE * most)) / F.col("_n")
    return df.where(low).withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(F.shiftrightunsigned(order[0], 1), *order[1:]))).where(F.col("place") <= most).drop("_n")


def _fold(fit):
    """The predictions for one fold of the model fitted on the others; a partition holds the sample of one run."""

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        t = t.take(pc.sort_indices(t, [("label", "ascending"), ("place", "ascending")]))  # whatever order the rows came in
        names, y = np.unique(np.array(t.column("label").to_pylist(), object).astype(str), return_inverse=True)
        if len(names) < 2:
            return
        held = t.column("place").to_numpy() % FOLDS == t.column("run")[0].as_py()
        x = t.column("x").combine_chunks().to_pylist()
        p = fit([v for v, h in zip(x, held) if not h], y[~held], len(names), [v for v, h in zip(x, held) if h])
        yield pa.RecordBatch.from_arrays([pa.array(y[held], pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], ["y", "p"])

    return run


def _scores(batches):
    batches = [b for b in batches if b.num_rows]
    if batches:
        t = pa.Table.from_batches(batches)
        y, p = t.column("y").to_numpy(), np.stack(t.column("p").to_numpy())
        k = p.shape[1]
        auc = learners.area(p[:, 1], y == 1) if k == 2 else float(np.mean([learners.area(p[:, c], y == c) for c in range(k)]))
        recall = float(np.mean([(p[y == c].argmax(1) == c).mean() for c in range(k)]))
        yield pa.RecordBatch.from_arrays([pa.array([auc]), pa.array([recall]), pa.array([len(y)]), pa.array([k], pa.int32())], ["auc", "balanced_accuracy", "n", "classes"])


def probe(df: DataFrame, key: str, label: str, x: Column, fit, seed: int = 42, most: int = 2000, sample: int | None = None) -> ProbeResult | None:
    """Five-fold cross-validation in one job: the five models are fitted at once, each in a task that holds the sample. ``fit`` takes the values of ``x`` and the
    numbers of the classes of some rows, the number of classes, and values of other rows, and returns their probabilities. The result has
    the area under the curve (of the second class, or the mean over one class against the rest) and the mean recall of the classes, both out
    of fold. Null with fewer than two classes of at least five rows. Bounded: at most ``most`` rows of each class, and about ``sample`` (by default
    ``SAMPLE``) of all, are used, or five of each where there are very many classes."""
    rows = df.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), x.alias("x")).where("x IS NOT NULL")
    classes = rows.select("label").distinct().count()
    rows = subsample(rows, "label", max(LEAST, min(most, (sample or SAMPLE) // max(1, classes))), seed, "key")
    runs = rows.select("label", "place", "x", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("run"))
    predicted = runs.repartitionById(FOLDS, "run").mapInArrow(_fold(fit), "y int, p array<double>")
    r = predicted.repartition(1).mapInArrow(_scores, "auc double, balanced_accuracy double, n long, classes int").first()
    return ProbeResult(*r) if r else None


def numeric_probe(df: DataFrame, key: str, label: str, features: dict[str, Column], seed: int = 42, most: int = 2000) -> ProbeResult | None:
    """Boosted trees over numeric features; a missing or NaN value goes to the side that suits."""
    x = F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in features.values()])
    fit = lambda a, y, k, b: learners.boosted(np.array(a, float), y, k, np.array(b, float), seed)
    return probe(df, key, label, x, fit, seed, most)


def vector_probe(df: DataFrame, key: str, label: str, vector: str, seed: int = 42, most: int = 2000) -> ProbeResult | None:
    """A scaled, regularised linear model over an array column; rows without an array are left out."""

    def fit(a, y, k, b):
        a, b = learners.scaled(np.array(a, float), np.array(b, float))
        return learners.linear(a, y, k, b, 0.1)

    return probe(df, key, label, F.col(vector).cast("array<double>"), fit, seed, most)


def codes(c: Column, df: DataFrame, most: int = 250) -> tuple[DataFrame, Column]:
    """The alphabetical number of a category, null being "(none)", at most ``most``: ``df`` joined with the numbers and their column. Numbers
    beyond ``most`` are equal, so only the first values are ordered."""
    text = F.coalesce(c.cast("string"), F.lit("(none)"))
    firsts = df.select(text.alias("_v")).distinct().orderBy("_v").limit(most)
    numbered = firsts.withColumn("_code", F.row_number().over(Window.orderBy("_v")) - 1)  # at most `most` rows
    name = f"_code_{abs(hash(str(c))) % 10**8}"
    joined = df.withColumn("_v", text).join(F.broadcast(numbered), "_v", "left").withColumn(name, F.coalesce("_code", F.lit(most)).cast("double")).drop("_v", "_code")
    return joined, F.col(name)


# File names


def name_tokens(path: Column) -> Column:
    """The runs of letters a to z in the lower-case stem, once each."""
    return F.array_distinct(F.regexp_extract_all(F.lower(stem(path)), F.lit("([a-z]+)"), F.lit(1)))


def naming_tokens(df: DataFrame, path: str, label: str) -> DataFrame:
    """token: tokens in at least 90 % of the file names of one class and under 10 % of the others', and the tokens of the labels."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), name_tokens(F.col(path)).alias("tokens"))
    size = counts(rows, "label", name="size")
    whole = size.agg(F.sum("size").alias("whole"))
    n = rows.select("label", F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    every = n.groupBy("token").agg(F.sum("n").alias("every"))
    x = n.join(size, "label").where(F.col("n") >= 0.9 * F.col("size")).join(every, "token").join(F.broadcast(whole))
    rest = F.col("whole") - F.col("size")
    marks = x.where((rest == 0) | ((F.col("every") - F.col("n")) < 0.1 * rest)).select("token")
    own = size.select(F.explode(F.regexp_extract_all(F.lower("label"), F.lit("([a-z]+)"), F.lit(1))).alias("token"))
    return marks.union(own).distinct()


def without_tokens(path: Column, tokens: list[str]) -> Column:
    """The lower-case stem with each of the tokens, where it is a whole run of letters, replaced by a blank."""
    text = F.lower(stem(path))
    if not tokens:
        return text
    alternatives = "|".join(sorted(tokens, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?<![a-z])(?:{alternatives})(?![a-z])", " ")


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """The runs of 2 to 4 characters of each word, which is padded by blanks; a word shorter than the run gives the whole padded word once."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    runs = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array(w) if n == low else F.array().cast("array<string>"))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[runs(w, n) for n in range(low, high + 1)])))


def filename_probe(df: DataFrame, key: str, label: str, path: str, tokens: list[str], seed: int = 42, most: int = 2000) -> ProbeResult | None:
    """A linear model over the weighted character runs of the file names without ``tokens``."""

    def fit(a, y, k, b):
        a, b = learners.weighted_runs([learners.runs_of(t) for t in a], [learners.runs_of(t) for t in b])
        return learners.linear(a, y, k, b, 1.0, TEXT_STEPS)

    return probe(df, key, label, without_tokens(F.col(path), tokens), fit, seed, most, TEXT_SAMPLE)
