"""Training-set studies: how scores change with the size and the class mix of the training set.

Every draw puts each class in a seeded order. The last fifth of each class's order is held out; the
others are taken from the front, so a larger sample holds the smaller ones of the same draw, and a
sample of any size and mix is a prefix of both classes. One pass sums the features of every draw's
blocks of ``STEP`` rows; running sums over the blocks are the statistics of every prefix, from which a
model that follows from such sums (naive Bayes, or the null model) is had without another pass. A second pass
scores the held-out rows by the models of their draw.

The sums that come to the driver are one row for each draw, class and block of the samples asked for, so this way is
for a number of samples that doesn't grow with the rows (the class mixes). A learning curve has a size for every few
rows: its models and counts stay in tasks, each for a run of ``RUN`` sizes of a draw and a block of held-out rows of
either class (``curve_counts``). Its scores are sizes times held-out rows, so its work is quadratic in the rows.

The recipe is that of all training rows. Ids repeat as rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.models import crossfit
from litsift.models.classifiers import _NullModel, nb_model
from litsift.operators import evaluate
from litsift.operators.prefix import grouped_row_number
from litsift.operators.scalars import with_group_values
from litsift.session import ensure_checkpoint_dir

#: Rows of a block: sizes are multiples of it.
STEP = 10
#: Sizes of a learning curve whose models one task has, and held-out rows of either class that it scores by them.
RUN, HELD = 1024, 50_000
#: Rows made dense at once, and sizes whose scores a task holds at once.
CHUNK, SCORED = 1024, 64


def ordered_draws(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """(row, draw, class, rank, n): each row's place in its class's order of every draw, and the class's size."""
    each = rows.select("row", "pmid", "class", F.explode(F.sequence(F.lit(seed), F.lit(seed + draws - 1))).alias("draw"))
    key = F.md5(F.concat(F.col("pmid").cast("string"), F.lit(":"), F.col("draw").cast("string")))
    each = each.select("row", "draw", "class", key.alias("h"))
    ranked = grouped_row_number(each, ["draw", "class"], [F.col("h"), F.col("row")], name="rank")
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return with_group_values(ranked, sizes, ["class"]).drop("h")


def split_sizes(train: DataFrame) -> dict[str, int]:
    """Rows of each class that samples can be taken from: all but the held-out fifth, whole blocks."""
    counts = {r["class"]: r["n"] for r in train.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: (n - n // 5) // STEP * STEP for c, n in counts.items()}


def _feature_rows(train: DataFrame, stem: bool) -> tuple[DataFrame, int]:
    """(row, pmid, class, features) of the training rows under the recipe of all of them, and its terms."""
    ensure_checkpoint_dir(train.sparkSession)
    design = crossfit.Design(train, v=0, stem=stem)
    try:
        fz = design.recipes[crossfit.WHOLE].featurizer()
        return fz.transform(design.tokens.withColumn("row", F.monotonically_increasing_id())) \
            .select("row", "pmid", "class", "features").checkpoint(), fz.size
    finally:
        design.release()


def held_out_scores(train: DataFrame, samples: list[tuple[int, int]], model: str = "nb", draws: int = 10, seed: int = 42,
                    stem: bool = True) -> DataFrame:
    """(draw, n_pos, n_neg, class, p_positive) of each draw's held-out rows, by the model of each sample.

    ``samples`` are numbers of positive and negative training rows, multiples of ``STEP``.
    """
    if any(a % STEP or b % STEP for a, b in samples):
        raise ValueError(f"sizes are multiples of {STEP}")
    spark = train.sparkSession
    rows, size = _feature_rows(train, stem)
    most = {"Positive": max((a for a, _ in samples), default=0), "Negative": max((b for _, b in samples), default=0)}
    placed = ordered_draws(rows, draws, seed)
    train_rank = F.when(F.col("class") == "Positive", most["Positive"]).otherwise(most["Negative"])
    used = placed.filter((F.col("rank") <= train_rank) & (F.col("rank") <= F.col("n") - F.floor(F.col("n") / 5)))
    sums = used.join(rows.select("row", "features"), "row").groupBy(
        "draw", "class", F.floor((F.col("rank") - 1) / STEP).cast("int").alias("block")).agg(
            Summarizer.metrics("count", "sum", "normL2").summary(F.col("features")).alias("s")) \
        .select("draw", "class", "block", "s.*").collect() if size else []
    blocks = {(r.draw, r["class"], r.block): (r["count"], r["sum"].toArray(), r["normL2"].toArray() ** 2) for r in sums}
    models: dict[int, list[tuple]] = {}
    for draw in range(seed, seed + draws):
        prefix = {c: _prefixes(blocks, draw, c, most[c] // STEP, size) for c in most}
        models[draw] = []
        for n_pos, n_neg in samples:
            pos, neg = prefix["Positive"][n_pos // STEP], prefix["Negative"][n_neg // STEP]
            n = pos.n + neg.n
            null = model == "null" or not pos.n or not neg.n
            fitted = _NullModel(pos.n / n if n else 0.5) if null else nb_model(neg, pos)
            models[draw].append(fitted.arrays())
    sent = spark.sparkContext.broadcast(models)
    wanted = list(samples)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                draw = part.column("draw").to_numpy()
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                p = np.zeros((part.num_rows, len(wanted)))
                for d in np.unique(draw).tolist():
                    own = np.flatnonzero(draw == d)
                    for j, (kind, *values) in enumerate(sent.value[d]):
                        if kind == "prior":
                            p[own, j] = values[0]
                            continue
                        z = x[own] @ values[0] + values[1] + (x[own] ** 2) @ values[2]
                        p[own, j] = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, len(wanted)), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("class"), flat], ["draw", "class", "p"])

    held = placed.filter(F.col("rank") > F.col("n") - F.floor(F.col("n") / 5)).join(rows.select("row", "features"), "row")
    found = held.select("draw", "class", vector_to_array("features").alias("x")).mapInArrow(
        score, "draw int, class string, p array<double>")
    names = F.array(*[F.struct(F.lit(a).alias("n_pos"), F.lit(b).alias("n_neg")) for a, b in wanted])
    return found.select("draw", "class", F.posexplode("p").alias("at", "p_positive")).select(
        "draw", F.get(names, "at").getField("n_pos").alias("n_pos"), F.get(names, "at").getField("n_neg").alias("n_neg"),
        "class", "p_positive")


def _prefixes(blocks: dict, draw: int, label: str, count: int, size: int) -> list[SimpleNamespace]:
    """Moments of the first 0, 1, ... blocks of one class of a draw."""
    n, total, square = 0, np.zeros(size), np.zeros(size)
    out = []
    for b in range(count + 1):
        out.append(SimpleNamespace(n=n, mean=total / max(n, 1), square=square / max(n, 1)))
        more = blocks.get((draw, label, b))
        if more is not None:
            n, total, square = n + int(more[0]), total + more[1], square + more[2]
    return out


def curve_counts(train: DataFrame, sizes: list[int], model: str = "nb", draws: int = 10, seed: int = 42,
                 stem: bool = True) -> DataFrame:
    """(draw, size, won, tp, fp, tn, fn, n1, n0): parts of the counts that a draw's held-out rows give by each size's model.

    ``sizes``, ascending, are training rows of each class. ``won`` counts pairs of a positive and a negative held-out row
    with the higher score on the positive one, ties by half; the other counts are of rows. Parts add up.

    A task has a run of sizes and a block of the held-out rows of either class, so every pair of rows meets in one task.
    It gets the training rows of its run and the moments of all earlier ones, and makes the models itself.
    """
    rows, size = _feature_rows(train, stem)
    placed = ordered_draws(rows.filter(F.col("class").isNotNull()), draws, seed).withColumn("positive", F.col("class") == "Positive")
    held = {r["class"]: r["n"] // 5 for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect() if r["class"] is not None}
    n_i = max(1, -(-held.get("Positive", 0) // HELD))
    n_j = max(1, -(-max((n for c, n in held.items() if c != "Positive"), default=0) // HELD))
    width, at_once = RUN, SCORED
    ends = [sizes[min(a + RUN, len(sizes)) - 1] for a in range(0, len(sizes), RUN)]

    def every(n: int, first: int = 0):
        return F.sequence(F.lit(first), F.lit(n - 1))

    vector = F.unwrap_udt("features") if size else None
    term = vector["indices"] if size else F.array().cast("array<int>")
    value = vector["values"] if size else F.array().cast("array<double>")
    with_features = placed.join(rows.select("row", "features"), "row")
    train_rows = F.col("n") - F.floor(F.col("n") / 5)
    place = F.col("rank") - train_rows - 1
    block = F.floor(place / HELD).cast("int")
    tested = with_features.filter(place >= 0).select(
        "draw", "positive", term.alias("term"), value.alias("value"), F.explode(every(len(ends))).alias("run"),
        block.alias("block")).select(
            "*", F.explode(F.when(F.col("positive"), every(n_j)).otherwise(every(n_i))).alias("other")).select(
                "draw", "run", F.when(F.col("positive"), F.col("block")).otherwise(F.col("other")).alias("i"),
                F.when(F.col("positive"), F.col("other")).otherwise(F.col("block")).alias("j"),
                F.lit("tested").alias("kind"), "positive", F.lit(1).cast("long").alias("rank"), "term", "value",
                F.array().cast("array<double>").alias("square"))
    parts = tested
    if size:
        in_run = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col("rank")))
        used = with_features.filter((place < 0) & (F.col("rank") <= ends[-1]) & F.col("class").isin("Positive", "Negative")) \
            .withColumn("run", in_run)
        pairs = used.select("draw", "run", "positive", "rank", term.alias("term"), value.alias("value")).select(
            "*", F.explode(every(n_i)).alias("i")).select("*", F.explode(every(n_j)).alias("j"))
        parts = parts.unionByName(pairs.select(
            "draw", "run", "i", "j", F.lit("used").alias("kind"), "positive", F.col("rank").cast("long").alias("rank"), "term", "value",
            F.array().cast("array<double>").alias("square")))
        if len(ends) > 1:
            sums = used.filter(F.col("run") < len(ends) - 1).groupBy("draw", "positive", "run").agg(
                Summarizer.metrics("count", "sum", "normL2").summary(F.col("features")).alias("s"))
            later = sums.select("draw", "positive", "s.count", vector_to_array("s.sum").alias("value"),
                                F.transform(vector_to_array("s.normL2"), lambda x: x * x).alias("square"),
                                F.explode(F.sequence(F.col("run") + 1, F.lit(len(ends) - 1))).alias("run"))
            later = later.select("*", F.explode(every(n_i)).alias("i")).select("*", F.explode(every(n_j)).alias("j"))
            parts = parts.unionByName(later.select(
                "draw", "run", "i", "j", F.lit("earlier").alias("kind"), "positive", F.col("count").cast("long").alias("rank"),
                F.array().cast("array<int>").alias("term"), "value", "square"))

    def run(table: pa.Table) -> pa.Table:
        draw, at, i, j = (table.column(c)[0].as_py() for c in ("draw", "run", "i", "j"))
        own = sizes[at * width:(at + 1) * width]
        models = [f.arrays() for f in _models_of(table, own, size, model)]
        scored = {c: _Sparse(_of(table, "tested", c)) for c in (True, False)}
        out = {c: [] for c in ("won", "tp", "fp", "tn", "fn")}
        for a in range(0, len(own), at_once):
            pos, neg = (scored[c].scores(models[a:a + at_once], size) for c in (True, False))
            for p, q in zip(pos, neg, strict=True):
                p, q = np.sort(p[~np.isnan(p)]), np.sort(q[~np.isnan(q)])
                below = np.searchsorted(p, q, "left").sum() + np.searchsorted(p, q, "right").sum()
                out["won"].append((2 * len(p) * len(q) - int(below)) / 2)
                tp, fp = (len(x) - int(np.searchsorted(x, evaluate.THRESHOLD, "left")) for x in (p, q))
                for c, n in (("tp", tp * (j == 0)), ("fn", (len(p) - tp) * (j == 0)), ("fp", fp * (i == 0)), ("tn", (len(q) - fp) * (i == 0))):
                    out[c].append(n)
        return pa.table({"draw": pa.array([draw] * len(own), pa.int32()), "size": pa.array(own, pa.int32()),
                         "won": pa.array(out.pop("won"), pa.float64()), **{c: pa.array(v, pa.int64()) for c, v in out.items()}})

    found = parts.groupBy("draw", "run", "i", "j").applyInArrow(run, "draw int, size int, won double, tp long, fp long, tn long, fn long")
    return found.select("*", (F.col("tp") + F.col("fn")).alias("n1"), (F.col("fp") + F.col("tn")).alias("n0"))


def _of(table: pa.Table, kind: str, positive: bool) -> pa.Table:
    mine = pc.equal(table.column("kind"), kind)
    return table.filter(pc.and_(mine, table.column("positive") if positive else pc.invert(table.column("positive"))))


class _Sparse:
    """Sparse rows of a table, made dense ``CHUNK`` at a time."""

    def __init__(self, table: pa.Table):
        term, value = (table.column(c).combine_chunks() for c in ("term", "value"))
        self.n = table.num_rows
        self.ends = np.concatenate([[0], np.cumsum(pc.list_value_length(term).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.term, self.value = term.flatten().to_numpy(), value.flatten().to_numpy()

    def scores(self, models: list[tuple], size: int) -> np.ndarray:
        """The probability of each row by each model, a row for each model.

        Every product has ``CHUNK`` rows, so that equal rows get equal scores wherever they lie.
        """
        out = np.zeros((len(models), self.n))
        linear = [k for k, m in enumerate(models) if m[0] != "prior"]
        for k, m in enumerate(models):
            if m[0] == "prior":
                out[k] = m[1]
        if not linear:
            return out
        w, b, q = (np.array([models[k][v] for k in linear]) for v in (1, 2, 3))
        x = np.zeros((CHUNK, size))
        for a in range(0, self.n, CHUNK):
            n = min(CHUNK, self.n - a)
            here = self.ends[a:a + n + 1]
            x[:] = 0.0
            x[np.repeat(np.arange(n), np.diff(here)), self.term[here[0]:here[-1]]] = self.value[here[0]:here[-1]]
            z = w @ x.T + b[:, None] + q @ (x * x).T
            out[linear, a:a + n] = (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))[:, :n]
        return out


def _models_of(table: pa.Table, sizes: list[int], size: int, model: str) -> Iterator:
    """The model of each size of a run, from its training rows and the moments of the earlier ones."""
    moments = {}
    for positive in (True, False):
        own, before = _of(table, "used", positive), _of(table, "earlier", positive)
        x, at = _Sparse(own), np.searchsorted(sizes, own.column("rank").to_numpy())
        cell = np.repeat(at, np.diff(x.ends)) * size + x.term
        n = np.bincount(at, minlength=len(sizes)).cumsum() + sum(before.column("rank").to_pylist())
        total, square = (np.bincount(cell, v, len(sizes) * size).reshape(len(sizes), size).cumsum(0) for v in (x.value, x.value ** 2))
        for k in range(before.num_rows):
            total, square = total + before.column("value")[k].values.to_numpy(), square + before.column("square")[k].values.to_numpy()
        many = np.maximum(n, 1)[:, None]
        moments[positive] = n, total / many, square / many
    for k in range(len(sizes)):
        pos, neg = (SimpleNamespace(n=int(n[k]), mean=mean[k], square=square[k]) for n, mean, square in (moments[True], moments[False]))
        n = pos.n + neg.n
        null = model == "null" or not pos.n or not neg.n
        yield _NullModel(pos.n / n if n else 0.5) if null else nb_model(neg, pos)


def _over_draws(by_draw: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return by_draw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_draws"), *[
        f(F.col(v)).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def learning_curve(train: DataFrame, start: int = 50, step: int = 10, stop: int | None = None, model: str = "nb",
                   draws: int = 10, seed: int = 42, stem: bool = True) -> DataFrame:
    """Held-out AUC and accuracy by rows of each class, mean and spread over draws of other rows.

    Sizes run from ``start`` by ``step`` to ``stop``, or to what the smaller class holds.
    """
    sizes = split_sizes(train)
    most = min(sizes.get("Positive", 0), sizes.get("Negative", 0))
    wanted = list(range(start, min(stop or most, most) + 1, step))
    if not wanted:
        return train.sparkSession.createDataFrame([], "size int, n_draws long, mean_auc double, sd_auc double, "
                                                      "mean_accuracy double, sd_accuracy double")
    counts = curve_counts(train, wanted, model, draws, seed, stem).checkpoint()
    auc = evaluate.auc_of_pairs(counts, ["draw", "size"]).select("draw", "size", "auc")
    hit = evaluate.confusion_of_counts(counts, ["draw", "size"]).select("draw", "size", "accuracy")
    return _over_draws(hit.join(auc, ["draw", "size"], "left"), ["size"], ["auc", "accuracy"])


def class_mix(train: DataFrame, total: int = 750, step: int = 10, model: str = "nb", draws: int = 10, seed: int = 42,
              stem: bool = True) -> DataFrame:
    """F1 of both classes by class mix at one training-set size, mean and spread over draws.

    Positive rows run from ``step`` to ``total - step``. Where a class can't fill all of them, the total
    for every mix is what the smaller class and one block of the other hold.
    """
    sizes = split_sizes(train)
    total = min(total, min(sizes.get("Positive", 0), sizes.get("Negative", 0)) + step) // STEP * STEP
    mixes = [(n, total - n) for n in range(step, total, step)]
    if not mixes:
        return train.sparkSession.createDataFrame([], "n_pos int, n_neg int, n_draws long, mean_f_positive double, "
                                                      "sd_f_positive double, mean_f_negative double, sd_f_negative double")
    keys = ["draw", "n_pos", "n_neg"]
    scores = held_out_scores(train, mixes, model, draws, seed, stem)
    by_draw = evaluate.f_by_class(scores, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("class") == "Positive", F.col("f_score"))).alias("f_positive"),
        F.max(F.when(F.col("class") == "Negative", F.col("f_score"))).alias("f_negative"))
    return _over_draws(by_draw, ["n_pos", "n_neg"], ["f_positive", "f_negative"])
