"""URL filters: fixed rules first, then the ratio of two character language models.

The rules decide the URLs that they fit, and these URLs are what the models learn from: one
variable-order Markov model of the accepted, one of the rejected. A character's chance after
``ORDER`` characters is smoothed by the chance after one fewer, down to a uniform one, weighted by how
many different characters followed (Witten and Bell), so a context that was never seen leaves it to
the next shorter one. A URL's score is the difference of both log-likelihoods for each
character. Every distinct URL counts once. A quarter of the ruled URLs, by their digest, is held
out of the counts; on them the threshold is set where the shares of wrongly rejected and
wrongly accepted URLs have the least sum.

Only DataFrame functions run here. Counts are kept of whole grams, which all shorter contexts
are summed up from. Scores meet the grams of each URL by a join: grams and URLs that make up more than one in
``HOT`` of all, of which there are ``HOT`` at most, are broadcast, the others are shuffled.

A null URL is an empty one. It has neither host nor path, so no rule fits it and it is scored by
the end mark alone. Without accepted or without rejected URLs the other model stands against a
uniform one, with a threshold of 0; without either every score is 0 and allowed. Repeated rows and
null ids are judged one by one. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup

#: Characters of the longest context.
ORDER = 4
#: Of the hexadecimal digits that a URL's digest can begin with, those of the held-out URLs.
HELD = "0123"
#: The uniform chance of a character: there are that many code points.
SYMBOLS = 0x110000
#: Log-likelihood ratios are summed as whole numbers of this part of a nat, so sums have no order.
UNIT = 1e-9
#: Thresholds are whole thousandths of a nat for each character.
CELL = 1e-3
#: Keys that make up at least one in so many rows are broadcast; there can't be more of them than that.
HOT = 4096

#: Fixed rules: host, path, whether to allow.
RULES = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True),
         ("net", "/es/", False), ("net", "/fr/", False)]

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_START, _END = "\u0002", "\u0003"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _A_TO_Z, _A_TO_Z.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, bool]] = RULES) -> tuple[Column, Column]:
    """The longest rule, as host and path together, that fits, and whether it allows; null if none does."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for own_host, own_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        name = F.when(fits, F.lit(own_host + own_path)).otherwise(name)
        allow = F.when(fits, F.lit(verdict)).otherwise(allow)
    return name, allow


# ------------------------------------------------------------------ language models


def grams(text: Column, order: int = ORDER) -> Column:
    """Each character and the end mark, with the ``order`` characters before it."""
    padded = F.concat(F.array_repeat(F.lit(_START), order), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
                      F.array(F.lit(_END)))
    return F.transform(F.array(padded), lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p) - order), lambda i: F.array_join(F.slice(p, i, order + 1), "")))[0]


def count_grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, accepted, rejected, uses) of (text, accepted, held): counts for both models, and all uses."""
    each = urls.select("accepted", "held", F.explode(grams(F.col("text"), order)).alias("gram"))
    learn = ~F.col("held") & F.col("accepted").isNotNull()
    return each.groupBy("gram").agg(F.count_if(learn & F.col("accepted")).alias("accepted"),
                                    F.count_if(learn & ~F.col("accepted")).alias("rejected"),
                                    F.count(F.lit(1)).alias("uses"))


def gram_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, uses, ratio): the log of both models' ratio, in whole units, of each gram's last character."""
    levels = [counts.select(F.col("gram").alias("key"), "accepted", "rejected")]
    for _ in range(order):
        shorter = levels[-1].groupBy(F.expr("substring(key, 2)").alias("key"))
        levels.append(shorter.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    chances = None
    for k, level in enumerate(reversed(levels)):
        level = level.withColumn("context", F.expr(f"substring(key, 1, {k})"))
        contexts = level.groupBy("context").agg(*[x for c in ("accepted", "rejected") for x in (
            F.sum(c).alias(f"{c}_all"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))])
        level = level.join(contexts, "context").withColumn("shorter", F.expr("substring(key, 2)"))
        if chances is None:
            level = level.withColumns({f"low_{c}": F.lit(1.0 / SYMBOLS) for c in ("accepted", "rejected")})
        else:
            level = level.join(chances, "shorter")
        level = level.select("key", *[F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"low_{c}"))
                                             / (F.col(f"{c}_all") + F.col(f"{c}_kinds")))
                                      .otherwise(F.col(f"low_{c}")).alias(f"low_{c}") for c in ("accepted", "rejected")])
        chances = level.withColumnRenamed("key", "shorter")
    ratio = F.round((F.log("low_accepted") - F.log("low_rejected")) / F.lit(UNIT)).cast("long")
    return counts.select("gram", "uses").join(chances.select(F.col("shorter").alias("gram"), ratio.alias("ratio")), "gram")


# ------------------------------------------------------------------ the threshold and verdicts


def threshold(scored: DataFrame) -> int:
    """The least cell to allow, from (accepted, held, cell): least sum of both error shares, then nearest 0.

    The cells are bounded by the smoothing (no ratio leaves +-40 nats), and so are the rows here.
    """
    from pyspark.sql import Window

    cells = scored.filter("held and accepted is not null").groupBy("cell").agg(
        F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    far = cells.agg(F.max("cell").alias("cell")).filter("cell is not null")
    cells = cells.unionByName(far.select((F.greatest(F.col("cell"), F.lit(-1)) + 1).alias("cell"),
                                         F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad")))
    by = Window.orderBy("cell")
    cells = cells.select(
        F.coalesce(F.greatest(F.least(F.col("cell"), F.lit(0)), F.lag("cell").over(by) + 1),
                   F.least(F.col("cell"), F.lit(0))).alias("at"),
        (F.coalesce(F.try_divide(F.sum("good").over(by) - F.col("good"), F.sum("good").over(Window.partitionBy())), F.lit(0.0))
         + F.coalesce(F.try_divide(F.sum("bad").over(Window.partitionBy()) - F.sum("bad").over(by) + F.col("bad"),
                                   F.sum("bad").over(Window.partitionBy())), F.lit(0.0))).alias("loss"))
    best = cells.orderBy("loss", F.abs("at"), "at").first()
    return 0 if best is None else best["at"]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: Sequence[tuple[str, str, bool]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, allow, score, by_model) of every row.

    ``allow`` is the rule's verdict, else the model's; ``score`` the log-likelihood difference in
    nats a character, ``by_model`` what the model alone says.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urlfilter")
    text = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), text.alias("text"))

    urls = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    accepted = rule_of(*parts(F.col("text")), rules)[1]
    urls = urls.select("text", "copies", accepted.alias("accepted"),
                       F.substring(F.md5("text"), 1, 1).isin(*HELD).alias("held"), F.monotonically_increasing_id().alias("number"))
    urls = scratch.keep(urls, "urls")
    counts = scratch.keep(count_grams(urls), "counts")
    scores = scratch.keep(gram_scores(counts), "scores")
    used = lookup(urls.select("number", F.explode(grams(F.col("text"))).alias("gram")), scores, "gram", "uses", HOT)
    sums = used.groupBy("number").agg(F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("symbols"))
    cell = F.floor(F.col("ratio") / (F.col("symbols") * F.lit(CELL / UNIT)))
    score = F.round(F.col("ratio") / F.col("symbols") * F.lit(UNIT), 6)
    scored = urls.join(sums, "number").select(F.sha2("text", 256).alias("key"), "copies", "accepted", "held",
                                              cell.alias("cell"), score.alias("score"))
    scored = scratch.keep(scored, "scored")
    limit = threshold(scored)

    rows = rows.select("id", *[c.alias(n) for n, c in zip(("host", "path"), parts(F.col("text")))],
                       F.sha2("text", 256).alias("key"))
    rows = lookup(rows, scored.select("key", "copies", "score", (F.col("cell") >= limit).alias("by_model")), "key", "copies", HOT)
    name, allow = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"),
                       F.coalesce(allow, "by_model").alias("allow"), "score", "by_model")


def op12_markov_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, and its score."""
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule",
                        F.when(F.col("allow"), F.lit("allow")).otherwise(F.lit("block")).alias("verdict"), "score")
