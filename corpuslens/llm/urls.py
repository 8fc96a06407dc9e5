"""URL filter by the ratio of two character language models.

One Markov model of variable order is counted from accepted, one from rejected URLs; orders are interpolated (Witten and
Bell), so a model is as long as the context it has seen. A URL's score is the mean difference of the log-likelihoods per
character. The threshold is calibrated on labelled URLs that were not counted: that with the best balanced accuracy. All
of it is DataFrame work; the models have at most 31 ** 4 rows whatever the input, since other characters than a-z, digits
(as one), ``. / _ -`` count as one.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged like any other; without
labelled URLs of both kinds the score is 0 and the threshold 0, so all are allowed; rows that repeat stay; an empty table
gives an empty table. Only the id and url columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import ascii_lower
from corpuslens.session import written

ORDER = 4
SYMBOLS = 32
# Score bins for the threshold.
STEPS = 100


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, of ``(verdict, host, path)``; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def model_text(host: Column, path: Column) -> Column:
    """What the models read: lower case, digits as 0, rare characters as ~."""
    text = F.translate(ascii_lower(F.concat(host, path)), "123456789", "000000000")
    return F.regexp_replace(text, r"[^a-z0./_-]", "~")


def grams(text: Column) -> Column:
    """All windows of ``ORDER`` characters, one for each character and the end."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: padded.substr(i, F.lit(ORDER)))


def log_ratios(rows: DataFrame) -> DataFrame:
    """``gram, ratio`` of every gram in ``rows (text, label)``; only rows with a label are counted for the models."""
    counted = rows.select(F.explode(grams(F.col("text"))).alias("gram"), "label")
    counted = counted.groupBy("gram").agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")
    )
    counted = written(counted, "grams")
    below = None
    for order in range(1, ORDER + 1):
        suffix = F.substring("gram", ORDER - order + 1, order)
        level = counted.groupBy(suffix.alias("gram")).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)])
        context = F.substring("gram", 1, order - 1)
        level = level.withColumn("context", context)
        seen = level.groupBy("context").agg(
            *[F.sum(f"n{k}").alias(f"all{k}") for k in (0, 1)], *[F.count_if(F.col(f"n{k}") > 0).alias(f"kinds{k}") for k in (0, 1)]
        )
        level = level.join(seen, "context")
        if below is None:
            level = level.withColumns({f"p{k}": F.lit(1 / SYMBOLS) for k in (0, 1)})
        else:
            shorter = below.select(F.col("gram").alias("shorter"), "p0", "p1")
            level = level.join(shorter, F.substring("gram", 2, order - 1) == F.col("shorter"))
        blend = {
            f"p{k}": F.when(
                F.col(f"all{k}") > 0,
                (F.col(f"n{k}") + F.col(f"kinds{k}") * F.col(f"p{k}")) / (F.col(f"all{k}") + F.col(f"kinds{k}")),
            ).otherwise(F.col(f"p{k}"))
            for k in (0, 1)
        }
        below = level.select("gram", *[p.alias(name) for name, p in blend.items()])
    return below.select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))


def score(rows: DataFrame, ratios: DataFrame, *keep: str) -> DataFrame:
    """``keep, score``: one row for each distinct ``keep``, which must determine ``text``; no row is gathered."""
    parts = rows.select(*keep, F.explode(grams(F.col("text"))).alias("gram"))
    # At most SYMBOLS ** ORDER rows.
    return parts.join(F.broadcast(ratios), "gram").groupBy(*keep).agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> float:
    """Of ``scored (score, label)``, the cut with the best balanced accuracy; the lowest of several, 0 without labels.

    Scores are taken in steps; a cut lies halfway between two steps that have scores.
    """
    bins = scored.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")
    )
    # A URL's score lies between the logarithms of the smallest probabilities, so there are a few thousand steps at most.
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost, caught = (F.try_divide(F.coalesce(F.sum(n).over(below), F.lit(0)), F.sum(n).over(total)) for n in ("n1", "n0"))
    quality = 1 - lost + caught
    # Without labels of both kinds the division gives null.
    before = F.coalesce(F.lag("step").over(Window.orderBy("step")) + 1, F.col("step"))
    bins = bins.select("step", ((before + F.col("step")) / 2 / STEPS).alias("cut"), F.round(quality, 9).alias("quality"))
    best = bins.where("quality IS NOT NULL").orderBy(F.desc("quality"), "step").first()
    return best.cut if best else 0.0


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row.

    The models learn from the URLs that a rule decides: accepted are those it allows, rejected those it blocks.
    """
    host, path = split_url(F.col(url_col))
    # Equal rows become one until the end, so that each is scored where it lies.
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), model_text(F.col("host"), F.col("path")).alias("text"))
    rows = written(rows, "urls")
    label = F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0)
    held = F.substring(F.md5("text"), 1, 1) < "4"
    ratios = written(log_ratios(rows.select("text", F.when(~held, label).alias("label"))), "ratios")
    names = ["page_id", "host", "path"]
    scored = written(score(rows, ratios, *names, "copies", "rule", "ruled", "text"), "url-scores")
    limit = threshold(scored.where(held & F.col("ruled").isNotNull()).select("score", label.alias("label")))
    by_model = F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    scored = scored.withColumn("copy", F.explode(F.expr("sequence(1, int(copies))")))
    return scored.select(*names, "rule", F.coalesce("ruled", by_model).alias("verdict"), F.round("score", 6).alias("score"))
