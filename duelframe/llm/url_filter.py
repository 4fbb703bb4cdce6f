"""URL filter: ratio of two variable-order Markov models over URL characters.

Urls that a rule allows or blocks are the examples. Host and path, with digits
folded to one sign, are broken into grams of ``ORDER + 1`` characters. For both
classes a Witten-Bell model is built from gram counts over all rows: a context
seen n times with t different followers gives n/(n+t) of its weight to its own
counts and t/(n+t) to the context one character shorter, down to a uniform
distribution, so the order in use varies with what was seen. A URL's score is
the log-likelihood difference divided by its length; the threshold is the one
with the best balanced accuracy on examples that the models did not count.

Everything is DataFrame code. Strings are scored once however many pages share
them, so a host with a third of all pages costs one string per shape of path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import ascii_lower
from duelframe.session import spool

ORDER = 3
#: Characters kept as they are; digits become 0, anything else ~. 26 letters and these bound the number of grams.
KEPT = "abcdefghijklmnopqrstuvwxyz./-_%"
ALPHABET = len(KEPT) + 4  # with 0, ~, the start and the end mark
#: Scores are compared in steps of 1/STEPS and clamped to +-LIMIT, which bounds the calibration table.
STEPS, LIMIT = 200, 20
CALIBRATION_FOLDS = 5

#: The stated rules, as (verdict, host, path).
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; ``rules`` is a short stated list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def model_text(host: Column, path: Column) -> Column:
    """What the models see: lower case, digit runs as one 0, rare characters as ~."""
    text = F.regexp_replace(ascii_lower(F.concat(host, path)), r"[0-9]+", "0")
    return F.regexp_replace(text, r"[^a-z0./_%\-]", "~")


def _models(grams: DataFrame) -> DataFrame:
    """Log-likelihood difference of each gram (last character given the others).

    ``grams`` has (gram, accepted, rejected) with the counts of both classes.
    Grams of zero count are scored too: they occur in other urls.
    """
    table = grams
    base = grams.groupBy(F.substring("gram", ORDER + 1, 1).alias("c")).agg(
        F.sum("accepted").alias("na"), F.sum("rejected").alias("nr")
    )
    totals = base.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"s{n}") for n in ("na", "nr")],
                      *[F.count(F.when(F.col(n) > 0, 1)).alias(f"t{n}") for n in ("na", "nr")])

    def mixed(n: str, total: str, kinds: str, lower: Column) -> Column:
        weight = F.col(total) + F.col(kinds)
        return F.when(weight > 0, (F.col(n) + F.col(kinds) * lower) / weight).otherwise(lower)

    # one row of totals, and one row per character of the alphabet
    lowest = base.crossJoin(F.broadcast(totals)).select(
        "c", *[mixed(n, f"s{n}", f"t{n}", F.lit(1.0 / ALPHABET)).alias(f"p{n}") for n in ("na", "nr")]
    )
    table = table.withColumn("c", F.substring("gram", ORDER + 1, 1)).join(lowest, "c")
    for k in range(1, ORDER + 1):
        seen = grams.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(
            F.sum("accepted").alias("na"), F.sum("rejected").alias("nr")
        )
        contexts = seen.groupBy(F.substring("g", 1, k).alias("ctx")).agg(
            *[F.sum(n).alias(f"s{n}") for n in ("na", "nr")],
            *[F.count(F.when(F.col(n) > 0, 1)).alias(f"t{n}") for n in ("na", "nr")],
        )
        table = (
            table.withColumn("g", F.substring("gram", ORDER + 1 - k, k + 1))
            .withColumn("ctx", F.substring("gram", ORDER + 1 - k, k))
            .join(seen, "g").join(contexts, "ctx")
            .select("gram", *[mixed(n, f"s{n}", f"t{n}", F.col(f"p{n}")).alias(f"p{n}") for n in ("na", "nr")])
        )
    return table.select("gram", (F.log("pna") - F.log("pnr")).alias("llr"))


def _threshold(scored: DataFrame) -> DataFrame:
    """One row (cut): the score from which a url counts as accepted, by balanced accuracy.

    It lies half-way between the scores it parts; ties go to the smallest one.
    Without examples of both classes it is 0.
    """
    from pyspark.sql import Window

    bins = scored.groupBy("score").agg(F.sum("cal_accepted").alias("a"), F.sum("cal_rejected").alias("r"))
    up_to = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * STEPS * LIMIT + 1 bins
    all_of = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = 1 - F.coalesce(F.sum("a").over(up_to), F.lit(0)) / F.sum("a").over(all_of)
    caught = F.coalesce(F.sum("r").over(up_to), F.lit(0)) / F.sum("r").over(all_of)
    in_order = Window.orderBy("score")
    rated = bins.where("a + r > 0").select(
        "score", F.round(kept + caught, 9).alias("good"), ((F.col("score") + F.coalesce(F.lag("score").over(in_order), "score")) / 2).alias("cut")
    )
    best = rated.agg(F.max(F.when(F.col("good").isNotNull(), F.struct("good", (-F.col("score")).alias("first"), "cut"))).alias("best"))
    return best.select(F.coalesce(F.col("best")["cut"], F.lit(0.0)).alias("cut"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``.

    Null urls and urls without ``://`` have empty host and path and no rule;
    they are judged by the score of the empty string. Equal urls get equal
    verdicts and each row is returned, repeated ids included. If the rules
    leave no example of a class, the difference is against the uniform
    distribution and the threshold is 0. An empty table gives no rows; other
    columns are not read.
    """
    host, path = host_and_path(F.col(url_column))
    parts = pages.select(F.col(id_column), F.col(url_column).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select(
        id_column, "host", "path", name.alias("rule"), verdict.alias("ruled"),
        model_text(F.col("host"), F.col("path")).alias("text"),
        (F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % CALIBRATION_FOLDS == 0).alias("held"),
    )

    def examples(kind: str, held: bool) -> Column:
        return F.count(F.when((F.col("ruled") == kind) & (F.col("held") == held), 1))

    texts = spool(
        parts.groupBy("text").agg(
            examples("allow", False).alias("accepted"), examples("block", False).alias("rejected"),
            examples("allow", True).alias("cal_accepted"), examples("block", True).alias("cal_rejected"),
        ),
        "url-texts",
    )
    padded = F.concat(F.lit("^" * ORDER), F.col("text"), F.lit("$"))
    spots = texts.select("text", "accepted", "rejected", padded.alias("padded")).select(
        "text", "accepted", "rejected",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.length("padded") - ORDER), lambda i: F.col("padded").substr(i, F.lit(ORDER + 1))
        )).alias("gram"),
    )
    grams = spool(
        spots.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams"
    )
    weights = spool(_models(grams), "url-weights")
    mean = F.sum("llr") / F.count(F.lit(1))
    level = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), mean))
    scored = spool(
        spots.select("text", "gram").join(weights, "gram").groupBy("text")
        .agg((F.round(level * STEPS) / STEPS + F.lit(0.0)).alias("score"))
        .join(texts, "text"),
        "url-scores",
    )
    judged = scored.crossJoin(F.broadcast(_threshold(scored))).select(
        "text", "score", F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block").alias("guess")
    )
    return parts.join(judged, "text", "left").select(
        id_column, "host", "path", "rule", F.coalesce("ruled", "guess").alias("verdict"), "score"
    )
