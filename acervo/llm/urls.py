"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule allows or blocks are the accepted and the rejected text.  Two Markov
models of variable order over characters are counted from them, smoothed by Witten-Bell
interpolation from the shortest context up, and every other URL is judged by the
difference of its log-likelihoods per character against a threshold calibrated on ruled
URLs that the counts have not seen.  Everything is counting, windows over the successors
of a context, and joins on character n-grams; n-grams are counted over all URLs and grow
with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.session import written

#: Characters in the longest n-gram, the last one being predicted.
ORDER = 5
START = "\u0002"
#: One in so many ruled URLs is kept for calibration.
FOLD = 5
#: Size of the alphabet that the order-0 model spreads over.
ALPHABET = 256
STEP = 0.02

Rules = list[tuple[str, str]]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to '/', '?' or '#', A-Z lower-cased; path up to '?' or '#'; empty where there is no '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(rules: Rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last, the longest, is asked first
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame) -> DataFrame:
    """``urls`` with one row per character: ``gram``, the character after the ORDER − 1 before it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("url"))
    rows = urls.where(F.length("url") > 0).select("*", padded.alias("padded")).select("*", F.explode(F.sequence(F.lit(1), F.length("url"))).alias("at"))
    return rows.withColumn("gram", F.expr(f"substring(padded, at, {ORDER})")).drop("url", "padded", "at")


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log of P(accepted) over P(rejected) of the last character after the others.

    ``counts``: gram, accepted, rejected.  An n-gram seen in neither class falls back to its
    shorter contexts.
    """
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):
        tables.append(tables[-1].groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    below = None
    for k, own in enumerate(reversed(tables), 1):
        context = Window.partitionBy(F.expr(f"left(gram, {k - 1})"))
        own = own.select("gram", *[c for kind in ("accepted", "rejected") for c in (
            F.col(kind), F.sum(kind).over(context).alias(f"{kind}_all"), F.sum((F.col(kind) > 0).cast("int")).over(context).alias(f"{kind}_kinds"))])
        if below is not None:
            own = own.withColumn("suffix", F.expr(f"right(gram, {k - 1})")).join(below, "suffix")
        smoothed = []
        for kind in ("accepted", "rejected"):
            before = F.lit(1.0 / ALPHABET) if below is None else F.col(f"{kind}_below")
            total = F.col(f"{kind}_all") + F.col(f"{kind}_kinds")
            smoothed.append(F.when(total > 0, (F.col(kind) + F.col(f"{kind}_kinds") * before) / total).otherwise(before).alias(f"{kind}_below"))
        below = own.select(F.col("gram").alias("suffix"), *smoothed)
    return below.select(F.col("suffix").alias("gram"), F.log(F.col("accepted_below") / F.col("rejected_below")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The cut with the least sum of both error rates over (score, verdict); the middle of the best stretch; 0 without both kinds."""
    steps = scored.groupBy(F.round(F.col("score") / STEP).cast("long").alias("step")).agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("allowed"), F.sum((F.col("verdict") == "block").cast("long")).alias("blocked"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    errors = steps.select(
        "step", F.lag("step").over(Window.orderBy("step")).alias("before"), F.sum("allowed").over(every).alias("n_allowed"), F.sum("blocked").over(every).alias("n_blocked"),
        F.coalesce(F.sum("allowed").over(upto), F.lit(0)).alias("lost"), F.coalesce(F.sum("blocked").over(upto), F.lit(0)).alias("stopped"))
    errors = errors.where("n_allowed > 0 and n_blocked > 0").select(
        (F.col("lost") / F.col("n_allowed") + 1 - F.col("stopped") / F.col("n_blocked")).alias("error"),
        ((F.col("step") + F.coalesce("before", F.col("step") - 1)) / 2 * STEP).alias("cut"))
    best = errors.orderBy("error", F.abs("cut"), "cut").limit(1).collect()
    return float(best[0]["cut"]) if best else 0.0


def filtered(pages: DataFrame, rules: Rules) -> DataFrame:
    """The verdict on every row of ``pages`` (page_id, url; other columns are ignored).

    Returns (page_id, host, path, rule, verdict, score); ``score`` is null where a rule
    decides.  Null and empty URLs have no host, no path and score 0; copies of a URL are
    scored once and count each time; with no ruled URLs of both kinds the threshold is 0;
    an empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    key = [F.xxhash64("url").alias("u"), F.xxhash64(F.lit(1), F.col("url")).alias("v")]
    urls = rows.where("url is not null").groupBy("url", "ruled").agg(F.count(F.lit(1)).alias("copies")).select(*key, "url", "ruled", "copies")
    tested = F.pmod("u", F.lit(FOLD)) == 0
    weight = lambda kind: F.sum(F.when((F.col("ruled") == kind) & ~tested, F.col("copies")).otherwise(0))
    counts = grams(urls).groupBy("gram").agg(weight("allow").alias("accepted"), weight("block").alias("rejected"))
    ratios = written(log_ratios(counts), "url-ratios")
    judged = grams(urls.where(F.col("ruled").isNull() | tested).drop("copies")).join(ratios, "gram")
    scores = written(judged.groupBy("u", "v", "ruled").agg(F.avg("ratio").alias("score")), "url-scores")
    cut = threshold(scores.where("ruled is not null").select("score", F.col("ruled").alias("verdict")))
    own = scores.where("ruled is null").select("u", "v", "score")
    decided = rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_ = rows.where("rule is null").select("*", *key).join(own, ["u", "v"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return decided.unionByName(open_.select("page_id", "host", "path", "rule", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict"), "score"))
