"""URL filter: fixed rules on hosts and paths, and association rules over URL tokens, mined by FP-growth from labelled URLs.

Labelled URLs become sets of tokens (parts of host, path and query). FP-growth finds and counts the combinations that are frequent;
those that long URLs hold are grown token by token, without what can't be of use. A combination is a rule if its support
and confidence suffice and no shorter rule says the same. Rules meet URLs through an inverted index: a rule is listed under
the rarest of its tokens alone.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import cut, discard

BLOCK, ALLOW = "block", "allow"
#: FP-growth lists all frequent sets of rows of at most so many tokens, as n tokens have 2**n; what longer rows hold is grown in rounds.
SHORT = 8


def host(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens in order: parts of the host (h:), of the path (p:) and keys of the query (q:); digits are one token ``#``. A null URL has none."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = [
        F.transform(F.regexp_extract_all(host(url), F.lit("[^.:@-]+"), F.lit(0)), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.regexp_extract_all(F.lower(path(url)), F.lit("[^/._-]+"), F.lit(0)), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "^[0-9]+$", "#"))),
        F.transform(F.regexp_extract_all(F.concat(F.lit("&"), F.lower(query)), F.lit("&([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x)),
    ]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def met(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (with ``tokens``) beside each rule (rule, rarest, wanted) all of whose tokens they hold."""
    listed = sets.withColumn("rarest", F.explode("tokens"))
    return listed.join(rules, "rarest").filter(F.size(F.array_except("wanted", "tokens")) == 0)


def grown(level: DataFrame, least: int, need: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sets of a base and one token more (wanted, support, bad), and ``level`` with these tokens alone, rarest first; equal rows are one.

    level: base (tokens that the row holds), goods_under, bads_under, long, items (more tokens of the row), n, bad. A token is left out where no
    long row has it, or where no rule can lose by it: to block, base and token hold for ``need`` bad rows, as all parts of such a rule do,
    and for fewer good ones than the base; with as many, any set of both has a shorter one without the token that is as sure or
    surer. To allow it is the reverse. A verdict that is lost stays lost for larger sets: its bound is 0 from there.
    """
    each = level.withColumn("row", F.monotonically_increasing_id()).select(*level.drop("items").columns, "row", F.explode("items").alias("token"))
    counts = each.groupBy("base", "goods_under", "bads_under", "token").agg(F.sum("n").alias("df"), F.sum("bad").alias("bads"), F.max("long").alias("long"))
    goods = F.col("df") - F.col("bads")
    blocks, allows = (F.col("bads") >= need) & (goods < F.col("goods_under")), (goods >= need) & (F.col("bads") < F.col("bads_under"))
    bounds = F.when(blocks, goods).otherwise(0).alias("goods_under"), F.when(allows, F.col("bads")).otherwise(0).alias("bads_under")
    useful = cut(counts.filter(F.col("long") & (F.col("df") >= least) & (blocks | allows)).select("base", "token", "df", "bads", *bounds), made)
    rows = each.select("row", "base", "long", "token", "n", "bad").join(useful, ["base", "token"])
    rows = rows.groupBy("row", "base", "long", "n", "bad").agg(F.array_sort(F.collect_list(F.struct("df", "token", "goods_under", "bads_under"))).alias("items"))
    left = cut(rows.groupBy("base", "long", "items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), made)
    return useful.select(F.array_append("base", F.col("token")).alias("wanted"), F.col("df").alias("support"), F.col("bads").alias("bad")), left


def split(level: DataFrame) -> DataFrame:
    """A base's rows below each of their tokens: base and token are the new base, the tokens behind it the items. A set is below its first token alone."""
    below = level.select("base", "long", "items", "n", "bad", F.posexplode("items").alias("nth", "x"))
    behind = F.transform(F.slice("items", F.col("nth") + 2, F.size("items")), lambda i: i["token"]).alias("items")
    rows = below.select(F.array_append("base", F.col("x.token")).alias("base"), "x.goods_under", "x.bads_under", "long", behind, "n", "bad")
    may_grow = rows.filter((F.size("items") > 0) & ((F.col("goods_under") > 0) | (F.col("bads_under") > 0)))
    return may_grow.groupBy("base", "goods_under", "bads_under", "long", "items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def frequent(short: DataFrame, need: int, made: list[str]) -> DataFrame:
    """wanted, support, bad: sets of the items (tokens) of ``short`` (items, n, bad) that hold for ``need`` rows of one label.

    Each transaction holds its label, so that a set's frequency with a label is the exact count under it.
    """
    labels = F.array(F.struct(F.lit(f"!{BLOCK}").alias("label"), F.col("bad").alias("times")), F.struct(F.lit(f"!{ALLOW}").alias("label"), (F.col("n") - F.col("bad")).alias("times")))
    told = short.select("items", F.explode(labels).alias("x")).filter("x.times > 0").select(F.array_append("items", F.col("x.label")).alias("items"), "x.times")
    # a set that comes n times is n transactions
    copies = cut(told.select("items", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).select("items").repartition(F.rand(1)), made)
    rows = max(copies.count(), 1)
    # half a row below the bound, so that rounding can't raise it
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / rows), minConfidence=1.0).fit(copies).freqItemsets
    parts = found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("!"))).alias("wanted"), F.get(F.filter("items", lambda x: x.startswith("!")), F.lit(0)).alias("label"), "freq")

    def most(label: Column) -> Column:
        return F.max(F.when(label, F.col("freq")))

    counted = parts.filter(F.size("wanted") > 0).groupBy("wanted").agg(most(F.col("label").isNull()).alias("support"), most(F.col("label") == f"!{BLOCK}").alias("bads"), most(F.col("label") == f"!{ALLOW}").alias("goods"))
    return counted.select("wanted", "support", F.coalesce("bads", F.col("support") - F.col("goods")).alias("bad")).filter(F.col("bad").isNotNull())


def mine(labelled: DataFrame, support: int = 20, share: float = 1e-4, confidence: float = 0.9, lift: float = 1.2, scratch: list[str] | None = None) -> DataFrame:
    """rule (its tokens, sorted, by spaces), wanted (the tokens), rarest, verdict, confidence, support: from ``labelled`` (url string, blocked boolean).

    support, share: a rule holds for so many labelled URLs at least, and for such a share of them. lift: its confidence is so many
    times the share of its verdict among all. A URL that comes several times counts as often; rows without url or label
    count nothing. No labelled URLs: no rules. Two verdicts can't both reach a confidence over a half.

    All such rules are found, whatever their tokens' number and places. Sets that no row of more than ``SHORT`` tokens holds are found by FP-growth
    over the other rows. Sets that some long row holds are grown in rounds, a token a round, and counted in all rows: a base's rows are its
    conditional pattern base. Rounds end where no set can be of use; in the worst case, of many frequent tokens that come in all
    combinations with both labels, their number is that of the combinations.
    """
    spark, made = labelled.sparkSession, []
    each = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).groupBy("url").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"))
    sets = cut(each.select(tokens(F.col("url")).alias("tokens"), "n", "bad").groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), made)
    total, bad = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(1, support, int(share * total))
    empty = "rule string, wanted array<string>, rarest string, verdict string, confidence double, support long"
    if total < least:
        discard(spark, made)
        return spark.createDataFrame([], empty)
    need = math.ceil(max(confidence, 0.5) * least - 1e-6)  # so many rows a rule is right for, at least
    none = F.array().cast("array<string>").alias("base")
    unbounded = F.lit(total + 1).alias("goods_under"), F.lit(total + 1).alias("bads_under")
    single, rows = grown(sets.select(none, *unbounded, F.lit(True).alias("long"), F.col("tokens").alias("items"), "n", "bad"), least, need, made)
    often = single.select(F.col("wanted")[0].alias("token"), F.col("support").alias("df"))
    plain = rows.select(none, *unbounded, (F.size("items") > SHORT).alias("long"), F.transform("items", lambda x: x["token"]).alias("items"), "n", "bad")
    grown_sets, (_, level) = [single], grown(plain, least, need, made)  # only tokens of long rows go on
    while not (level := cut(split(level), made)).isEmpty():
        useful, level = grown(level, least, need, made)
        grown_sets.append(useful)

    def sure(counted: DataFrame) -> DataFrame:
        blocks = F.col("bad") * 2 > F.col("support")
        right = F.when(blocks, F.col("bad")).otherwise(F.col("support") - F.col("bad"))
        base = F.when(blocks, F.lit(bad / total)).otherwise(F.lit(1 - bad / total))
        judged = counted.select(F.array_sort("wanted").alias("wanted"), F.when(blocks, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"), (right / F.col("support")).alias("confidence"), "support", (right / F.col("support") / base).alias("lift"))
        fit = judged.filter((F.col("support") >= least) & (F.col("confidence") >= confidence) & (F.col("lift") >= lift)).drop("lift")
        rarest = fit.select("wanted", F.explode("wanted").alias("token")).join(often, "token").groupBy("wanted").agg(F.min(F.struct("df", "token"))["token"].alias("rarest"))
        return cut(fit.join(rarest, "wanted").select(F.concat_ws(" ", "wanted").alias("rule"), "wanted", "rarest", "verdict", "confidence", "support"), made)

    by_growth = sure(reduce(DataFrame.unionByName, grown_sets))
    by_short = sure(frequent(plain.filter(~F.col("long")).select("items", "n", "bad"), need, made).filter(F.size("wanted") > 1))
    in_long = met(plain.filter("long").select(F.col("items").alias("tokens")), by_short).select("wanted").distinct()  # their counts are not whole
    strong = cut(by_growth.unionByName(by_short.join(in_long, "wanted", "left_anti").select(*by_growth.columns)), made)
    longer = strong.select(F.col("wanted").alias("tokens"), F.col("verdict").alias("long_verdict"), F.col("confidence").alias("long_confidence"))
    same = met(longer, strong).filter("wanted <> tokens and verdict = long_verdict and confidence >= long_confidence")
    kept_rules = cut(strong.join(same.select(F.col("tokens").alias("wanted")).distinct(), "wanted", "left_anti").select(*strong.columns), scratch)
    discard(spark, made)
    return kept_rules


def fixed_rule(url: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest of ``rules`` (host, path, verdict) that fits, spelled, and its verdict; null where none does. A rule fits its host and all subdomains, where the path begins with its own."""
    h, p, spelled, verdict = host(url), path(url), F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = F.concat(F.lit("."), h).endswith("." + rule_host) & p.startswith(rule_path)
        spelled, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(spelled), F.when(fits, F.lit(said)).otherwise(verdict)
    return spelled, verdict


def judge(pages: DataFrame, mined: DataFrame, rules: tuple[tuple[str, str, str], ...] = (), otherwise: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and mined (the association rule that fits best, else null) for its ``url``.

    The verdict is the fixed rule's, else that of the fitting mined rule of most confidence (then support, then first by its text),
    else ``otherwise``. Columns of those names are replaced. Rows that repeat are judged alike; a null url, or one without
    ``://``, fits nothing; without mined rules all is as the fixed rules and ``otherwise`` say.
    """
    new = ("host", "path", "rule", "verdict", "mined")
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"))  # apart, whatever its columns are called
    url = F.col("row.url").cast("string")
    spelled, said = fixed_rule(url, rules)
    base = rows.select("row", url.alias("url"), host(url).alias("host"), path(url).alias("path"), spelled.alias("rule"), said.alias("said"))
    urls = base.filter("rule is null and url is not null").select("url").distinct().select(F.col("url").alias("asked"), tokens(F.col("url")).alias("tokens"))
    order = F.struct(F.negative("confidence").alias("a"), F.negative("support").alias("b"), F.col("rule").alias("c"), F.col("verdict").alias("d"))
    best = met(urls, mined).groupBy("asked").agg(F.min(order).alias("best"))
    known = base.join(best, (F.col("url") == F.col("asked")) & F.col("rule").isNull(), "left")
    verdict = F.coalesce("said", "best.d", F.lit(otherwise)).alias("verdict")
    return known.select(*(F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in new), "host", "path", "rule", verdict, F.col("best.c").alias("mined"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked: pages whose document (of the same number) is labelled; toxic ones and those of no quality are to be blocked."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    own = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select(F.col("doc_id").alias("page_id"), bad.alias("blocked"))
    return pages.select("page_id", "url").join(own, "page_id").select("url", "blocked")
