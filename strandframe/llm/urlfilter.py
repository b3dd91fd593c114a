"""URL filters: host and path rules, then association rules over URL tokens.

Each URL becomes a set of tokens (scheme, labels of the host and their parts, path segments with their depth, file extension, query keys;
numbers are one token). Spark's FP-growth mines the labelled URLs' token sets, where bad ones hold a label token; rules that
lead to that token and pass ``support``, ``least_count``, ``confidence`` and ``lift`` are kept. Tokens that too few bad URLs hold for any such rule
are left out before mining, which loses none (a rule's tokens are each at least as frequent with the label as the rule), and so are tokens that all labelled URLs hold;
tokens that the same labelled URLs hold are mined as one class, as a host and its only word are, and a URL has the class if it holds any of them. No verdict changes by that,
but each such token would double the item sets. Labelled URLs are pages whose page_id is a doc_id of
labels; one is bad if its quality is 0 or it is toxic.

Rules are matched through an inverted index: each is filed under the tokens of the rarest of its classes, URLs look up their tokens, and a candidate's
other classes are verified. A given rule's verdict comes first (the longest that fits), then block if a mined rule fits, else allow.

Null urls and urls without ``://`` have empty host and path and no tokens, so they are allowed; without labels nothing is mined; repeated rows
get equal results; null page_ids are kept; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BAD = "label:bad"
#: Mined rules up to which their index is broadcast; beyond, it is joined by shuffle.
_BROADCAST_RULES = 20_000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    number = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.split(host, "\\.")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    made = F.concat(
        F.array(F.concat(F.lit("s:"), F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER))),
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), number(x))),
        F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), number(x))),
        F.array(F.concat(F.lit("x:"), F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def parsed(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine(transactions: DataFrame, support: float = 0.001, confidence: float = 0.6, least_count: int = 20, lift: float = 1.5) -> DataFrame:
    """The rules that lead to the label token; transactions: items, bad.

    antecedent (array of classes, each named by its least token), members (array of each class's tokens: a URL fits if it holds one of each), confidence,
    key (the tokens of the rarest class).
    """
    rules, classes = frequent(transactions, support, least_count)
    kept = rules.filter((F.col("confidence") >= confidence) & (F.col("lift") >= lift)).select(
        "antecedent",
        "confidence",
        F.explode("antecedent").alias("class"),
    )
    parts = F.array_sort(F.collect_list("members")).alias("members")
    return kept.join(classes, "class").groupBy("antecedent", "confidence").agg(parts, F.min_by("members", F.struct("n", "class")).alias("key"))


def token_classes(sets: DataFrame, least: float) -> DataFrame:
    """class (its least token), members, n: tokens that the same labelled URLs hold, as rules can't tell them apart; sets: _set, items, bad, n.

    Tokens that all URLs hold, which say nothing, and those of fewer than ``least`` bad URLs aren't in any class.
    """
    at = [F.xxhash64(F.lit(seed), "_set", "bad") for seed in (1, 2)]
    each = sets.select("_set", "bad", "n", F.explode("items").alias("token"))
    tokens = each.groupBy("token").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("bad"), F.col("n"))).alias("n_bad"),
        *[F.bit_xor(a).alias(f"p{i}") for i, a in enumerate(at)],
    )
    whole = sets.agg(F.sum("n")).first()[0]
    telling = tokens.filter((F.col("n_bad") >= least) & (F.col("n") < F.lit(whole)))
    classes = telling.groupBy("p0", "p1", "n").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return classes.select(F.col("members")[0].alias("class"), "members", "n")


def frequent(transactions: DataFrame, support: float = 0.001, least_count: int = 20) -> tuple[DataFrame, DataFrame]:
    """What FP-growth finds in the transactions: rules that lead to the label token (antecedent, confidence, lift; confidence is null where bad URLs are
    too few), and the token classes they are made of."""
    n, share = transactions.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    least = max(support * n, least_count)
    spark = transactions.sparkSession
    keyed = transactions.select("items", "bad", F.md5(F.to_json("items")).alias("_set"))
    sets = common.cut(keyed.groupBy("_set", "bad").agg(F.first("items").alias("items"), F.count("*").alias("n")), "url-labelled-sets")
    classes = common.cut(token_classes(sets, least), "url-classes")
    named = sets.select("_set", "bad", "n", F.explode("items").alias("class")).join(classes.select("class"), "class")
    own = named.groupBy("_set", "bad", "n").agg(F.collect_list("class").alias("items"))
    items = F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items"))
    copies = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")
    ready = common.cut(own.select(items.alias("items"), copies).select("items"), "url-transactions")
    held = ready.count()
    # Transactions without a telling token are left out; the least count is the same.
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, held)), numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = growth.fit(ready).freqItemsets
    # An item set with the label token is no more frequent than the one without it, which is thus found too.
    bad = F.array_contains("items", _BAD)
    antecedent = F.array_sort(F.array_remove("items", _BAD)).alias("antecedent")
    counts = found.select(antecedent, "freq", bad.alias("bad")).filter(F.size("antecedent") > 0)
    both = counts.groupBy("antecedent").agg(
        F.max(F.when(F.col("bad"), F.col("freq"))).alias("hit"),
        F.max(F.when(~F.col("bad"), F.col("freq"))).alias("freq"),
    )
    rules = both.select(
        "antecedent",
        (F.col("hit") / F.col("freq")).alias("confidence"),
    ).withColumn("lift", F.col("confidence") / F.lit(share or 1.0))
    return rules, classes


def transactions_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """items, bad: the token sets of labelled URLs."""
    bad = (
        labels.groupBy(F.col("doc_id").alias("page_id")).agg(((F.min("quality") == 0) | (F.max("toxic") == 1)).alias("bad")).filter("bad IS NOT NULL")
    )
    listed = parsed(pages).withColumn("items", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    return listed.join(bad, "page_id").filter(F.size("items") > 0).select("items", "bad")


def report(
    pages: DataFrame,
    labels: DataFrame,
    support: float = 0.001,
    confidence: float = 0.6,
    least_count: int = 20,
    lift: float = 1.5,
) -> dict[str, float | int | None]:
    """Figures of the mining: labelled URLs, bad share, item sets, rules before and after the bounds, best lift and confidence."""
    t = common.cut(transactions_of(pages, labels), "url-report")
    rules = frequent(t, support, least_count)[0]
    kept = (F.col("confidence") >= confidence) & (F.col("lift") >= lift)
    best = rules.agg(
        F.count("*").alias("item_sets"),
        F.count("confidence").alias("rules"),
        F.max("lift").alias("best_lift"),
        F.max("confidence").alias("best_confidence"),
        F.count_if(kept).alias("kept"),
    )
    return {"urls": t.count(), "bad_share": t.agg(F.avg(F.col("bad").cast("double"))).first()[0], **best.first().asDict()}


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    broadcast_rules: int = _BROADCAST_RULES,
    **mining,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and rule_confidence (of the best mined rule that fits; null if none) of every row."""
    found = parsed(pages)
    listed = found.withColumn("items", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    mined = common.cut(mine(common.cut(transactions_of(pages, labels), "url-labelled"), **mining), "url-rules")
    n = mined.count()
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    if not n:
        return found.select(
            "page_id",
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(verdict, F.lit("allow")).alias("verdict"),
            F.lit(None).cast("double").alias("rule_confidence"),
        )
    index = mined.select(F.explode("key").alias("_token"), "members", "confidence")
    index = F.broadcast(index) if n <= broadcast_rules else index
    # Equal token sets are looked up once: a host with a third of all rows has few of them.
    sets = common.cut(
        listed.select("items", F.md5(F.to_json("items")).alias("_set")).groupBy("_set").agg(F.first("items").alias("items")),
        "url-sets",
    )
    looked_up = sets.select("_set", "items", F.explode("items").alias("_token")).join(index, "_token")
    hits = looked_up.filter(F.forall("members", lambda own: F.arrays_overlap(own, F.col("items"))))
    best = common.cut(hits.groupBy("_set").agg(F.max("confidence").alias("rule_confidence")), "url-hits")
    joined = listed.withColumn("_set", F.md5(F.to_json("items"))).join(best, "_set", "left")
    mined_verdict = F.when(F.col("rule_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), "rule_confidence")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    found = judge(common.docs_of(spark, sf_dir, "pages"), common.docs_of(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")
