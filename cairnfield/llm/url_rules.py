"""URL filtering: fixed (host, path) rules, then association rules mined from labels.

Token sets of labelled urls go through Spark's FP-growth; rules "tokens => blocked" that
pass support, confidence and lift, and that no shorter rule with at least their confidence
covers, form the filter. A rule is indexed under its rarest token (an inverted index), so
a url meets only the rules of tokens it has; the rest of the rule's tokens are then checked.

Defined cases: a null url or one without ``://`` has empty host and path, no tokens, and is
allowed; repeated rows are judged once and returned as often as they occur; without labels
or rules everything that no fixed rule blocks is allowed; rows whose label is null do not train; very long urls are
read whole, with as many tokens as they have; of several mined rules that match the greatest confidence is reported, of equally rare tokens the
first in order indexes a rule, and of equally sure rules the one on fewer tokens stays; other columns, whatever
their names, are ignored; empty tables give no rules or no rows. Rows are told apart by 128 bits.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_up_to, lower_az, materialize, row_keys, shuffle_parts, table

#: (verdict, host, path): the longest that fits wins.
FIXED_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BLOCK = "label=block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path``, and its verdict; both null if none fits."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels (h:), path words (p:), query keys (q:), file ending (e:), scheme (s:)."""
    host, path = host_of(url), path_of(url)
    keep = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    low = lower_az(path)
    words = F.split(F.regexp_replace(low, r"\.[a-z0-9]{1,5}$", ""), r"[/_.-]+")
    # numbers stand for one token: a single page's number says nothing about another url
    words = F.transform(words, lambda x: F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(x))
    all_ = F.concat(keep("h:", F.split(host, r"[.:]")), keep("p:", words), keep("q:", keys), keep("e:", F.array(F.regexp_extract(low, r"\.([a-z0-9]{1,5})$", 1))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_))


def mine_rules(labelled: DataFrame, min_count: int = 8, min_support: float = 0.0005, min_confidence: float = 0.5, min_lift: float = 2.0) -> DataFrame:
    """Rules (tokens, confidence, support) from (tokens, blocked) rows.

    A token set counts if it occurs min_count times and in min_support of the rows. FP-growth
    runs over the blocked rows (the only ones in which a rule to "block" can hold), with the
    token sets' counts over all rows joined on afterwards, so frequent harmless combinations
    cost nothing.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    labelled = materialize(labelled.where(F.col("blocked").isNotNull() & (F.size("tokens") > 0)).select("tokens", "blocked"), "labelled")
    total, bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0))).first()
    least = max(min_count * min_confidence, min_support * total * min_confidence)
    if not bad or bad < least:
        return empty
    parts = shuffle_parts(spark)
    blocked = labelled.where("blocked").select("tokens").repartition(parts)
    model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, least / bad), minConfidence=1.0, numPartitions=parts).fit(blocked)
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad")), "itemsets").withColumn("id", F.xxhash64("tokens"))
    seen = match(labelled.withColumn("row", F.monotonically_increasing_id()).drop("blocked"), sets.select("id", "tokens"), "row").groupBy("id").agg(F.count(F.lit(1)).alias("seen"))
    rules = sets.join(seen, "id").select("id", "tokens", (F.col("bad") / F.col("seen")).alias("confidence"), (F.col("seen") / total).alias("support"), "seen")
    rules = materialize(rules.where((F.col("seen") >= min_count) & (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * bad / total)), "rules")
    # a rule goes if a rule on fewer of its tokens is as sure
    general = match(rules.select(F.col("id").alias("row"), "tokens"), rules.select("id", "tokens"), "row").where("row <> id")
    sure = rules.select("id", F.col("confidence").alias("other"))
    covered = general.join(sure, "id").join(rules.select(F.col("id").alias("row"), "confidence"), "row").where("other >= confidence").select(F.col("row").alias("id")).distinct()
    return rules.join(covered, "id", "left_anti").select("tokens", "confidence", "support")


def match(rows: DataFrame, rules: DataFrame, key: str, small: int = 50_000) -> DataFrame:
    """(key, id) for every rule whose tokens a row all has.

    rows: (key, tokens); rules: (id, tokens). The inverted index lists a rule under its rarest
    token. It is broadcast up to ``small`` rules, and joined by a shuffle beyond that.
    """
    rules = rules.withColumn("_need", F.col("tokens")).drop("tokens")
    each = rows.select(key, F.col("tokens").alias("_have"), F.explode("tokens").alias("_token"))
    needed = rules.select(F.explode("_need").alias("_token")).distinct()
    frequency = each.join(broadcast_up_to(needed, small), "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    index = rules.select("id", "_need", F.explode("_need").alias("_token")).join(frequency, "_token", "left")
    index = index.groupBy("id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token"))).alias("_rarest"), F.first("_need").alias("_need"))
    index = materialize(index.select("id", "_need", F.col("_rarest._token").alias("_token")), "index")
    return each.join(broadcast_up_to(index, small), "_token").where(F.size(F.array_except("_need", "_have")) == 0).select(key, "id")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", fixed=FIXED_RULES) -> DataFrame:
    """Every page with host, path, rule, verdict and the confidence of the surest mined rule that matched."""
    rows = pages.groupBy(F.col(key).alias("page_id"), F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("_times")).withColumn("tokens", url_tokens(F.col("url")))
    rules = rules.withColumn("id", F.xxhash64("tokens"))
    rows = rows.withColumn("_key", F.struct(*row_keys(F.col("page_id"), F.col("url"), F.col("page_id").isNull(), F.col("url").isNull())))
    hits = match(rows.select("_key", "tokens"), rules.select("id", "tokens"), "_key").join(rules.select("id", "confidence"), "id")
    hits = hits.groupBy("_key").agg(F.max("confidence").alias("method_confidence"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    out = rows.join(hits, "_key", "left").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    mined = F.when(F.col("method_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    out = out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "method_confidence", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy"))
    return out.drop("_copy")


def train(pages: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Mine rules from labelled pages (label doc_id = page_id); toxic or of low quality: blocked."""
    labels = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return mine_rules(pages.select("page_id", url_tokens(F.col("url")).alias("tokens")).join(labels, "page_id"), **limits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(pages, table(spark, sf_dir, "labels")))
