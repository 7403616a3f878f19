"""URL filters: association rules between URL tokens and a label, mined by FP-growth, matched by an inverted index.

Tokens are the runs of letters and digits of host, path and query. Transactions are the distinct tokens of labelled urls
plus one item for the label. Rules that lead to the label with enough support and confidence are kept, those that only
add tokens to a rule which already holds are pruned. Each rule stands in the index under its rarest token; a url meets
the rules of its tokens there, and blocks when it has all tokens of one. Listed host rules go before: the longest wins.

Labels are a column of 0 and 1. The driver's tables have none for urls, so :func:`text_label` marks pages whose text, not url,
holds a listed word; mining finds the url tokens that go with such pages, on the part of the ids that ``taught`` names.
:func:`precision_recall` measures the mined verdicts on the rest.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed; rows with a null label
teach nothing; repeated rows are judged one by one and teach as often as they stand; other columns are ignored; without
positive labels there are no rules; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, id_crc, staged

SUPPORT, CONFIDENCE, LONGEST = 0.001, 0.9, 4
#: Pages a rule must hold on at least, whatever share of all they are.
LEAST_PAGES = 5
LABEL = "#label"
#: Words of pages that nobody wants, and the rules given for all hosts as (verdict, host and path).
SEED_WORDS = ("adult", "bets", "casino", "porn", "spam")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def text_label(html: Column, words: Sequence[str] = SEED_WORDS) -> Column:
    """1 where the text of a page, without markup and scripts, holds a listed word, 0 elsewhere, null for no page."""
    text = F.regexp_replace(html.cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return text.rlike(rf"(?i)(?<![a-z0-9])({'|'.join(words)})(?![a-z0-9])").cast("int")


def taught(id_col: Column) -> Column:
    """Whether a page is of the two thirds that rules are learned from."""
    return id_crc(id_col) % 3 != 0


def precision_recall(judged: DataFrame, labels: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(n, positive, blocked, precision, recall) of the mined verdicts of pages without a listed rule; labels have the id and label."""
    rows = judged.filter("rule is null").join(labels.filter("label is not null"), id_col)
    block, bad = F.col("verdict") == "block", F.col("label") == 1
    return rows.agg(
        F.count("*").alias("n"), F.count_if(bad).alias("positive"), F.count_if(block).alias("blocked"),
        F.try_divide(F.count_if(block & bad), F.count_if(block)).alias("precision"), F.try_divide(F.count_if(block & bad), F.count_if(bad)).alias("recall"))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; null for none."""
    rule = verdict = F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        top, _, below = name.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, tokens, confidence, support): from (tokens, label) rows; minimal sets of tokens that lead to label 1."""
    items = F.when(F.col("label") == 1, F.concat("tokens", F.array(F.lit(LABEL)))).otherwise(F.col("tokens"))
    baskets = labelled.filter("label is not null").select(items.alias("items"))
    total, positive = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", LABEL))).first()
    schema = "rule long, tokens array<string>, confidence double, support double"
    if not positive:
        return labelled.sparkSession.createDataFrame([], schema)
    support = max(support, LEAST_PAGES / total)
    # Tokens that are frequent among positives are all a rule can hold; others are left out of the transactions.
    often = baskets.filter(F.array_contains("items", LABEL)).select(F.explode("items").alias("token")).groupBy("token").count()
    keep = [r.token for r in often.filter(F.col("count") >= support * total).select("token").collect()]  # 1/support per url token at most
    kept = baskets.select(F.array_intersect("items", F.array(*[F.lit(k) for k in keep])).alias("items"))
    partitions = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=partitions).fit(kept)
    rules = staged(model.associationRules.filter((F.element_at("consequent", 1) == LABEL) & (F.size("antecedent") <= LONGEST)).select(
        F.sort_array("antecedent").alias("tokens"), "confidence", "support"), "rules")
    # A rule falls when a part of it is a rule: all its parts are looked up, one equi-join.
    part = F.expr("filter(transform(sequence(1, (1 << size(tokens)) - 2), m -> filter(tokens, (t, i) -> (m >> i) & 1 = 1)), p -> size(p) > 0)")
    parts = rules.filter(F.size("tokens") > 1).select("tokens", F.explode(part).alias("part"))
    # Sorted, as in judged_urls: rules in compressed files are many more than their bytes tell.
    covered = parts.join(rules.select(F.col("tokens").alias("part")).hint("merge"), "part").select("tokens").distinct()
    return rules.join(covered, "tokens", "left_anti").select(F.xxhash64("tokens").alias("rule"), "tokens", "confidence", "support")


def judged_urls(pages: DataFrame, label: Column, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the number of mined rules the url meets."""
    url = F.col(url_col).cast("string")
    rows = staged(pages.select(
        F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"),
        label.alias("label")).withColumn("row", F.monotonically_increasing_id()), "urls")
    mined = staged(mined_rules(rows.select("tokens", "label")), "mined")
    counted = rows.select(F.explode("tokens").alias("token")).join(
        mined.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi").groupBy("token").count()
    # Inverted index: each rule under its rarest token, so no url meets more rules than it shares a rare token with.
    index = staged(mined.select("rule", F.col("tokens").alias("wanted"), F.explode("tokens").alias("token")).join(counted, "token", "left").groupBy("rule").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"), F.first("wanted").alias("wanted")), "index")
    # A planner that goes by the compressed files of the urls would broadcast them all, each with its tokens. Only the tokens of
    # the index may be, which are frequent ones; the urls that have one of them meet the rules in a sorted join.
    met = rows.filter("host <> ''").select("row", "tokens", F.explode("tokens").alias("token")).join(
        index.select("token").distinct(), "token", "left_semi").join(index.hint("merge"), "token")
    hits = met.filter(F.size(F.array_except("wanted", "tokens")) == 0).groupBy("row").agg(F.count("*").alias("n_rules"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(hits, "row", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))
