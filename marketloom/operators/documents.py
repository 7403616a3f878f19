"""Document cleaning, filtering, audits and deduplication over the whole corpus."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text


@dataclass(frozen=True)
class Pattern:
    """One cleaning rule; without a source it applies to every document, after the source's own rules."""

    name: str
    pattern: str
    replacement: str = ""
    source: str | None = None
    flags: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        marks = "".join({"DOTALL": "s", "MULTILINE": "m", "IGNORECASE": "i"}[f] for f in self.flags)
        return f"(?{marks}){self.pattern}" if marks else self.pattern


def clean(df: DataFrame, patterns: Sequence[Pattern], content: str = "content", source: str = "source") -> DataFrame:
    """Apply the rules in order, trim, and record what was removed and which rules fired.

    ``cleaning`` is a struct of lengths and rule names, null when nothing was removed.
    """
    out = df.withColumn("_text", F.coalesce(F.col(content), F.lit("")))
    ordered = [p for p in patterns if p.source] + [p for p in patterns if not p.source]
    # One reference to the text per step keeps the expression linear when a filter is pushed through the steps.
    for n, p in enumerate(ordered):
        replaced = F.regexp_replace("_text", p.regex, p.replacement)
        hit = F.col("_text").rlike(p.regex)
        if p.source:
            mine = F.col(source) == p.source
            hit, replaced = mine & hit, F.when(mine, replaced).otherwise(F.col("_text"))
        out = out.withColumns({f"_hit{n}": hit, "_text": replaced})
    fired = F.array_compact(F.array(*[F.when(F.col(f"_hit{n}"), p.name) for n, p in enumerate(ordered)]))
    out = out.withColumn("_fired", fired)
    final = text.strip("_text")
    removed = F.length(content) - F.length("_clean")
    meta = F.struct(
        F.length(content).cast("long").alias("original_length"), F.length("_clean").cast("long").alias("cleaned_length"),
        removed.cast("long").alias("chars_removed"), F.col("_fired").alias("patterns_applied"))
    return (
        out.withColumn("_clean", final).withColumn("cleaning", F.when(removed > 0, meta))
        .withColumn(content, F.col("_clean"))
        .drop("_text", "_fired", "_clean", *[f"_hit{n}" for n in range(len(ordered))]))


def cleaning_audit(cleaned: DataFrame, keys: Sequence[str], kept: Column | None = None) -> DataFrame:
    """Documents, documents cleaned and characters removed per level of the keys and overall; with ``kept``, also the
    documents it holds for and their share.

    Documents are reduced to one row per key combination first, in one pass; the levels are rolled up from those.
    """
    removed = F.coalesce(F.col("cleaning.chars_removed"), F.lit(0))
    matched = [] if kept is None else [F.count_if(kept).alias("_m")]
    base = cleaned.groupBy(*keys).agg(
        F.count("*").alias("_d"), F.count_if(removed > 0).alias("_c"), F.sum(removed).alias("_r"), *matched)
    shares = [] if kept is None else [F.sum("_m").alias("matched"), (100 * F.try_divide(F.sum("_m"), F.sum("_d"))).alias("retention_pct")]
    return base.rollup(*keys).agg(
        F.sum("_d").alias("documents"), F.sum("_c").alias("cleaned"), F.sum("_r").alias("chars_removed"),
        F.coalesce(F.try_divide(F.sum("_r"), F.sum("_c")), F.lit(0.0)).alias("avg_removed"), *shares)


def pattern_usage(cleaned: DataFrame) -> DataFrame:
    """Documents per rule that fired. The outer form adds no filter that would repeat the cleaning steps."""
    fired = cleaned.select(F.explode_outer("cleaning.patterns_applied").alias("pattern"))
    return fired.filter(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count("*").alias("n"))


def filter_audit(df: DataFrame, keys: Sequence[str], kept: Column) -> DataFrame:
    """Totals, matches and retention per level of the keys and overall."""
    base = df.groupBy(*keys).agg(F.count("*").alias("_t"), F.count_if(kept).alias("_m"))
    return base.rollup(*keys).agg(
        F.sum("_t").alias("total"), F.sum("_m").alias("matched"),
        (100 * F.try_divide(F.sum("_m"), F.sum("_t"))).alias("retention_pct"))


def corpus_statistics(df: DataFrame, source: str = "source", category: str = "lang", content: str = "text",
                      date: str = "publish_date") -> DataFrame:
    """Documents, characters, span in days and documents per day by source and category, by source, and overall."""
    base = df.groupBy(source, category).agg(
        F.count("*").alias("_n"), F.sum(F.length(content)).alias("_c"), F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    span = F.datediff(F.max("_hi"), F.min("_lo"))
    return base.groupingSets(
        [(F.col(source), F.col(category)), (F.col(source),), ()], F.col(source), F.col(category)
    ).agg(
        F.sum("_n").alias("documents"), F.sum("_c").alias("chars"), span.cast("long").alias("span_days"),
        F.try_divide(F.sum("_n"), span).alias("docs_per_day"))


def before_cutoff(df: DataFrame, cutoff: str, published: Column) -> DataFrame:
    """Documents with a parseable publish date up to the cutoff; missing and bad dates go."""
    return df.filter(text.iso_date(published) <= F.lit(cutoff).cast("date"))


def boilerplate_cut(df: DataFrame, content: str, marker: str, prefixes: Sequence[str], headers: Sequence[str],
                    nav_words: Sequence[str], starts: Sequence[str], footers: Sequence[str], out: str = "body") -> DataFrame:
    """Body of a page text: what follows the marker, prefixes and navigation headers, from the earliest start form
    where navigation still leads, up to the first listed footer."""
    c = F.col("_body")

    def after(mark: str) -> Column:
        return text.strip(F.substring(c, F.instr(c, mark) + len(mark), F.length(c)))

    step = df.withColumn("_body", F.col(content))
    step = step.withColumn("_body", F.when(F.contains(F.substring(c, 1, 500), F.lit(marker)), after(marker)).otherwise(c))
    for p in prefixes:
        rest = text.strip(F.substring(c, F.lit(len(p) + 1), F.length(c)))
        step = step.withColumn("_body", F.when(c.startswith(p), rest).otherwise(c))
    for h in headers:
        step = step.withColumn("_body", F.when(F.contains(F.substring(c, 1, 300), F.lit(h)), after(h)).otherwise(c))
    leading = F.exists(F.array(*[F.lit(n) for n in nav_words]), lambda n: F.startswith(c, n))
    found = F.filter(F.array(*[F.regexp_instr(c, F.lit(s)) for s in starts]), lambda i: i > 0)
    step = step.withColumn("_start", F.when(leading, F.array_min(found)))
    step = step.withColumn("_body", F.when(F.col("_start") > 0, F.substring(c, F.col("_start"), F.length(c))).otherwise(c))
    cuts = F.filter(F.array(*[F.instr(c, f) for f in footers]), lambda i: i > 1)
    step = step.withColumn("_end", F.try_element_at(cuts, F.lit(1)))
    body = F.when(F.col("_end") > 1, F.substring(c, F.lit(1), F.col("_end") - 1)).otherwise(c)
    return step.withColumn(out, body).drop("_body", "_start", "_end")


# Notices that stand for a content that is missing, pictured or too short.
ONLY_NAVIGATION = "[No article content available - only navigation]"
IMAGE_BASED = "[Image-based content - text extraction limited]"
TOO_SHORT = "[Limited text content available]"


def with_placeholders(df: DataFrame, content: str, nav_words: Sequence[str], short: int = 20, image_below: int | None = None,
                      out: str = "content") -> DataFrame:
    """Content, or a notice when more than half of its words hold a navigation word, or when it is too short."""
    bare = text.strip(content)
    words = F.when(F.length(bare) > 0, F.split(bare, f"[{text.SPACE}]+"))
    nav = F.filter("_words", lambda w: reduce(lambda a, b: a | b, [F.contains(w, F.lit(n)) for n in nav_words]))
    notice = F.when(F.size("_nav") > F.size("_words") * 0.5, ONLY_NAVIGATION)
    if image_below is not None:
        notice = notice.when(F.length(content) < image_below, IMAGE_BASED)
    return (
        df.withColumn("_words", words).withColumn("_nav", nav)
        .withColumn(out, notice.when(F.length(content) < short, TOO_SHORT).otherwise(F.col(content))).drop("_words", "_nav"))
