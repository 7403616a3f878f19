"""Quality rules: base counts, and the divergence of a document's histograms from those of its language.

A document's character-class histogram and its histogram over common words of its language are compared with the
references of that language by Jensen-Shannon distance (base 2, from 0 to 1). The references are summed over all documents
that pass the base rules. Each test has a guard of a least length below which its histogram says too little. The SQL of
the query counts common words alone and guards by their number; :func:`kept_documents` adds a bin for all other words.

Defined cases: null and empty texts have no words and fail the base rule; a null or unlisted language is judged by the
characters of all such documents together, and has no word test; repeated rows are judged one by one; other columns are
ignored by :func:`quality_rules` and passed through by :func:`kept_documents`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import staged, words_of

#: Frequent function words of each language, in natural order.
COMMON_WORDS = {
    "de": ("das", "den", "der", "die", "ein", "mit", "und", "von", "zu"),
    "en": ("a", "and", "for", "in", "is", "of", "that", "the", "to"),
    "es": ("de", "el", "en", "la", "las", "no", "que", "se", "y"),
    "fr": ("de", "des", "en", "et", "la", "le", "les", "que", "un"),
}
#: What is not an upper-case letter, a digit, punctuation or another symbol; white space and the rest follow.
CLASSES = (r"\P{Lu}+", r"\P{N}+", r"""[^.,;:!?'"()\-]+""", r"[\p{L}\p{N}\s.,;:!?'\"()\-]+")
MAX_CLASS_DISTANCE, MIN_CHARS = 0.3, 200
MAX_WORD_DISTANCE, MIN_COMMON = 0.45, 60
#: The word test with a bin for all other words: its guard is the length of the text, not what was found in it. Below 100
#: words these histograms are too noisy: clean texts of 60 words fail by chance.
MAX_WHOLE_DISTANCE, MIN_WHOLE = 0.22, 100


def _let(value: Column, body) -> Column:
    """``body(value)``; a lambda variable is evaluated once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the array ``w``.

    Windows are sorted as (hash, place), packed into one long for texts of usual length; equal neighbours in that order
    are repeats, and the sorted places of all repeats tell how many words they cover.
    """
    places, bits = 1 << 22, 22

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def packed(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, bits), bits).bitwiseOR(i.cast("long"))))
        place = F.transform(order, lambda x: x.bitwiseAND(F.lit(places - 1)).cast("int"))
        return _let(place, lambda s: F.filter(s, lambda x, i: (F.get(h, F.get(s, i - 1)) == F.get(h, x)) | (F.get(h, F.get(s, i + 1)) == F.get(h, x))))

    def paired(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return _let(order, lambda s: F.transform(F.filter(
            s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["p"]))

    def count(h: Column) -> Column:
        twice = F.when(F.size(h) < places, packed(h)).otherwise(paired(h))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(F.sort_array(twice), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows, count))


def measures(text: Column) -> dict[str, Column]:
    """Base counts, class counts and common words of a text without nulls.

    Rare characters are counted by what is left when all others go, which leaves the pattern few and long matches.
    """
    every = sorted({x for words in COMMON_WORDS.values() for x in words})
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "_words": _let(words_of(text), lambda w: F.struct(
            F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("r"),
            F.filter(w, lambda x: x.isin(every)).alias("common"))),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "_length": F.char_length(text),
        "_rare": _let(F.regexp_replace(text, r"[\p{Ll}\s]+", ""), lambda x: F.array(
            *[F.char_length(F.regexp_replace(x, c, "")) for c in CLASSES])),
    }


def _histograms(lang: Column) -> dict[str, Column]:
    """Character classes (each rare one, white space, the rest) and counts of the language's common words."""
    rare = [F.get("_rare", F.lit(i)) for i in range(len(CLASSES))]
    space = F.col("_length") - F.col("_words.chars")
    chosen = F.lit(None).cast("array<bigint>")
    for name, words in COMMON_WORDS.items():
        counts = F.array(*[F.size(F.filter("_words.common", F.lit(w).eqNullSafe)).cast("long") for w in words])
        chosen = F.when(lang == name, counts).otherwise(chosen)
    parts = [*rare, space, F.col("_length") - space - sum(rare[1:], rare[0])]
    return {"_classes": F.array(*[p.cast("long") for p in parts]), "_common": chosen}


def js_distance(counts: Column, reference: Column, bins: int) -> Column:
    """Jensen-Shannon distance of two count arrays; null where either is empty or null."""

    def total(a: Column) -> Column:
        return sum((F.get(a, F.lit(i)) for i in range(1, bins)), F.get(a, F.lit(0)))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def distance(p: Column, q: Column) -> Column:
        parts = []
        for i in range(bins):
            a, b = F.get(p, F.lit(i)), F.get(q, F.lit(i))
            parts.append(part(a, (a + b) / 2) + part(b, (a + b) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), sum(parts[1:], parts[0]) / 2))

    def shares(a: Column) -> Column:
        return F.transform(F.array(total(a)), lambda t: F.transform(a, lambda x: x / t))[0]

    both = F.array(F.struct(shares(counts).alias("p"), shares(reference).alias("q")))
    value = F.transform(both, lambda x: distance(x["p"], x["q"]))[0]
    return F.when((total(counts) > 0) & (total(reference) > 0), value)


def _measured(documents: DataFrame, text_col: str, lang_col: str, carry: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = F.when(F.col(lang_col).isin(list(COMMON_WORDS)), F.col(lang_col)).otherwise(F.lit(""))
    rows = documents.select(*carry, known.alias("_lang"), *[c.alias(n) for n, c in measures(text).items()])
    return rows.select(
        *carry, "_lang", *[c.alias(n) for n, c in _histograms(F.col("_lang")).items()],
        F.col("_words.n").cast("long").alias("n_words"), F.col("_words.chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("_words.r").cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _judged(measured: DataFrame, whole: bool = False) -> DataFrame:
    """``whole`` adds all words that are not common to the word histograms, and guards that test by n_words."""
    bins, words = len(CLASSES) + 2, len(next(iter(COMMON_WORDS.values())))
    if whole:
        found = F.aggregate("_common", F.lit(0).cast("long"), lambda t, x: t + x)
        measured, words = measured.withColumn("_common", F.concat("_common", F.array(F.col("n_words") - found))), words + 1
    reference = measured.filter("not base_failed").groupBy("_lang").agg(
        F.array(*[F.sum(F.get("_classes", F.lit(i))) for i in range(bins)]).alias("_ref_classes"),
        F.array(*[F.sum(F.get("_common", F.lit(i))) for i in range(words)]).alias("_ref_common"))
    # At most one reference row per listed language; written, so that Spark's own size check broadcasts it.
    joined = measured.join(staged(reference, "references"), "_lang", "left")
    chars = F.aggregate("_classes", F.lit(0).cast("long"), lambda t, x: t + x)
    common = F.coalesce(F.aggregate("_common", F.lit(0).cast("long"), lambda t, x: t + x), F.lit(0))
    long_enough, most = (F.col("n_words") >= MIN_WHOLE, MAX_WHOLE_DISTANCE) if whole else (common >= MIN_COMMON, MAX_WORD_DISTANCE)
    far = joined.select(
        "*", F.when(chars >= MIN_CHARS, js_distance(F.col("_classes"), F.col("_ref_classes"), bins)).alias("class_distance"),
        F.when(long_enough, js_distance(F.col("_common"), F.col("_ref_common"), words)).alias("word_distance"))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > most)
    return far.withColumn("kept", ~F.col("base_failed") & ~odd)


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = True) -> DataFrame:
    """Per row: the id, base counts, base_failed, both distances (null where guarded) and kept."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    measured = staged(_measured(docs, "text", "lang", ["doc_id"]), "quality")
    return _judged(measured, whole).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", "kept")


def kept_documents(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows the rules keep, with all their columns: each row is judged by the text it carries, no id is joined.

    The word test is the whole one: missing function words count, at any length from ``MIN_WHOLE`` words on.
    """
    packed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
        F.col(text_col).alias("_text"), F.col(lang_col).alias("_language"))
    measured = staged(_measured(packed, "_text", "_language", ["_row"]), "quality")
    return _judged(measured, whole=True).filter("kept").select("_row.*")
