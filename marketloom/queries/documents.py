"""Document queries: hashes, dates, numbers, links, titles, cleaning, filters, audits, set operations."""

from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import documents, ordering
from marketloom.queries.registry import query
from marketloom.sources import documents as document_source

# Whitespace class of the text functions, for the oracle side.
S = text.SPACE


def strip_sql(x):
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def clean_sql(x):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '[{S}]+', ' ', 'g'), '<[^>]+>', '', 'g'), "
            f"'[^{text.KEPT}]', '', 'g'), ' ')")


# Documents and pages of the test tables carry no dates or numbers, so both engines put the same ones in front.
FIELDS = """
f AS (SELECT doc_id, text, lang, source, publish_date, CAST(year(publish_date) AS VARCHAR) AS y, CAST(month(publish_date) AS VARCHAR) AS m,
        CAST(day(publish_date) AS VARCHAR) AS d FROM scored)
"""


def dated(t):
    d = F.col("publish_date")
    return t.scored.select(
        "doc_id", "text", "lang", "source", "publish_date", F.year(d).cast("string").alias("y"),
        F.month(d).cast("string").alias("m"), F.day(d).cast("string").alias("d"))


@query("F01_text_cleaning", f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages")
def _(t):
    return t.pages.select("page_id", text.clean_text("html").alias("cleaned"))


@query("F02_content_hash", """
SELECT page_id, md5(html) AS content_hash, substr(md5(url), 1, 16) AS doc_id FROM pages
""")
def _(t):
    return t.pages.select("page_id", text.content_hash("html").alias("content_hash"), text.short_id("url").alias("doc_id"))


@query("F03_date_extraction", f"""
WITH {FIELDS}, g AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(y, '年', m, '月', d, '日 ', y, '-01-01 ', text) WHEN 1 THEN concat(text, ' ', y, '-', m, '-', d)
    WHEN 2 THEN concat(y, '/', m, '/', d, ' ', text) WHEN 3 THEN concat(y, '-13-', d, ' ', y, '/1/1 ', text) ELSE text END AS body, publish_date FROM f)
SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN publish_date END AS found FROM g
""", ("scored",))
def _(t):
    k = F.col("doc_id") % 5
    body = (
        F.when(k == 0, F.concat("y", F.lit("年"), "m", F.lit("月"), "d", F.lit("日 "), "y", F.lit("-01-01 "), "text"))
        .when(k == 1, F.concat("text", F.lit(" "), "y", F.lit("-"), "m", F.lit("-"), "d"))
        .when(k == 2, F.concat("y", F.lit("/"), "m", F.lit("/"), "d", F.lit(" "), "text"))
        .when(k == 3, F.concat("y", F.lit("-13-"), "d", F.lit(" "), "y", F.lit("/1/1 "), "text")).otherwise(F.col("text")))
    return dated(t).select("doc_id", body.alias("body")).select("doc_id", text.extract_date("body").alias("found"))


@query("F04_date_fallbacks", f"""
WITH {FIELDS}
SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN publish_date WHEN doc_id % 6 = 2 AND month(publish_date) = 2 AND day(publish_date) = 29 THEN NULL
   WHEN doc_id % 6 = 2 THEN make_date(2022, month(publish_date), day(publish_date))
   WHEN doc_id % 6 = 3 THEN make_date(year(publish_date), month(publish_date), 1) WHEN doc_id % 6 = 4 THEN make_date(year(publish_date), 1, 1) END AS found FROM f
""", ("scored",))
def _(t):
    k = F.col("doc_id") % 6
    none = F.lit("")
    df = dated(t)
    two = lambda c: F.lpad(c, 2, "0")
    script = F.when(k == 0, F.concat(F.lit('var tm = "'), "y", F.lit("-"), two("m"), F.lit("-"), two("d"), F.lit(' 09:25:25";'))).otherwise(none)
    body = (
        F.when(k == 1, F.concat(F.lit("1990年1月1日 "), "text", F.lit(" "), "y", F.lit("年"), "m", F.lit("月"), "d", F.lit("日")))
        .when(k == 2, F.concat("m", F.lit("月"), "d", F.lit("日 "), "text")).otherwise(F.col("text")))
    url = F.when(k == 3, F.concat(F.lit("http://a.example.org/"), "y", two("m"), F.lit("/1.html"))).otherwise(F.lit("http://a.example.org/1.html"))
    title = F.when(k == 4, F.concat(F.lit("关于"), "y", F.lit("年安排的公告"))).otherwise(none)
    parts = df.select("doc_id", script.alias("script"), body.alias("body"), url.alias("url"), title.alias("title"))
    return parts.select("doc_id", text.publish_date("script", "body", "url", "title").alias("found"))


@query("F05_document_number", f"""
WITH {FIELDS}, g AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('京环发〔', y, '〕', doc_id, '号 ', text) WHEN 1 THEN concat('见国办函[', y, ']', doc_id, '号 ', text)
   WHEN 2 THEN concat('税务发〔', y, '〕', doc_id, '号 ', text) WHEN 3 THEN concat('公告 ', y, '年 第', doc_id, '号 ', text) ELSE text END AS body FROM f)
SELECT doc_id, coalesce(nullif(regexp_extract(body, '([京津沪渝冀豫云辽黑湘皖鲁苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][\\p{{L}}\\p{{N}}_]*[〔\\[]\\d{{4}}[〕\\]]\\d+号)', 1), ''),
   nullif(regexp_extract(body, '(国[\\p{{L}}\\p{{N}}_]*[〔\\[]\\d{{4}}[〕\\]]\\d+号)', 1), ''), nullif(regexp_extract(body, '(环[\\p{{L}}\\p{{N}}_]*[〔\\[]\\d{{4}}[〕\\]]\\d+号)', 1), ''),
   nullif(regexp_extract(body, '([\\p{{L}}\\p{{N}}_]+发[〔\\[]\\d{{4}}[〕\\]]\\d+号)', 1), ''), nullif(regexp_extract(body, '(第\\d+号)', 1), '')) AS number FROM g
""", ("scored",))
def _(t):
    k = F.col("doc_id") % 5
    mark = lambda head, a, b: F.concat(F.lit(head), "y", F.lit(a), F.col("doc_id").cast("string"), F.lit(b), "text")
    body = (
        F.when(k == 0, mark("京环发〔", "〕", "号 ")).when(k == 1, mark("见国办函[", "]", "号 "))
        .when(k == 2, mark("税务发〔", "〕", "号 ")).when(k == 3, mark("公告 ", "年 第", "号 ")).otherwise(F.col("text")))
    return dated(t).select("doc_id", body.alias("body")).select("doc_id", text.document_number("body").alias("number"))


@query("F06_url_normalisation", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
SELECT page_id, link, regexp_replace(regexp_replace(CASE WHEN link LIKE 'http%' THEN link ELSE concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), link) END, '#.*$', ''), ';[^/?]*(\\?|$)', '\\1') AS absolute,
       regexp_replace(regexp_replace(url, '#.*$', ''), ';[^/?]*(\\?|$)', '\\1') AS page_url FROM l
""")
def _(t):
    return t.pages.select("page_id", "url", F.explode(text.links("html")).alias("link")).select(
        "page_id", "link", text.absolute_url("link", "url").alias("absolute"), text.without_fragment("url").alias("page_url"))


RULES = (
    documents.Pattern("secret_line", r"token = \S+", source="src0"),
    documents.Pattern("first_line", r"^[A-Z][^\n]{0,40}\n", source="src1", flags=("DOTALL",)),
    documents.Pattern("short_lines", r"^.{1,20}$\n?", source="src2", flags=("MULTILINE",)),
    documents.Pattern("marks", r"(?:&&&|###|\$\$\$|%%%|\*\*\*)"),
    documents.Pattern("blank_lines", r"\n{2,}", "\n"),
    documents.Pattern("multiple_spaces", r" {2,}", " "),
)

CLEANED = """
WITH s0 AS (SELECT doc_id, source, lang, text, text AS x, [] :: VARCHAR[] AS fired FROM documents),
s1 AS (SELECT * REPLACE (CASE WHEN source = 'src0' THEN regexp_replace(x, 'token = \\S+', '', 'g') ELSE x END AS x,
         CASE WHEN source = 'src0' AND regexp_matches(x, 'token = \\S+') THEN list_append(fired, 'secret_line') ELSE fired END AS fired) FROM s0),
s2 AS (SELECT * REPLACE (CASE WHEN source = 'src1' THEN regexp_replace(x, '^[A-Z][^\\n]{0,40}\\n', '', 'gs') ELSE x END AS x,
         CASE WHEN source = 'src1' AND regexp_matches(x, '^[A-Z][^\\n]{0,40}\\n', 's') THEN list_append(fired, 'first_line') ELSE fired END AS fired) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN source = 'src2' THEN regexp_replace(x, '(?m)^[^\\n]{1,20}$\\n?', '', 'g') ELSE x END AS x,
         CASE WHEN source = 'src2' AND regexp_matches(x, '(?m)^[^\\n]{1,20}$') THEN list_append(fired, 'short_lines') ELSE fired END AS fired) FROM s2),
s4 AS (SELECT * REPLACE (regexp_replace(x, '(?:&&&|###|\\$\\$\\$|%%%|\\*\\*\\*)', '', 'g') AS x,
         CASE WHEN regexp_matches(x, '(?:&&&|###|\\$\\$\\$|%%%|\\*\\*\\*)') THEN list_append(fired, 'marks') ELSE fired END AS fired) FROM s3),
s5 AS (SELECT * REPLACE (regexp_replace(x, '\\n{2,}', chr(10), 'g') AS x, CASE WHEN regexp_matches(x, '\\n{2,}') THEN list_append(fired, 'blank_lines') ELSE fired END AS fired) FROM s4),
s6 AS (SELECT * REPLACE (regexp_replace(x, ' {2,}', ' ', 'g') AS x, CASE WHEN regexp_matches(x, ' {2,}') THEN list_append(fired, 'multiple_spaces') ELSE fired END AS fired) FROM s5),
c AS (SELECT doc_id, source, lang, text, """ + strip_sql("x") + """ AS cleaned, fired FROM s6),
r AS (SELECT *, length(text) - length(cleaned) AS removed FROM c)
"""


def cleaned(t, docs=None):
    return documents.clean((t.documents if docs is None else docs).withColumnRenamed("text", "content").drop("n_chars"), RULES)


@query("F07_cleaning_chain", CLEANED + """
SELECT doc_id, cleaned AS content, CASE WHEN removed > 0 THEN removed END AS chars_removed, CASE WHEN removed > 0 THEN array_to_string(fired, ',') END AS applied FROM r
""")
def _(t):
    return cleaned(t).select(
        "doc_id", "content", F.col("cleaning.chars_removed").alias("chars_removed"),
        F.when(F.col("cleaning").isNotNull(), F.concat_ws(",", "cleaning.patterns_applied")).alias("applied"))


CUT = {
    "marker": " of ", "prefixes": ("The ", "of "), "headers": (" and the ", " der "), "nav_words": ("the", "es", "en", "an"),
    "starts": ("in[a-z]+ ", "er[a-z]+ "), "footers": ("license", " under ", "thtion", "leau"),
}


@query("F08_boilerplate_cut", f"""
WITH a AS (SELECT doc_id, CASE WHEN substr(text, 1, 500) LIKE '% of %' THEN {strip_sql("substr(text, strpos(text, ' of ') + 4)")} ELSE text END AS x FROM documents),
b AS (SELECT doc_id, CASE WHEN starts_with(x, 'The ') THEN {strip_sql("substr(x, 5)")} ELSE x END AS x FROM a),
c AS (SELECT doc_id, CASE WHEN starts_with(x, 'of ') THEN {strip_sql("substr(x, 4)")} ELSE x END AS x FROM b),
d AS (SELECT doc_id, CASE WHEN contains(substr(x, 1, 300), ' and the ') THEN {strip_sql("substr(x, strpos(x, ' and the ') + 9)")} ELSE x END AS x FROM c),
e AS (SELECT doc_id, CASE WHEN contains(substr(x, 1, 300), ' der ') THEN {strip_sql("substr(x, strpos(x, ' der ') + 5)")} ELSE x END AS x FROM d),
f AS (SELECT doc_id, x, starts_with(x, 'the') OR starts_with(x, 'es') OR starts_with(x, 'en') OR starts_with(x, 'an') AS nav,
        CASE WHEN regexp_matches(x, 'in[a-z]+ ') THEN strpos(x, regexp_extract(x, 'in[a-z]+ ')) END AS p1,
        CASE WHEN regexp_matches(x, 'er[a-z]+ ') THEN strpos(x, regexp_extract(x, 'er[a-z]+ ')) END AS p2 FROM e),
g AS (SELECT doc_id, CASE WHEN nav AND coalesce(p1, p2) IS NOT NULL THEN substr(x, least(coalesce(p1, p2), coalesce(p2, p1))) ELSE x END AS x FROM f),
h AS (SELECT doc_id, x, list_filter([strpos(x, 'license'), strpos(x, ' under '), strpos(x, 'thtion'), strpos(x, 'leau')], lambda i: i > 1) AS cuts FROM g)
SELECT doc_id, CASE WHEN len(cuts) > 0 THEN substr(x, 1, cuts[1] - 1) ELSE x END AS body FROM h
""")
def _(t):
    return documents.boilerplate_cut(t.documents.select("doc_id", "text"), "text", **CUT).select("doc_id", "body")


def _title(expr):
    return f"CASE WHEN length({clean_sql(expr)}) > 5 AND NOT contains({clean_sql(expr)}, '您访问的链接') THEN {clean_sql(expr)} END"


@query("F09_title_choice", f"""
WITH p AS (SELECT page_id, {_title("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS a,
   {_title("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS b, {clean_sql("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS h, {clean_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS k, {clean_sql("html")} AS content FROM pages),
q AS (SELECT *, regexp_extract(content, '^([^。]+(?: the | la | der ))', 1) AS clause, substr(content, 1, 100) AS sentence FROM p)
SELECT page_id, coalesce(a, b, h, k) AS title, CASE WHEN length(content) > 20 THEN trim(CASE WHEN length(clause) > 0 THEN clause WHEN length(sentence) > 10 THEN sentence END, ' ') END AS from_content FROM q
""")
def _(t):
    pages = t.pages.select("page_id", "html", text.clean_text("html").alias("content"))
    return pages.select(
        "page_id", text.title_of("html").alias("title"), text.title_from_content("content", " the | la | der ").alias("from_content"))


def _plain_sql(x):
    """Markup off; the given pages hold no other references than these."""
    out = f"regexp_replace({x}, '(?s)<[/!?]?[a-zA-Z][^>]*>', '', 'g')"
    for name, letter in (("nbsp", "chr(160)"), ("copy", "'©'"), ("middot", "'·'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("amp", "'&'")):
        out = f"replace({out}, '&{name};', {letter})"
    return out


def _body_sql(containers, least=100):
    """Tags of a container's kind by place, their running depth from its start on, and what lies up to depth 0."""
    quiet = "html"
    for silent in ("<!--.*?-->", r"<script\b[^>]*>.*?</script\s*>", r"<style\b[^>]*>.*?</style\s*>"):
        quiet = f"regexp_replace({quiet}, '(?is){silent}', '', 'g')"
    steps, picks = [f"quiet AS (SELECT page_id, {quiet} AS page FROM pages)"], []
    for i, (tag, mark) in enumerate(containers):
        cut = rf"(?is)<{tag}(?:[\s/][^>]*)?>|</{tag}\s*>"
        hit = f"""regexp_matches(x, '(?is)\\s(class|id)\\s*=\\s*("{mark}"|''{mark}''|{mark}[\\s>])')""" if mark else "true"
        steps += [
            f"f{i} AS (SELECT page_id, regexp_extract_all(page, '({cut})', 1) AS f, string_split_regex(page, '{cut}') AS p FROM quiet)",
            f"s{i} AS (SELECT *, list_position(list_transform(f, lambda x: NOT starts_with(x, '</') AND {hit}), true) AS s FROM f{i})",
            f"d{i} AS (SELECT *, list_transform(range(s, len(f) + 1), lambda j: list_sum(list_transform(f[s:j], lambda x: CASE WHEN starts_with(x, '</') THEN -1 ELSE 1 END))) AS d FROM s{i} WHERE s > 0)",
            f"e{i} AS (SELECT *, coalesce(nullif(list_position(d, 0), 0), len(f) - s + 2) + s - 1 AS e FROM d{i})",
            f"m{i} AS (SELECT page_id, array_to_string(list_transform(range(s + 1, e + 1), lambda j: p[j] || CASE WHEN j < e THEN f[j] ELSE '' END), '') AS m FROM e{i})",
            f"t{i} AS (SELECT page_id, {_plain_sql('m')} AS t FROM m{i})"]
        picks.append(rf"CASE WHEN length(regexp_replace(t{i}.t, '^\s+|\s+$', '', 'g')) > {least} THEN t{i}.t END")
    joins = " ".join(f"LEFT JOIN t{i} USING (page_id)" for i in range(len(containers)))
    return f"WITH {', '.join(steps)}, b AS (SELECT page_id, coalesce({', '.join(picks)}, {_plain_sql('page')}) AS body FROM quiet {joins}) "


BODY = (("div", "content"), ("article", ""), ("div", "main-content"))


@query("F10_body_text", _body_sql(BODY) + f"SELECT page_id, {clean_sql('body')} AS body FROM b")
def _(t):
    return t.pages.select("page_id", text.clean_text(text.body_text("html", BODY)).alias("body"))


@query("F11_link_extraction", """
WITH l AS (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
SELECT DISTINCT concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), link) AS link FROM l WHERE regexp_matches(link, '^/[a-z]+[.,]?$')
""")
def _(t):
    return t.pages.select(F.explode(text.document_links("html", "url", "^/[a-z]+[.,]?$")).alias("link")).distinct()


@query("F12_integers_in_text", r"""
SELECT page_id, len(regexp_extract_all(html, '\d+')) :: BIGINT AS n_numbers, regexp_extract_all(html, '\d+')[1] AS first_number, regexp_extract_all(url, '\d+')[1] AS view_count FROM pages
""")
def _(t):
    numbers = text.integers("html")
    return t.pages.select(
        "page_id", F.size(numbers).cast("long").alias("n_numbers"), F.try_element_at(numbers, F.lit(1)).alias("first_number"),
        F.try_element_at(text.integers("url"), F.lit(1)).alias("view_count"))


@query("F13_label_strip", "SELECT doc_id, CAST(publish_date AS VARCHAR) AS published FROM scored", ("scored",))
def _(t):
    labelled = F.concat(F.when(F.col("doc_id") % 2 == 0, "发布时间：").otherwise("发布时间:"), F.lit("　"), F.col("publish_date").cast("string"), F.lit(" "))
    return t.scored.select("doc_id", text.without_label(labelled).alias("published"))


def stamped(t):
    k, day = F.col("doc_id") % 4, F.col("publish_date").cast("string")
    return t.scored.select("doc_id", "source", (
        F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T10:20:30"))).when(k == 2, F.concat(F.lit("on "), day))
    ).alias("published"))


@query("F14_iso_date", "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN publish_date END AS day FROM scored", ("scored",))
def _(t):
    return stamped(t).select("doc_id", text.iso_date("published").alias("day"))


@query("F15_publication_lag", "SELECT doc_id, publish_date + 1 AS effective_date FROM scored", ("scored",))
def _(t):
    return t.scored.select("doc_id", F.date_add("publish_date", 1).alias("effective_date"))


@query("F16_truncation", "SELECT doc_id, concat(substr(text, 1, 500), '...') AS preview, concat(substr(text, 1, 100), '...') AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", text.truncated("text", 500).alias("preview"), text.truncated("text", 100).alias("short"))


@query("F25_fixed_batches", """
SELECT doc_id, source, CAST(floor((row_number() OVER (ORDER BY source, doc_id) - 1) / 20) AS BIGINT) AS batch FROM documents
""")
def _(t):
    return ordering.batches(t.documents.select("doc_id", "source"), ["source", "doc_id"], 20)


@query("F26_cue_words", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(license|under)') THEN 'mandatory' WHEN regexp_matches(text, '(thth|eaux)') THEN 'binding'
   WHEN regexp_matches(text, '(osos|lich)') THEN 'encouraged' ELSE 'informational' END AS level FROM documents
""")
def _(t):
    cues = (("mandatory", ("license", "under")), ("binding", ("thth", "eaux")), ("encouraged", ("osos", "lich")))
    return t.documents.select("doc_id", text.enforcement("text", cues).alias("level"))


@query("F27_captured_or_default", r"""
SELECT page_id, coalesce(nullif(regexp_extract(html, 'track\((\d+)\)', 1), ''), '8597') AS tracked, coalesce(nullif(regexp_extract(url, 'page=(\d+)', 1), ''), '8597') AS page FROM pages
""")
def _(t):
    return t.pages.select(
        "page_id", text.captured("html", r"track\((\d+)\)", "8597").alias("tracked"), text.captured("url", r"page=(\d+)", "8597").alias("page"))


@query("P12_keyword_filter", "SELECT doc_id FROM documents WHERE contains(concat(lower(source), lower(text)), 'license')")
def _(t):
    return t.documents.filter(text.has_keyword("source", "text", "License")).select("doc_id")


@query("P13_training_cutoff", "SELECT doc_id FROM scored WHERE doc_id % 4 < 2 AND publish_date <= DATE '1998-12-31'", ("scored",))
def _(t):
    return documents.before_cutoff(stamped(t), "1998-12-31", F.col("published")).select("doc_id")


@query("P15_document_url", """
SELECT page_id, url, NOT regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|css|js|ico)$') AND regexp_matches(lower(url), '(\\.html|\\.htm|\\.pdf|\\.doc|\\.docx|article|content|detail)') AS valid FROM pages
""")
def _(t):
    return t.pages.select("page_id", "url", text.is_document_url("url").alias("valid"))


@query("P16_placeholder_content", f"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[{S}]+'), lambda x: length(x) > 0) AS words FROM documents)
SELECT doc_id, CASE WHEN len(words) > 0 AND len(list_filter(words, lambda x: contains(x, 'th') OR contains(x, 'ea'))) > len(words) * 0.5 THEN '[No article content available - only navigation]'
   WHEN length(text) < 50 THEN '[Image-based content - text extraction limited]' WHEN length(text) < 20 THEN '[Limited text content available]' ELSE text END AS content FROM w
""")
def _(t):
    return documents.with_placeholders(t.documents, "text", ("th", "ea"), image_below=50).select("doc_id", "content")


@query("A21_distinct_documents", """
SELECT md5(text) AS content_id, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)
""")
def _(t):
    df = t.documents.select(F.md5("text").alias("content_id"), "doc_id", "source")
    return ordering.first_per_key(df, ["content_id"], ["doc_id"])


@query("A22_cleaning_audit", CLEANED + """
SELECT source, lang, count(*) AS documents, CAST(count_if(removed > 0) AS BIGINT) AS cleaned, CAST(sum(CASE WHEN removed > 0 THEN removed ELSE 0 END) AS BIGINT) AS chars_removed,
       R6(coalesce(avg(CASE WHEN removed > 0 THEN removed END), 0)) AS avg_removed,
       CAST(count_if(contains(lower(text), 'license')) AS BIGINT) AS matched, R6(100 * avg(CASE WHEN contains(lower(text), 'license') THEN 1.0 ELSE 0.0 END)) AS retention_pct
FROM r GROUP BY ROLLUP (source, lang)
""")
def _(t):
    # The keyword is looked for in the text as it came; it travels beside the cleaned one.
    marked = t.documents.withColumn("_kept", text.has_keyword(F.lit(""), "text", "license"))
    audit = documents.cleaning_audit(cleaned(t, marked), ["source", "lang"], F.col("_kept"))
    return audit.withColumns({c: F.round(c, 6) for c in ("avg_removed", "retention_pct")})


@query("A23_corpus_statistics", """
SELECT source, lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, date_diff('day', min(publish_date), max(publish_date)) AS span_days,
       R6(count(*) / nullif(date_diff('day', min(publish_date), max(publish_date)), 0)) AS docs_per_day
FROM scored GROUP BY GROUPING SETS ((source, lang), (source), ())
""", ("scored",))
def _(t):
    return documents.corpus_statistics(t.scored).withColumn("docs_per_day", F.round("docs_per_day", 6))


@query("T05_pattern_usage", CLEANED + "SELECT p AS pattern, count(*) AS n FROM (SELECT unnest(fired) AS p FROM r WHERE removed > 0) GROUP BY p ORDER BY n DESC")
def _(t):
    return documents.pattern_usage(cleaned(t)).orderBy(F.desc("n"), "pattern")


@query("A30_section_statistics", """
SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS section, CAST(count_if(length(html) >= 3000) AS BIGINT) AS success, CAST(count_if(length(html) < 2000) AS BIGINT) AS failed,
       CAST(count_if(length(html) >= 2000 AND length(html) < 3000) AS BIGINT) AS skipped FROM pages GROUP BY 1
""")
def _(t):
    log = t.pages.select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("section"), (
        F.when(F.length("html") < 2000, "failed").when(F.length("html") < 3000, "skipped").otherwise("success")).alias("status"))
    return document_source.run_statistics(log, "section")


@query("J07_unseen_links", """
WITH l AS (SELECT DISTINCT concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), unnest(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS link FROM pages)
SELECT link FROM l WHERE link NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages)
""")
def _(t):
    seen = t.pages.select(text.without_fragment("url").alias("link"))
    return page_links(t).distinct().join(seen, "link", "left_anti")


def page_links(t):
    return t.pages.select("url", F.explode(text.links("html")).alias("l")).select(text.absolute_url("l", "url").alias("link"))


@query("T02_links_per_page", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages),
u AS (SELECT page_id, link, min(i) AS i FROM l GROUP BY page_id, link),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos FROM u)
SELECT page_id, link, pos FROM r WHERE pos <= 15
""")
def _(t):
    found = t.pages.select("page_id", F.posexplode(F.slice(F.array_distinct(text.links("html")), 1, 15)).alias("i", "link"))
    return found.select("page_id", "link", (F.col("i") + 1).cast("long").alias("pos"))


def _slice_sql(low, high):
    place = "row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY market) AS n"
    return f"SELECT market, date, close FROM (SELECT market, date, close, {place} FROM px) WHERE i >= {low} AND i < {high}"


@query("T02_series_head", _slice_sql("0", "20"), ("px",))
def _(t):
    return ordering.sliced(t.px.select("market", "date", "close"), ["market"], ["date"], stop=20)


@query("T02_series_tail", _slice_sql("n - 20", "n"), ("px",))
def _(t):
    return ordering.sliced(t.px.select("market", "date", "close"), ["market"], ["date"], start=-20)


@query("T02_series_slice", _slice_sql("30", "n - 30"), ("px",))
def _(t):
    return ordering.sliced(t.px.select("market", "date", "close"), ["market"], ["date"], 30, -30)


@query("T02_document_limit", "SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 50")
def _(t):
    return t.documents.select("doc_id", "source", "lang").orderBy("doc_id").limit(50)


@query("U01_union_of_tables", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def _(t):
    from marketloom.operators.cleaning import union_all

    return union_all([
        t.documents.select(F.col("doc_id").alias("id"), "text", "lang"), t.benchmark.select(F.col("item_id").alias("id"), "text")])


LINKS = "WITH l AS (SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS link FROM pages)"


@query("U03_difference", LINKS + " SELECT link FROM l EXCEPT ALL SELECT link FROM l WHERE link LIKE 'https://%'")
def _(t):
    all_links = page_links(t)
    return all_links.exceptAll(all_links.filter(F.col("link").startswith("https://")))


@query("U04_distinct_links", LINKS + " SELECT link, min(page_id) AS first_page FROM l GROUP BY link")
def _(t):
    rows = t.pages.select("page_id", "url", F.explode(text.links("html")).alias("l")).select("page_id", text.absolute_url("l", "url").alias("link"))
    return rows.groupBy("link").agg(F.min("page_id").alias("first_page")).orderBy("first_page", "link")
