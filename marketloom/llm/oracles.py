"""DuckDB SQL with the results of the registered queries, where SQL can express them."""

from __future__ import annotations

from marketloom.llm.licenses import CONTAINMENT, SHINGLE, TEMPLATES, classes, template_shingles, template_words
from marketloom.llm.mixing import BUDGET_SHARE, DEFAULT_WEIGHT, MAX_EPOCHS, SEED, WEIGHTS
from marketloom.llm.quality import COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WHOLE_DISTANCE, MIN_CHARS, MIN_WHOLE

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{_WORD}')"


_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BENCH_WORD}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BENCH_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_window AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM item_window),
doc_window AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_window d JOIN item_window i USING (n, win)),
word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_words(_LOWER.format("text"))} AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(3, len(w)) - 1], chr(10)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * k >= 90 * (s.n + t.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS start, x AS node FROM edge UNION SELECT r.start, e.y FROM reach r JOIN edge e ON e.x = r.node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM doc d LEFT JOIN size s USING (doc_id) LEFT JOIN (SELECT start, min(node) AS root FROM reach GROUP BY start) r ON r.start = d.doc_id
"""


def _op7() -> str:
    lang = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS["lang"].items()) + f" ELSE {DEFAULT_WEIGHT} END"
    steps, parents = [], ["root"]
    for name, weight in (("domain", str(DEFAULT_WEIGHT)), ("lang", lang), ("source", str(DEFAULT_WEIGHT))):
        keys = [k for k in parents if k != "root"] + [name]
        by, above = ", ".join(parents), f"b{len(parents) - 1}"
        on = " AND ".join(f"n.{p} IS NOT DISTINCT FROM u.{p}" for p in parents)
        steps.append(f"""n{len(parents)} AS (SELECT root, {', '.join(keys)}, sum(cap)::BIGINT AS capacity, {weight}::BIGINT AS weight FROM leaf GROUP BY ALL),
f{len(parents)} AS (SELECT n.*, u.granted AS budget, n.capacity / n.weight AS fill FROM n{len(parents)} n JOIN {above} u ON {on}),
g{len(parents)} AS (SELECT *, sum(capacity) OVER o + fill * (sum(weight) OVER (PARTITION BY {by}) - sum(weight) OVER o) <= budget AS full_
  FROM f{len(parents)} WINDOW o AS (PARTITION BY {by} ORDER BY fill, {name} NULLS FIRST ROWS UNBOUNDED PRECEDING)),
b{len(parents)} AS (SELECT root, {', '.join(keys)}, CASE WHEN full_ THEN capacity ELSE least(capacity, floor(
  (budget - coalesce(sum(capacity) FILTER (full_) OVER (PARTITION BY {by}), 0)) / (sum(weight) FILTER (NOT full_) OVER (PARTITION BY {by})) * weight)::BIGINT) END AS granted
  FROM g{len(parents)})""")
        parents.append(name)
    tree = ",\n".join(steps)
    return f"""
WITH doc AS (SELECT 0 AS root, doc_id, 'domain' || coalesce((nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '')[-1]::INT % 3)::VARCHAR, '') AS domain,
  lang, source, len({_words("text")})::BIGINT AS n_tokens, md5(coalesce(text, '')) AS digest FROM documents),
leaf AS (SELECT root, domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {MAX_EPOCHS} * sum(n_tokens)::BIGINT AS cap FROM doc GROUP BY ALL),
b0 AS (SELECT 0 AS root, floor(sum(tokens)::DOUBLE * {BUDGET_SHARE})::BIGINT AS granted FROM leaf),
{tree},
cut AS (SELECT l.*, CASE WHEN tokens > 0 THEN granted // tokens ELSE {MAX_EPOCHS} END AS passes, CASE WHEN tokens > 0 THEN granted % tokens ELSE 0 END AS rest
  FROM leaf l JOIN b3 u ON l.domain IS NOT DISTINCT FROM u.domain AND l.lang IS NOT DISTINCT FROM u.lang AND l.source IS NOT DISTINCT FROM u.source),
placed AS (SELECT d.*, c.passes, c.rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
  ORDER BY md5(concat_ws('-', '{SEED}', c.passes::VARCHAR, doc_id::VARCHAR)), doc_id, digest ROWS UNBOUNDED PRECEDING) AS upto
  FROM doc d JOIN cut c ON d.domain IS NOT DISTINCT FROM c.domain AND d.lang IS NOT DISTINCT FROM c.lang AND d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, domain, lang, source, n_tokens, (passes + CASE WHEN upto <= rest AND passes < {MAX_EPOCHS} THEN 1 ELSE 0 END)::BIGINT AS epochs FROM placed
"""


def _op8() -> str:
    def js(p: str, q: str) -> str:
        p, q = f"list_transform({p}, lambda x: x / list_sum({p}))", f"list_transform({q}, lambda x: x / list_sum({q}))"
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((a + b) / 2)) ELSE 0 END"
        zipped = f"list_transform(list_zip({p}, {q}), lambda z: struct_pack(a := z[1], b := z[2]))"
        one = part.replace("{0}", "z.a").replace("a + b", "z.a + z.b") + " + " + part.replace("{0}", "z.b").replace("a + b", "z.a + z.b")
        return f"sqrt(greatest(0, list_sum(list_transform({zipped}, lambda z: {one})) / 2))"

    common = "CASE lang " + " ".join(
        f"WHEN '{k}' THEN [{', '.join(f'''len(list_filter(w, lambda x: x = '{x}'))''' for x in v)}]" for k, v in COMMON_WORDS.items()) + " END"
    listed = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    bins, words = 6, len(COMMON_WORDS["en"]) + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    return rf"""
WITH doc AS (SELECT doc_id, CASE WHEN lang IN ({listed}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS text, {_words("text")} AS w FROM documents),
win AS (SELECT doc_id, p, w[p:p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM doc WHERE len(w) >= 3)),
twice AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS at FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM doc)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  {common} AS common, length(text) AS len_, [length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')), length(regexp_replace(text, '[^\p{{N}}]+', '', 'g')),
  length(regexp_replace(text, '[^.,;:!?''"()\-]+', '', 'g')), length(regexp_replace(text, '[\p{{L}}\p{{N}}\s\x0B.,;:!?''"()\-]+', '', 'g'))] AS rare
  FROM doc d LEFT JOIN line l USING (doc_id) LEFT JOIN rep r USING (doc_id)),
full_ AS (SELECT * REPLACE (common || [n_words - list_sum(common)] AS common), rare || [len_ - word_chars, word_chars - list_sum(rare)] AS cls, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
ref AS (SELECT lang, {sums("cls", bins)} AS rc, {sums("common", words)} AS rw FROM full_ WHERE NOT base_failed GROUP BY lang),
far AS (SELECT f.*, CASE WHEN list_sum(cls) >= {MIN_CHARS} THEN {js("cls", "rc")} END AS cd,
  CASE WHEN n_words >= {MIN_WHOLE} THEN {js("common", "rw")} END AS wd FROM full_ f LEFT JOIN ref USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= {MAX_WHOLE_DISTANCE} AS kept FROM far
"""


OP2 = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha256(html) AS d FROM page),
first AS (SELECT d, min(page_id) AS f FROM sized WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN f IS NULL OR page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to FROM sized LEFT JOIN first USING (d)
"""


def _op3() -> str:
    arms = []
    for group in classes(TEMPLATES):
        longest = max(len(template_words(t)) for t in group.values())
        listed = ", ".join(f"('{k}', {template_shingles(t)!r})" for k, t in group.items())
        arms.append(f"""SELECT doc_id, k AS template, max(n_found) AS n_found, any_value(len(t))::BIGINT AS n_template FROM (
  SELECT doc_id, k, t, len(list_intersect(list_transform(range(1, len(v) - {SHINGLE - 2}), lambda i: array_to_string(v[i:i + {SHINGLE - 1}], ' ')), t))::BIGINT AS n_found
  FROM (SELECT doc_id, w[p:p + {2 * longest - 1}] AS v FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1, {longest})) AS p FROM doc WHERE len(w) >= {SHINGLE})), (VALUES {listed}) AS x(k, t)
  WHERE len(v) >= {SHINGLE}) WHERE n_found >= {CONTAINMENT} * len(t) GROUP BY doc_id, k""")
    union = " UNION ALL ".join(arms)
    return f"""WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, template, n_found, n_template, n_found / n_template AS containment FROM ({union})"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS w FROM documents WHERE text IS NOT NULL),
size AS (SELECT doc_id, len(w)::BIGINT AS n FROM doc WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
asked AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ask AS (SELECT item_id, t, count(*)::BIGINT AS k FROM asked GROUP BY ALL),
post AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM doc) SEMI JOIN ask USING (t) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, whole GROUP BY t, n_docs),
part AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS c FROM post JOIN size USING (doc_id) JOIN weight USING (t), whole),
score AS (SELECT item_id, doc_id, sum(k * c)::BIGINT AS score FROM ask JOIN part USING (t) GROUP BY ALL HAVING sum(k * c) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score) WHERE rank <= 10
"""


ORACLES: dict[str, str] = {
    "op13_lexical_search": OP13,
    "op2_warc_normaliser": OP2, "op3_license_scan": _op3(), "op4_benchmark_decontamination": OP4, "op6_ngram_jaccard_join": OP6, "op7_source_mixing": _op7(), "op8_quality_rules": _op8()}
