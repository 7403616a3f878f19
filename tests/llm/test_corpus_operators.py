"""Corpus operators on small tables: defined cases, brute force, and the registered SQL."""

import gzip
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import oracle
import plans
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from marketloom.llm import brown, contamination, jaccard, licenses, mixing, quality, sharding, toxicity, urls, warc
from marketloom.llm.common import components
from marketloom.llm.queries import ORACLES, QUERIES, mixing_levels

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _row string, shard int"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, columns of clashing names."""
    rows = [
        (1, "One two three four. " * 30, "en", "src1", 9, 7, "x", 3), (1, "One two three four. " * 30, "en", "src1", 9, 7, "x", 3), (2, "", "en", "src2", 0, 7, "x", 3),
        (3, None, None, None, None, None, None, None), (None, "no id here at all", "de", "src0", 4, 7, "x", 3), (5, LONG, "fr", "src0", 4, 7, "x", 3),
        (6, LONG.upper(), "xx", "other", 4, 7, "x", 3), (7, " \t\n ", "es", "src3", 4, 7, "x", 3), (8, "one", "en", "src1", 3, 7, "x", 3)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "one two"), (3, None), (4, ""), (None, "four one"), (2, "one two")], "item_id long, text string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    assert oracle.compare(got, oracle.connect(SMALL).execute(ORACLES[name]).to_arrow_table()) is None


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(300)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"plain words here n{i}. you are a vilestuff{i % 7} today" if i % 2 else f"plain words here n{i} and nothing else") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 300 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert held and all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in held)
    assert toxicity.toxicity_scores(odd, labels).count() == 9 and toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}


def test_grammar_reads_clauses():
    weight = lambda w: 8.0 if w == "vile" else 0.0
    read = lambda text: dict(zip(toxicity.FEATURES, toxicity.clause_features(text, weight)))
    assert read("it is vile")["insult"] > 0 and read("not so vile")["negated"] > 0 and read("not so vile")["insult"] == 0
    assert read("she said it was vile")["reported"] > 0 and read("not good. it is vile")["negated"] == 0
    assert read("you are vile")["aimed"] > 0 and read(None) == read("") == dict.fromkeys(toxicity.FEATURES, 0.0)


def test_warc_round_trip(spark):
    long = "<p>x</p>" * 20_000
    data = [(1, "http://a/\r\nx", "é" * 80), (2, None, "é" * 80), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "é" * 80), (8, "u", long + "\r\n\r\n"), (1, "again", "é" * 80)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = rows(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html in data:
        raw = (html or "").encode()
        again = raw == ("é" * 80).encode() and i != 1
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_normalised_archive_has_one_member_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<b>{i}</b>" * (i + 20)) for i in range(50)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "whole"))
    index = warc.normalise(spark, str(tmp_path / "whole"), str(tmp_path / "members")).collect()
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "whole").glob("*.gz")))
    joined = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "members").glob("*.gz")))
    assert whole == joined and len(index) == 50
    for r in index:
        raw = open(r.archive, "rb").read()[r.offset: r.offset + r.length]
        assert f"<urn:page:{r.page_id}>".encode() in zlib.decompress(raw, 31)


def test_licenses(spark, odd, empty):
    notice = licenses.TEMPLATES["MIT-notice"]
    broken = notice.replace("hereby", "now").replace("sublicense", "resell")
    docs = spark.createDataFrame([(1, "x " * 500 + notice + " y" * 90), (2, broken), (3, "Released under the MIT License."), (4, "the license of nobody"), (None, notice), (6, None)], "doc_id long, text string")
    got = {(r.doc_id, r.template): round(r.containment, 3) for r in licenses.license_matches(docs).collect()}
    assert got[1, "MIT-notice"] == 1 and 0.8 <= got[2, "MIT-notice"] < 1 and got[3, "MIT"] == 1 and (None, "MIT-notice") in got
    assert not [k for k in got if k[0] in (4, 6)]
    glued = spark.createDataFrame([(1, f"é{notice.replace(' ', '_')}é"), (2, notice.upper())], "doc_id long, text string")
    assert sorted((r.doc_id, r.template) for r in licenses.license_matches(glued).collect()) == [(1, "MIT-notice"), (2, "MIT-notice")]
    assert licenses.license_matches(odd).count() == 0 and licenses.license_matches(empty).count() == 0
    for group in licenses.classes(licenses.TEMPLATES):
        sizes = [len(licenses.template_words(t)) for t in group.values()]
        w, t = 2 * max(sizes) - 4, min(sizes) - 4
        assert 1 - (1 - 0.8 * t / (w + t - 0.8 * t)) ** licenses.bands(max(sizes), min(sizes)) >= licenses.SURE


def test_decontamination(odd, empty, items):
    whole = contamination.judged(contamination.scan(odd, items))
    got = {r.doc_id: r for r in whole.collect()}
    assert got[1].n_hit == 60 and got[1].items == ["2"] and got[2].n_words == 0 and not got[3].contaminated and got[8].n_hit == 0
    assert got[5].n_words == 40_000 and got[5].items == ["1"] and got[5].n_hit == 20 * len(range(0, 40_000, 977)) and not got[5].contaminated
    text = odd.filter("doc_id = 5").first().text
    assert all(text[s["start"]: s["end"]] == " ".join(f"w{i}" for i in range(20)) for s in got[5].spans)
    names = ("doc_id", "n_words", "n_hit", "items")
    assert rows(contamination.scan(odd, items, block_bytes=40), *names) == rows(whole, *names)
    assert contamination.scan(empty, items).count() == 0 and contamination.clean_documents(odd, items.limit(0)).count() == 9
    assert contamination.clean_documents(odd, items).columns == odd.columns and contamination.clean_documents(odd, items).count() == 7


def test_sharding(spark, odd, empty):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"copy {i // 4}" if i % 2 else f"text {i}") for i in range(1000)], "doc_id long, text string")
    got = sharding.sharded(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1000 and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    spread = {}
    for r in got:
        spread.setdefault(r.text_group, set()).add(r.shard)
    members = Counter(r.text_group for r in got)
    assert sum(len(s) > 1 for s in spread.values()) <= 16 and len(spread[max(members, key=members.get)]) <= -(-334 * 16 // 1000) + 1
    small = sharding.sharded(odd).collect()
    assert len(small) == 9 and {r.size for r in small if r.doc_id in (2, 3)} == {1} and sharding.sharded(empty).count() == 0


def brute_components(texts, words, num, den):
    sets = {i: jaccard.text_set(t, words) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x = len(sets[a] & sets[b])
            if x and den * x >= num * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("documents", [10, 10**12])
def test_jaccard_against_brute_force(spark, documents):
    import random

    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = {}
    for base in range(12):
        words = [r.choice(vocabulary) for _ in range(r.choice((4, 12, 13, 40, 150, 900)))]
        for _ in range(14):
            copy = list(words)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts[len(texts)] = " ".join(copy + [r.choice(vocabulary)] * r.choice((0, 1)))
    # The allocation for a very large corpus takes one-deletion segments; results are the same.
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, expected=documents).collect()}
    assert got == brute_components(texts, 3, 90, 100)


def test_allocation_covers_all_differences():
    for high in (9, 30, 500, 20_000):
        for n in (10, 10**6, 10**11):
            exact, loose = jaccard.allocation(high, 90, 100, n)
            assert exact + 2 * loose > (high + high * 100 // 90) * 10 // 190
    assert jaccard.allocation(500, 90, 100, 10**11)[1] > 0


def test_jaccard_defined_cases(odd, empty):
    got = rows(jaccard.jaccard_components(odd), "doc_id", "n_shingles", "component_id")
    want = [(1, 4, 1), (1, 4, 1), (2, 0, 2), (3, 0, 3), (5, 977, 5), (6, 977, 5), (7, 0, 7), (8, 1, 8), (None, 3, None)]
    assert got == sorted(want, key=repr) and jaccard.jaccard_components(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_mixing(spark, odd, empty):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 10 else "de", f"src{i % 3}") for i in range(900)], "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mixed(docs, levels, weights={"lang": {"en": 500, "de": 500}}, budget_share=0.5, max_epochs=2)
    taken = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.col("epochs") * F.col("n_tokens")).alias("n")).collect()}
    # 9000 tokens, 4500 wanted, 2250 each; German holds 900, two passes give 1800; English fills the shortage.
    assert taken["de"] == 1800 and 2640 <= taken["en"] <= 2700
    assert mixing.mixed(odd, mixing_levels()).count() == 9 and mixing.mixed(empty, mixing_levels()).count() == 0
    kept = mixing.taken_documents(odd, mixing_levels(), budget_share=5.0, max_epochs=1)
    assert kept.columns == odd.columns and kept.count() == 9


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    repeat = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_quality(odd, empty):
    texts = [r.text for r in odd.collect()]
    got = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(odd).collect())
    assert got == Counter(map(brute_quality, texts)) and quality.quality_rules(empty).count() == 0
    assert quality.kept_documents(odd).columns == odd.columns


def test_url_rules(spark):
    bad = [(i, f"http://x{i % 5}.casino-win.example/p/{i}", f"<p>Best CASINO of {i}") for i in range(40)]
    odd_urls = [(900, None), (901, "no scheme"), (902, "HTTP://A.NET/x?y#z"), (903, "http://b.example.net/en/1"), (904, "http://other.win.example/q"),
                (905, "http://net"), (906, "http://example.com/de/1"), (None, "http://q.org/fr/"), (908, "http://xexample.com/de/"), (909, "http://y.example/" + "z/" * 50_000)]
    rows_ = bad + [(100 + i, f"http://fine{i}.example/p/{i}", "<b>plain</b>") for i in range(200)] + [(i, u, None) for i, u in odd_urls]
    pages = spark.createDataFrame([(*r, "a", 7, "t") for r in rows_], "page_id long, url string, html string, host string, row int, tokens string")
    label = urls.text_label(F.col("html"))
    got = {r.page_id: r for r in urls.judged_urls(pages, label).collect()}
    assert all(got[i].verdict == "block" for i, *_ in bad) and all(got[100 + i].verdict == "allow" for i in range(200))
    assert (got[900].host, got[901].path, got[902].host, got[902].path) == ("", "", "a.net", "/x")
    assert [got[i].rule for i in (902, 903, 905, 906, None, 908)] == ["net/", "example.net/en/", None, "example.com/de/", "org/fr/", None]
    assert got[904].verdict == "block" and got[903].verdict == "allow" and got[909].verdict == "allow"
    assert urls.judged_urls(pages.limit(0), label).count() == 0
    found = urls.precision_recall(urls.judged_urls(pages, label), pages.select("page_id", label.alias("label"))).first()
    assert (found.positive, found.blocked, found.precision, found.recall) == (40, 40, 1.0, 1.0)


def test_labels_come_from_the_text_of_a_page(spark):
    html = ["<a href='http://casino.x'>go</a>", "<script>casino</script>x", "a Casino, here", "casinos", "<style>\n.spam{}</style>", "no</p>spam", None, ""]
    got = spark.createDataFrame(list(enumerate(html)), "i int, html string").withColumn("y", urls.text_label(F.col("html"))).orderBy("i").collect()
    assert [r.y for r in got] == [0, 0, 1, 0, 0, 1, None, 0]


def test_mined_verdicts_against_brute_force(spark):
    import random
    from itertools import combinations

    r = random.Random(12)
    pages = []
    for i in range(500):
        tokens = r.sample("abcdefgh", r.randrange(1, 6))
        bad = ("a" in tokens and "b" in tokens) or "h" in tokens and r.random() < 0.95 or r.random() < 0.01
        pages.append((i, f"http://{'.'.join(tokens)}/{r.choice(('x', 'y'))}", int(bad), i % 4 != 0))
    df = spark.createDataFrame(pages, "page_id long, url string, bad int, seen boolean")
    got = {x.page_id: x.verdict for x in urls.judged_urls(df, F.when(F.col("seen"), F.col("bad")), rules=()).collect()}
    sets = {i: frozenset(re.findall("[a-z0-9]+", u)) for i, u, _, _ in pages}
    known = [(sets[i], bad) for i, _, bad, seen in pages if seen]
    least = max(urls.SUPPORT * len(known), urls.LEAST_PAGES)
    every = sorted(set().union(*sets.values()))
    rules = []
    for k in range(1, urls.LONGEST + 1):
        for part in map(frozenset, combinations(every, k)):
            held = [bad for s, bad in known if part <= s]
            if sum(held) >= least and sum(held) >= urls.CONFIDENCE * len(held):
                rules.append(part)
    assert any(len(x) > 1 for x in rules)
    assert got == {i: "block" if any(x <= s for x in rules) else "allow" for i, s in sets.items()}


def test_url_rules_broadcast_tokens_only(spark):
    """Alike urls are a small file and many rows: neither they nor rules that fit a file may go through the driver."""
    def path(i):
        return "/".join(["casino", "win", *"abcdef"] if i % 3 == 0 else [f"w{i % 7}", *"abcdef"])

    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.udf(lambda i: f"http://h.example/{path(i)}")("id").alias("url"), (F.col("id") % 3 == 0).cast("int").alias("bad"))
    judged = urls.judged_urls(pages, F.col("bad"), rules=())
    sent = plans.broadcast_rows(judged)
    # The blocked urls' row numbers may, by their size in memory; the 62,000 tokens of all urls may not.
    assert sent and max(sent) <= 2000
    assert {(r.verdict, r.page_id % 3 == 0) for r in judged.collect()} == {("block", True), ("allow", False)}
    mined = urls.mined_rules(pages.select(urls.tokens_of(F.col("url")).alias("tokens"), F.col("bad").alias("label")))
    assert {tuple(r.tokens) for r in mined.collect()} == {("casino",), ("win",)}
    # More than 300 rules are looked up to find the two.
    assert "BroadcastHashJoin [part#" not in plans.plan_of(mined)


def test_class_scores(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in brown.class_scores(docs).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower)), "\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    n = sum(c.values())
    for i, x in tokens.items():
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (len(c) + 1))) for t in x)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(x), sum(c[t] > 0 for t in x), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    better = [i for i in tokens if held[i]]
    assert sum(got[i].score for i in better) > sum(got[i].base_score for i in better)
    assert brown.class_scores(odd).count() == 9 and brown.class_scores(empty).count() == 0


def test_pipeline_stages(spark, items):
    import corpus_pipeline

    words = "the of and to in a is that for with was on as be by from have not are this".split()
    base = " ".join(f"{words[i % 20]} token{i}" for i in range(200))
    texts = {1: base, 2: base, 3: base.replace("token7 ", "other "), 4: "too short", 5: " ".join(f"{words[(i * 3) % 20]} more{i}" for i in range(150)),
             6: " ".join(f"{words[i % 20]} w{i}" for i in range(100)) + " " + items.first().text * 3}
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_quality(spark, docs, SMALL)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6} and kept.columns == docs.columns
    one = corpus_pipeline.drop_near_copies(spark, kept, SMALL)
    assert {r.doc_id for r in one.collect()} == {1, 5, 6} and one.columns == docs.columns
    final = corpus_pipeline.run(spark, SMALL)
    sizes = Counter(r.shard for r in final.collect())
    assert sizes and max(sizes.values()) - min([sizes.get(s, 0) for s in range(16)]) <= 1
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]).count('"') == 10


def cut_edges(got, groups):
    """Pairs of one group in different shards, by brute force."""
    return sum(got[a] != got[b] for g in groups for k, a in enumerate(g) for b in g[k + 1:])


def test_sharding_follows_the_rounds(spark):
    texts = {i: f"copy {i // 5}" if i < 600 else f"text {i}" for i in range(1000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = [range(i, i + 5) for i in range(0, 600, 5)]
    cut, moved = [], []
    for rounds in (0, 4):
        got = {r.doc_id: r.shard for r in sharding.sharded(docs, rounds=rounds).collect()}
        sizes = Counter(got.values())
        assert len(got) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1
        cut.append(cut_edges(got, groups))
        moved.append(got)
    # A group of five by hash alone has about 9 of its 10 pairs cut.
    assert cut[0] > 1000 and cut[1] < cut[0] / 20 and moved[0] != moved[1]


def test_accepted_moves_keep_quotas():
    import random

    r = random.Random(5)
    for _ in range(200):
        load = [r.randrange(40, 60) for _ in range(5)]
        asks = [(s, t, level, r.randrange(1, 4)) for s in range(5) for t in range(5) if s != t for level in r.sample(range(256), 3)]
        cut = sharding.accepted(asks, load, 52)
        size = list(load)
        for s, t, level, n in asks:
            if level >= cut.get((s, t), 999):
                size[s] -= n
                size[t] += n
        assert all(x <= max(52, y) for x, y in zip(size, load)) and sum(size) == sum(load)
    assert sharding.dealt({b"a": {0: 5, 1: 9}, b"b": {1: 4}}, 3, 6) == {b"a": {1: 6, 0: 6, 2: 2}, b"b": {2: 4}}


def test_kept_texts_have_function_words_in_long_texts(spark):
    import random

    r = random.Random(11)
    words = [f"noun{i}" for i in range(500)]
    clean = [" ".join(r.choice(quality.COMMON_WORDS["en"]) if r.random() < 0.3 else r.choice(words) for _ in range(n)) for n in (60, 120, 400) * 20]
    lists = [" ".join(r.choice(words) for _ in range(n)) for n in (120, 400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + lists)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.kept_documents(docs).collect()} == set(range(60))


def test_near_copies_between_both_thresholds(spark):
    import random

    import corpus_pipeline

    r = random.Random(4)
    texts = {}
    for _ in range(6):
        words = [f"v{r.randrange(9000)}" for _ in range(300)]
        for replaced in (0, 3, 5, 8):
            copy = list(words)
            for at in r.sample(range(20, 280), replaced):
                copy[at] = f"new{r.randrange(9000)}"
            texts[len(texts)] = " ".join(copy)
    want, query = ({i for i, (_, c) in brute_components(texts, *how).items() if c == i} for how in ((5, 80, 100), (3, 90, 100)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()} == want != query


def test_decontamination_stage_against_brute_force(spark):
    import corpus_pipeline

    items = [contamination.normalised_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.item_id is not None]
    wanted = {tuple(w[i: i + 13]) for w in items if w for i in range(max(1, len(w) - 12))}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = set()
    for r in docs.collect():
        w, hit = contamination.normalised_words(r.text), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i: i + n]) in wanted:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            want.add(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()} == want


def brute_mix(docs):
    tokens = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    node = {r.doc_id: (f"domain{int(r.source[-1]) % 3}", r.lang, r.source) for r in docs}
    budget = {(): int(sum(tokens.values()) * 0.6)}
    for depth in range(3):
        for parent in [p for p in budget if len(p) == depth]:
            held = Counter()
            for i, n in tokens.items():
                if node[i][:depth] == parent:
                    held[node[i][: depth + 1]] += n
            weight = {k: mixing.WEIGHTS["lang"].get(k[1], 100) if depth == 1 else 100 for k in held}
            left, open_ = budget[parent], set(held)
            # Children that cannot fill their share are full; what they leave goes to the others.
            while full := {k for k in open_ if held[k] * sum(weight[j] for j in open_) <= left * weight[k]}:
                left -= sum(held[k] for k in full)
                open_ -= full
                budget.update((k, held[k]) for k in full)
                if not open_:
                    break
            budget.update((k, min(held[k], int(left * weight[k] / sum(weight[j] for j in open_)))) for k in open_)
    taken = set()
    for leaf in set(node.values()):
        ids = [i for i in tokens if node[i] == leaf]
        if budget[leaf] >= sum(tokens[i] for i in ids):
            taken.update(ids)
            continue
        upto = 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"17-0-{i}".encode()).hexdigest()):
            upto += tokens[i]
            if upto <= budget[leaf]:
                taken.add(i)
    return taken


def test_mixing_stage_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null and lang is not null and source rlike '[0-9]$'").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, SMALL).collect()} == brute_mix(docs.collect())


def test_sharding_stage_follows_passages(spark):
    import corpus_pipeline

    passage = lambda k: " ".join(f"p{k} w{i}" for i in range(30))
    data = [(i, f"own {i}\n{passage(i // 4).upper() if i % 2 else passage(i // 4)}" if i < 600 else f"text {i}", f"src{i % 5}" if i % 7 else None) for i in range(1000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    linked = docs.select("doc_id", sharding.passage_links(F.col("text")).alias("k")).collect()
    assert len({r.k[0] for r in linked if r.k}) == 150 and all(len(r.k) == (r.doc_id < 600) for r in linked)
    groups = [range(i, i + 4) for i in range(0, 600, 4)]
    cut = []
    for out in (sharding.sharded(docs), corpus_pipeline.shard(spark, docs, SMALL)):
        got = {r.doc_id: r.shard for r in out.collect()}
        sizes = Counter(got.values())
        assert len(got) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1
        cut.append(cut_edges(got, groups))
    assert cut[0] > 700 and cut[1] < cut[0] / 2


def test_benchmark_stays_out_of_the_driver(spark, items):
    folders = contamination.item_blocks(items, "item_id", "text", 40)
    held = [contamination.block_items(f) for f in folders]
    assert all(isinstance(f, str) for f in folders) and len(folders) > 1
    assert Counter(x for b in held for x in b) == Counter((str(r.item_id), r.text) for r in items.collect() if r.item_id is not None and r.text is not None)
    assert contamination.item_blocks(items.limit(0), "item_id", "text", 40) == []


def test_clauses_are_scored_on_their_own():
    weight = lambda w: 8.0 if w == "vile" else 0.0
    read = lambda text: dict(zip(toxicity.FEATURES, toxicity.clause_features(text, weight)))
    both = read("She said it was vile. You are vile.")
    assert both["reported"] > 0 and both["aimed"] == read("You are vile.")["aimed"] > 0 and both["strongest"] == read("You are vile.")["strongest"]
    assert read("not vile. it is vile")["insult"] > 0 and read("it is vile\nit is vile")["insult"] == read("it is vile")["insult"]


def test_archive_of_several_members_is_read_whole(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<b>{i}</b>" * (i + 20)) for i in range(9)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "whole"))
    one = next((tmp_path / "whole").glob("*.gz")).read_bytes()
    (tmp_path / "several").mkdir()
    (tmp_path / "several" / "two.warc.gz").write_bytes(one + one)
    index = warc.normalise(spark, str(tmp_path / "several"), str(tmp_path / "members"))
    assert Counter(r.page_id for r in index.collect()) == Counter({i: 2 for i in range(9)})
    # The normaliser's own output, too, is an archive of several members.
    assert warc.normalise(spark, str(tmp_path / "members"), str(tmp_path / "again")).count() == 18
    with pytest.raises(ValueError, match="truncated"):
        list(warc._inflated(open_bytes(one + one[:-9])))


def open_bytes(raw):
    from io import BytesIO

    return BytesIO(raw)


def test_near_copies_in_slices_against_brute_force(spark, monkeypatch):
    """Many sets around the threshold: hubs and buckets are cut into slices, five words and 0.8."""
    import random

    monkeypatch.setattr(jaccard, "HUB_SLICE", 3)
    monkeypatch.setattr(jaccard, "BUCKET_SLICE", 4)
    monkeypatch.setattr(jaccard, "RANGE", 64)
    r = random.Random(5)
    texts = {}
    for _ in range(4):
        words = [f"v{r.randrange(4000)}" for _ in range(r.choice((60, 120, 300)))]
        for _ in range(40):
            copy = list(words)
            for _ in range(r.choice((0, 1, 2, 3, 5, 7))):
                copy[r.randrange(len(copy))] = f"v{r.randrange(4000)}"
            texts[len(texts)] = " ".join(copy)
    for _ in range(30):
        texts[len(texts)] = " ".join(f"x{r.randrange(10**6)}" for _ in range(80))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_components(texts, 5, 80, 100)
    for rounds in (0, 4):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, words=5, num=80, den=100, hub_rounds=rounds).collect()}
        assert got == want


def test_shared_elements_are_counted(spark):
    sample = jaccard.Sample(1000, 80, 100)
    texts = {1: "a b c d e f g h i j", 2: "a b c d e f g x y z", 3: "q1 q2 q3 q4 q5 q6 q7", 4: "h i j k l a b c d e"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4, "doc_id")
    packed = {i: {x for x in sample.unpacked(r.part).tolist()} for i, r in ((r.doc_id, r) for r in jaccard.sketch(docs, 3, sample).collect())}
    got = {r.doc_id: r.shared for r in jaccard.shared_counts(jaccard.sketch(docs, 3, sample), sample).collect()}
    want = {i: sum(any(x in packed[j] for j in packed if j != i) for x in own) for i, own in packed.items()}
    assert got == {i: n for i, n in want.items() if n}


def test_items_with_ids_that_are_no_numbers(spark, odd, items):
    named = items.select(F.concat(F.lit("q-"), "item_id").alias("item_id"), "text")
    got = {r.doc_id: r.items for r in contamination.scan(odd, named).collect()}
    many = {r.doc_id: r.items for r in contamination.scan(odd, named, block_bytes=30, text_bytes=1000).collect()}
    assert got == many and got[1] == ["q-2"] and got[5] == ["q-1"]


def test_a_block_is_built_once_for_many_batches(monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 10)], ["t"]) for _ in range(20)]
    joined = list(contamination.held(iter(batches), 5000))
    assert sum(b.num_rows for b in joined) == 200 and len(joined) <= 4


def test_weight_zero_gets_what_is_left(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i < 30 else "de" if i < 60 else "fr") for i in range(90)], "doc_id long, text string, lang string")
    levels = {"lang": F.col("lang")}
    for weights, share, want in (
            ({"en": 0, "de": 5, "fr": 5}, 0.5, {"en": 0, "de": 220, "fr": 220}), ({"en": 0, "de": 5, "fr": 5}, 0.9, {"en": 210, "de": 300, "fr": 300}),
            ({"en": 0, "de": 0, "fr": 0}, 0.5, None)):
        out = mixing.mixed(docs, levels, weights={"lang": weights}, budget_share=share, max_epochs=1)
        taken = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.col("epochs") * F.col("n_tokens")).alias("n")).collect()}
        if want:
            assert taken == want
        else:
            assert sum(taken.values()) == 450


@pytest.mark.parametrize("head, units", [(40, 16), (0, 0), (10**6, 64)])
def test_class_scores_against_the_model_word_by_word(spark, head, units):
    """Scores recomputed from the model's classes, and tables recounted from the texts."""
    import numpy as np

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"))
    model = brown.train(docs.filter("not held_out").select("text"), head=head, units=units, classes=8)
    got = {r.doc_id: r.score for r in brown.scores(docs, model).collect()}
    tail = {r.h: (r.c, r.k) for r in model.tail.collect()}
    assert len(tail) + len(model.know.head) == model.total_types - 1 and (head or not len(model.know.head))
    place = {int(h): i for i, h in enumerate(model.know.head.view(np.int64))}

    def words(text):
        block = brown.Block([(text or "").encode()])
        return list(zip(block.hash.view(np.int64).tolist(), brown.buckets_of(block).tolist()))

    def word(h, b):
        """(count, class, class as history)."""
        if h in place:
            return int(model.head_count[place[h]]), int(model.know.head_class[place[h]]), int(model.know.head_class[place[h]])
        c, k = tail.get(h, (0, None))
        return c, int(model.know.bucket_class[b]) if k is None else k, int(model.know.bucket_class[b])

    table, types = np.zeros((8, 8)), {}
    rows_ = docs.collect()
    for r in rows_:
        if not r.held_out:
            before = 0
            for h, b in words(r.text):
                _, k, as_history = word(h, b)
                table[before, k] += 1
                types[h] = k
                before = as_history
            table[before, 0] += 1
    assert np.array_equal(table, model.table)
    types = np.bincount(list(types.values()), minlength=8) + np.eye(8)[0]
    assert np.array_equal(types, model.types) and model.tokens.sum() == model.total_tokens
    alpha, mixture = brown.ALPHA, brown.MIX
    base = model.total_tokens + alpha * (model.total_types + 1)

    def chance(before, count, k):
        within = (table[before, k] + 1 / 8) / (table[before].sum() + 1) * (count + alpha) / (table[:, k].sum() + alpha * (types[k] + 1))
        return mixture * within + (1 - mixture) * (count + alpha) / base

    for r in rows_[:60]:
        total, before = 0.0, 0
        for h, b in words(r.text):
            c, k, as_history = word(h, b)
            total += math.log10(chance(before, c, k))
            before = as_history
        total += math.log10(chance(before, model.ends, 0))
        assert got[r.doc_id] == pytest.approx(total, rel=1e-9)
    # After each history the chances of all words, with one unseen word per class, add up to one, but for the unigram's unseen ones.
    every = [(int(c), int(k)) for c, k in zip(model.head_count, model.know.head_class)] + list(tail.values()) + [(model.ends, 0)]
    for before in range(8):
        whole = sum(chance(before, c, k) for c, k in every) + sum(chance(before, 0, k) for k in range(8))
        assert whole == pytest.approx(1 + (1 - mixture) * 7 * alpha / base, rel=1e-9)


def test_words_move_to_the_class_of_highest_likelihood():
    import numpy as np

    r = np.random.default_rng(4)
    classes, words = 5, 60
    n = r.poisson(0.8, (words, classes)) + (np.arange(classes) == (np.arange(words) % classes)[:, None])
    word, before = np.nonzero(n)
    of = r.integers(1, classes, words)
    rest = r.integers(0, 20, (classes, classes)).astype(float)
    full = lambda c: rest + brown._table(word, before, n[word, before], c, classes)
    free = np.arange(words) % 2 == 0
    new = brown.moved(word, before, n[word, before], of, full(of), free)
    assert np.array_equal(new[~free], of[~free]) and (new != of).any()
    for w in np.flatnonzero(free):
        tried = []
        for k in range(1, classes):
            one = of.copy()
            one[w] = k
            tried.append(brown.likelihood(full(one)))
        assert tried[new[w] - 1] == pytest.approx(max(tried), abs=1e-6)
    done = brown.swept(word, before, n[word, before], of, rest, 12)
    assert brown.likelihood(full(done)) > brown.likelihood(full(of))


def test_sweeps_over_rare_words_raise_the_likelihood(spark):
    training = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"))
    tables = [brown.train(training, head=50, units=20, classes=8, tail_sweeps=k).table for k in (0, 2, 4)]
    found = [brown.likelihood(t) for t in tables]
    assert found[0] < found[1] <= found[2] and len({t.sum() for t in tables}) == 1


def test_targets_on_both_sides_threats_by_path_and_reports_after():
    weight = lambda w: 8.0 if w in ("vile", "filth") else 0.0
    read = lambda text: dict(zip(toxicity.FEATURES, toxicity.clause_features(text, weight)))
    assert read("you are vile")["aimed"] > 0 and read("vile you are")["aimed"] > 0 and read("vile it all is here and then you")["aimed"] == 0
    threats = [read(x)["threat"] for x in ("the fire will destroy wood", "i destroy wood", "i will destroy wood", "i will kill you")]
    assert 0 < threats[0] < threats[1] < threats[2] < threats[3] and read("i will not kill you")["threat"] == 0
    for reported in ("she was vile, said Bob", "she was vile, he said", "said Bob she was vile", "you are vile he said"):
        assert read(reported)["reported"] > 0 and read(reported)["aimed"] == read(reported)["insult"] == 0
    assert read("you are vile. Said nothing else, he went")["reported"] > 0 and read("you are vile. He went and said nothing")["aimed"] > 0
    assert read("it is very vile")["insult"] > read("it is vile")["insult"] and read("vile filth")["insult"] > math.log1p(2 * 6.0)


def test_composed_machines_equal_one_after_the_other():
    import random

    r = random.Random(3)
    negation = toxicity._turning(toxicity.INPUT | {"menace"}, {"negation"}, {"insult": "negated", "threat": "word", "menace": "word"}, toxicity.REACH)
    report = toxicity._turning(toxicity.MIDDLE, {"report"}, {"insult": "reported", "negated": "reported", "threat": "word", "menace": "word"}, None)
    target = toxicity._turning(toxicity.MIDDLE, {"target", "menace"}, {"insult": "aimed"}, toxicity.REACH)
    whole = toxicity.grammar()
    for _ in range(500):
        symbols = r.choices(sorted(toxicity.INPUT), k=r.randrange(0, 15))
        got, weights = whole.read(symbols), [0.0] * len(symbols)
        for machine in (toxicity._insults(), toxicity._threats(), negation, report, target):
            out = machine.read(symbols)
            symbols, weights = [s for s, _ in out], [a + b for a, (_, b) in zip(weights, out)]
        assert got == list(zip(symbols, weights))


def test_labels_of_equal_texts_are_counted_together(spark):
    texts = [(i, "you are awfulword now" if i < 6 else f"plain {i} here") for i in range(40)] + [(90, None), (91, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for order in (1, -1):
        rows_ = [(i, int(i < 4)) for i in range(40)][::order] + [(90, 1), (91, 1)]
        taught = docs.join(spark.createDataFrame(rows_, "doc_id long, toxic int"), "doc_id").filter("text is not null")
        texts_ = taught.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        assert texts_.filter("text like 'you%'").first().toxic == 1 and texts_.filter("toxic = 1").count() == 1
    atoms = toxicity.learned_atoms(taught.withColumn("text", F.concat("text", F.lit(" x"), F.col("doc_id") % 4)))
    assert set(atoms) <= {"awfulword", "awfu*", "awful*", "awfulw*", "awfulwo*", "awfulwor*", "you", "are", "now"}
