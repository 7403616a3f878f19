"""Encoding, spelling variants and search on small tables: defined cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from conftest import SMALL
from marketloom.llm import bpe, search, spelling
from marketloom.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = P.path("byte_bpe_50k.json")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rules():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(texts, rules, library):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = bpe.encode_texts(texts, rules)
    assert [bpe.id_array(x).tolist() for x in got] == want
    assert [bpe.decode_ids(x, rules) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_encoding_equals_the_library(rules, library):
    r = random.Random(1)
    parts = [*"aabcstrevmld'' \n\t 1290.,!?-éñÈ×漢字’ªⅣ½", "\u0085", "\x1c", "\xa0", " ", "̀", "🙂", "<|endoftext|>", "<|endof", "'ll", "'re", "  ", "\r\n", "the ", " in"]
    same(["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(5000)], rules, library)
    same(["", " ", "\n", "'s", "a's", "''s", "'", " " * 777 + "x", "<|endoftext|>" * 2, "x <|endoftext|> 's  <|endoftext|"], rules, library)
    same([f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}'{chr(c)}" for c in range(0x3400) if not 0xD800 <= c < 0xE000], rules, library)


def test_long_fragments_without_cuts(rules, library):
    same(["a" * 50_000, "ab" * 20_000 + "'s", "=" * 30_000], rules, library)


def test_cuts_are_certain(rules):
    for token in rules.bytes.values():
        assert not any(rules.cut[a, b] for a, b in zip(token, token[1:]))
    assert rules.cut.mean() > 0.9 and rules.cut[ord("a"), ord(" ")]


def test_fragments_forgotten_are_encoded_again(rules, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    same(["one two three four five one two three"] * 3, rules, library)


def test_codec_defined_cases(spark, library):
    long = "Wörter und mehr, " * 20_000
    data = [(1, "One two", 5), (1, "One two", 5), (2, "", 5), (3, None, 5), (None, "no id", 5), (5, long, 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids int")
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=repr)
    want = []
    for i, text, _ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr) and bpe.digests(docs.limit(0), PATH).count() == 0
    with pytest.raises(KeyError):
        bpe.decode_ids((99_999).to_bytes(4, "little"), bpe.Vocabulary(open(PATH, "rb").read()))


def test_codec_on_whole_table(spark, library):
    got = {r.doc_id: r for r in QUERIES["op11_bpe_codec"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_variants(rows, length=6, least=5, ratio=5, dropped=199):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= least and len(w) >= length}
    near = defaultdict(set)
    for w in words:
        for v in words:
            if len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1 or len(v) == len(w) - 1 and any(w[:i] + w[i + 1:] == v for i in range(len(w))):
                near[w].add(v)
                near[v].add(w)
    form = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items()}
    form = {w: f for w, f in form.items() if words[f] >= ratio * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def test_variants_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    base = ["abcabc", "aaaaaa", "aaaaaaa", "abaabaab", "ñañaña", "÷×öööß", "tttttu", "zzzzzzzzzz"]
    pool = []
    for w in base:
        pool += [w] * 60
        for _ in range(30):
            i = r.randrange(len(w) + 1)
            c = r.choice("abzñß")
            pool += [r.choice((w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]))] * r.choice((1, 2, 5, 12))
    r.shuffle(pool)
    rows = [(i, " ".join(pool[i::40]).upper() if i % 7 == 0 else ". ".join(pool[i::40])) for i in range(40)]
    rows += [(None, "abcabd " * 9), (None, "abcabd"), (3, None), (4, ""), (1, "x" * 3000 + " "), *[(50, "x" * 3000 + "1" + "x" * 2999)] * 5]
    docs = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id long, text string, word string, n int").repartition(6)
    for dropped in (199, 3):
        got = {tuple(x) for x in spelling.variants(docs, dropped=dropped).collect()}
        assert got == brute_variants(rows, dropped=dropped)
    monkeypatch.setattr(spelling, "HELD", 5)
    assert {tuple(x) for x in spelling.variants(docs).collect()} == brute_variants(rows)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_variants_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(x) for x in QUERIES["op12_spelling_variants"](spark, SMALL).collect()} == brute_variants(rows)


def test_trie_nodes_are_prefixes(spark):
    words = ["abc", "ab", "abd", "b", "ba", "ñ", "abcde", "c", "cc"]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    paths = {r.word: r.path for r in spelling.numbered(df, "word", "path").collect()}
    node = defaultdict(set)
    for w, path in paths.items():
        for i, x in enumerate(path):
            node[w[: i + 1]].add(x)
    assert all(len(x) == 1 for x in node.values()) and len({min(x) for x in node.values()}) == len(node) and 0 not in {min(x) for x in node.values()}
    assert sorted(words) == sorted(words, key=lambda w: paths[w][-1])


def brute_ranks(docs, items, best=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(x.translate(FOLD) for x in term.findall(t or ""))) for i, t in docs]
    held = [x for x in held if x[1]]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items.items():
        asked, found = Counter(x.translate(FOLD) for x in term.findall(text)), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out |= {(item, k, i, -score) for k, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)}
    return out


def test_search_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["é1", "Été", "UP"]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(1, 60)))) for i in range(150)]
    docs += [(i, "w1 w2 w3") for i in range(200, 260)] + [(None, "w1 w2 w3"), (None, "w1"), (7, "w1 w2 w3"), (300, None), (301, ""), (302, " .,;"), (303, "w5 " * 20_000)]
    items = {i: " ".join(r.choices(words, k=r.randrange(1, 30))) for i in range(25)} | {30: "w1 w2 w3", 31: "nothing", 32: "...", 33: "w1 w1 w1 w2"}
    monkeypatch.setattr(search, "_SLICE", 16)
    d = spark.createDataFrame([(*x, 9, 9) for x in docs], "doc_id long, text string, n int, score int").repartition(5)
    asked = spark.createDataFrame([*items.items(), (None, "w1"), (40, None), (0, items[0])], "item_id long, text string")
    for block in (1 << 20, 300):
        got = {tuple(x) for x in search.ranked(d, asked, block_bytes=block).collect()}
        assert got == brute_ranks(docs, items)
    assert search.ranked(d.limit(0), asked).count() == 0 and search.ranked(d, asked.limit(0)).count() == 0


def test_shared_sets_keep_items_whole():
    r = random.Random(8)
    items = [Counter(r.choices(range(25), k=r.randrange(0, 30))) for _ in range(40)] + [Counter({0: 3, 1: 1}), Counter({0: 3, 2: 1}), Counter()]
    nodes, sums = search.shared_sets(items)
    whole = []

    def flat(symbols):
        out = Counter()
        for s in symbols:
            out += whole[s - 25] if s >= 25 else Counter([s])
        return out

    for n in nodes:
        whole.append(flat(n))
    assert [flat(x) for x in sums] == items
    assert nodes and search.additions(nodes, sums) < sum(sum(x.values()) for x in items)
