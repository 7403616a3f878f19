"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, intensifiers, first person, future), and composed transducers
read them clause by clause. Arcs carry weights, which add up along the path, as composed machines' do:

- insult: one after an intensifier, or close after another, is heavier;
- threat: a verb alone weighs little, more after a first person and a future, and most when a target follows;
- negation: turns insults and threats of the next words into weaker ones or none;
- report: what follows a verb of speech in its clause is reported;
- target: an insult close after a target is aimed.

A second pass reads what the first has put out from the clause's end: an insult before its target is aimed as well, and one
right before a verb of speech is reported; a clause whose next one begins with such a verb is reported as a whole. A clause
counts with what the machines put out for it, never a word by itself. Grammar words are fixed lists; insults are
learned from labelled texts as words and word beginnings that stand far more often in toxic texts, with their log-odds as weights. A
logistic model of the clause sums, fitted on labelled texts of its own, gives the score.

The labelled rows are a bounded sample: the ``label_rows`` with the smallest hash of their id, all of them if fewer.

Defined cases: null and empty texts have no clause and get the score of a text without matches; a null id counts as the
id of empty text; labels that are null, or whose text is missing, teach nothing; a text on several label rows is toxic
if at least half of them say so; without labels of both kinds no insult is learned and every text scores the share of toxic labels, or 0;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_crc, staged

LABEL_ROWS, ATOMS, MIN_SUPPORT, MIN_WEIGHT = 20_000, 4_000, 3, 3.0
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

#: Grammar words by symbol, in natural order of the languages de, en, es, fr.
LISTS = {
    "target": "du dich dir euch ihr dein deine you your yours they them he him she her usted ustedes vosotros ellos tu te ti toi vous votre eux",
    "threat": "töten töte umbringen bringe verletzen verletze zerstören zerstöre schlagen schlage verprügeln erschießen kill kills killing hurt destroy burn stab "
              "shoot beat murder strangle matar mataré golpear golpearé destruir destruiré quemar tuer tuerai frapper frapperai détruire détruirai brûler",
    "negation": "nicht kein keine keiner nie niemals not no never nobody none don't won't isn't nunca jamás nadie ne pas jamais aucun aucune",
    "report": "sagte sagten behauptete schrieb meinte angeblich said says claimed claims wrote told allegedly dijo dice escribió afirmó dit disait affirme affirmait écrit prétend",
    "very": "sehr so total völlig very really such totally muy tan totalmente très tellement vraiment",
    "self": "ich wir i we yo nosotros je nous",
    "future": "werde werden will shall gonna going voy vamos vais allons",
}
SYMBOLS = {word: symbol for symbol, words in LISTS.items() for word in words.split()}
#: Words that a negation or a target reaches, an intensifier or insult, and a verb of speech backwards.
REACH, CLOSE, BACK = 4, 2, 2
OUTPUTS = ("insult", "negated", "reported", "aimed", "threat")
FEATURES = (*OUTPUTS, "strongest", "density")
#: Weights of arcs: insult after an intensifier, after another insult; threat alone, after a first person, after its future; the target of each.
INTENSE, AGAIN = 1.0, 0.5
THREAT_ARCS = {"alone": 1.0, "self": 3.0, "future": 4.0}
TARGET_ARCS = {"alone": 1.0, "self": 3.0}
_CLAUSE = re.compile(r"[.!?;:\n]+|,\s")
_TOKEN = re.compile(r"\w+(?:'t)?")


class Transducer:
    """Finite-state machine on symbols: ``step(state, symbol) -> (state, symbol put out, weight)``; states are whole numbers."""

    def __init__(self, table: dict[tuple[int, str], tuple[int, str, float]], alphabet: set[str]):
        self.table, self.alphabet = table, alphabet

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: what this one puts out is read by the other, weights add; states are numbered as they are reached."""
        states, table, queue = {(0, 0): 0}, {}, [(0, 0)]
        while queue:
            here = queue.pop()
            for symbol in self.alphabet:
                mine, out, one = self.table[here[0], symbol]
                theirs, final, two = other.table[here[1], out]
                if (mine, theirs) not in states:
                    states[mine, theirs] = len(states)
                    queue.append((mine, theirs))
                table[states[here], symbol] = (states[mine, theirs], final, one + two)
        return Transducer(table, self.alphabet)

    def read(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = 0, []
        for symbol in symbols:
            state, final, weight = self.table[state, symbol]
            out.append((final, weight))
        return out


INPUT = {"word", "insult", *LISTS}
MIDDLE = INPUT | {"menace", "negated", "reported"}
FINAL = MIDDLE | {"aimed"}


def _turning(alphabet: set[str], starts: set[str], turns: dict[str, str], reach: int | None) -> Transducer:
    """After ``starts``, symbols in ``turns`` are replaced for ``reach`` words, or to the end of the clause."""
    table = {}
    last = reach or 1
    for state in range(last + 1):
        for symbol in alphabet:
            after = last if symbol in starts else state if reach is None else max(0, state - 1)
            table[state, symbol] = (after, turns.get(symbol, symbol) if state else symbol, 0.0)
    return Transducer(table, alphabet)


def _insults() -> Transducer:
    """States: nothing, then how many words an intensifier reaches, then how many an insult does."""
    table = {}
    for state in range(2 * CLOSE + 1):
        intense, again = 0 < state <= CLOSE, state > CLOSE
        for symbol in INPUT:
            fade = 0 if state in (0, CLOSE + 1) else state - 1
            after = CLOSE if symbol == "very" else 2 * CLOSE if symbol == "insult" else fade
            weight = (INTENSE if intense else AGAIN if again else 0.0) if symbol == "insult" else 0.0
            table[state, symbol] = (after, symbol, weight)
    return Transducer(table, INPUT)


def _threats() -> Transducer:
    """States: nothing, first person, its future, threat alone, threat of the first person. The target of a threat is put out as menace."""
    nothing, person, coming, alone, own = range(5)
    table = {(state, symbol): (state, symbol, 0.0) for state in range(5) for symbol in INPUT}
    table[nothing, "self"] = (person, "self", 0.0)
    table[person, "future"] = (coming, "future", 0.0)
    for state, arc, after in ((nothing, "alone", alone), (person, "self", own), (coming, "future", own), (alone, "alone", alone), (own, "self", own)):
        table[state, "threat"] = (after, "threat", THREAT_ARCS[arc])
    table[alone, "target"] = (nothing, "menace", TARGET_ARCS["alone"])
    table[own, "target"] = (person, "menace", TARGET_ARCS["self"])
    return Transducer(table, INPUT)


def grammar() -> Transducer:
    """Insult, threat, negation, report, target. A clause starts in state 0."""
    negation = _turning(INPUT | {"menace"}, {"negation"}, {"insult": "negated", "threat": "word", "menace": "word"}, REACH)
    report = _turning(MIDDLE, {"report"}, {"insult": "reported", "negated": "reported", "threat": "word", "menace": "word"}, None)
    target = _turning(MIDDLE, {"target", "menace"}, {"insult": "aimed"}, REACH)
    return _insults().then(_threats()).then(negation).then(report).then(target)


def backward() -> Transducer:
    """Reads what the grammar put out from the end of the clause: report, then target."""
    report = _turning(FINAL, {"report"}, {"insult": "reported", "aimed": "reported", "negated": "reported", "threat": "word", "menace": "word"}, BACK)
    return report.then(_turning(FINAL, {"target", "menace"}, {"insult": "aimed"}, REACH))


MACHINES = (grammar(), backward())


def clause_outputs(words: list[str], insults, following: list[str] = (), machines: tuple[Transducer, Transducer] = MACHINES) -> list[tuple[str, float]]:
    """(kind, weight) of each word of a clause; ``following`` are the words of the next clause."""
    forth, back = machines
    symbols = [SYMBOLS.get(w) or ("insult" if w in insults else "word") for w in words]
    first = forth.read(symbols)
    kinds = [k for k, _ in back.read([k for k, _ in reversed(first)])][::-1]
    if any(SYMBOLS.get(w) == "report" for w in following[:2]):
        turns = {"insult": "reported", "aimed": "reported", "negated": "reported", "threat": "word", "menace": "word"}
        kinds = [turns.get(k, k) for k in kinds]
    return [("threat" if k == "menace" else k, weight) for k, (_, weight) in zip(kinds, first)]


def _weigher(atoms: dict[str, float]):
    """Weight of a word: that of the word itself, or of its longest learned beginning."""
    words = {a: w for a, w in atoms.items() if not a.endswith("*")}
    starts = [(n, {a[:-1]: w for a, w in atoms.items() if a.endswith("*") and len(a) == n + 1}) for n in sorted(PREFIXES, reverse=True)]
    starts = [(n, table) for n, table in starts if table]

    def weight(word: str) -> float:
        found = words.get(word)
        if found is not None:
            return found
        for n, table in starts:
            found = table.get(word[:n])
            if found is not None and len(word) > n:
                return found
        return 0.0

    return weight


def clause_features(text: str | None, weight) -> list[float]:
    """Logarithms of what the grammar puts out by kind, of the strongest clause, and of the whole per word.

    A word adds once to each kind it is put out as, whatever it was put out as before, and once to the value of each
    clause: repeated lines are no stronger than one.
    """
    sums, strongest, seen = [0.0] * len(OUTPUTS), 0.0, {}
    lower = (text or "").lower()
    tokens = _TOKEN.findall(lower)
    kinds = set(tokens)
    insults = {t: w - MIN_WEIGHT + 1 for t in kinds if t not in SYMBOLS and (w := weight(t))}
    if insults or any(SYMBOLS.get(t) == "threat" for t in kinds):
        clauses = _CLAUSE.split(lower)
        for i, clause in enumerate(clauses):
            words = _TOKEN.findall(clause)
            if not any(w in insults or SYMBOLS.get(w) == "threat" for w in words):
                continue
            value, here = 0.0, set()
            following = _TOKEN.findall(clauses[i + 1]) if i + 1 < len(clauses) else []
            for word, (out, arc) in zip(words, clause_outputs(words, insults, following)):
                if out in OUTPUTS:
                    gained = insults.get(word, 0.0) + arc
                    # The heaviest path of a word counts.
                    before = seen.get((out, word), 0.0)
                    if gained > before:
                        seen[out, word] = gained
                        sums[OUTPUTS.index(out)] += gained - before
                    if word not in here:
                        here.add(word)
                        value += gained
            strongest = max(strongest, value)
    return [*(math.log1p(x) for x in sums), math.log1p(strongest), math.log1p(100 * sum(sums) / (len(tokens) + 20))]


def learned_atoms(labelled: DataFrame, most: int = ATOMS) -> dict[str, float]:
    """Words, and beginnings marked by a star, with log-odds weights; at most ``most``, the heaviest first.

    A text teaches once, with the label that most of its rows have. A beginning is counted by the words that start with it.
    """
    labels = labelled.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    texts = labels.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))).alias("w"))
    words = texts.select("toxic", F.explode("w").alias("atom"))
    words = staged(words.groupBy("atom").agg(F.sum("toxic").cast("long").alias("pos"), F.count("*").alias("all")), "atoms")
    starts = words.select(F.explode(F.array(*[
        F.when(F.length("atom") > n, F.concat(F.left("atom", F.lit(n)), F.lit("*"))) for n in PREFIXES])).alias("atom"), "pos", "all")
    both = words.union(starts.filter("atom is not null").groupBy("atom").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all")))
    p, n = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not p or not n:
        return {}
    odds = F.log((F.col("pos") + 0.1) / (p + 1.0)) - F.log((F.col("all") - F.col("pos") + 0.1) / (n + 1.0))
    best = both.withColumn("weight", odds).filter((F.col("pos") >= max(MIN_SUPPORT, math.ceil(0.02 * p))) & (F.col("weight") >= MIN_WEIGHT))
    return {r.atom: r.weight for r in best.orderBy(F.desc("weight"), "atom").limit(most).collect()}


def toxicity_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_rows: int = LABEL_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the sums of the clauses by kind."""
    known = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = known.withColumn("text", F.coalesce("text", F.lit("")))
    part = id_crc(F.col("doc_id")) % 3
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "toxic is not null and doc_id is not null").filter(part != 1).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(label_rows)
    taught = staged(known.filter("text is not null").join(F.broadcast(staged(sample, "labels")), "doc_id").withColumn("part", part), "labelled")  # bounded by label_rows
    atoms = learned_atoms(taught.filter("part = 0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = _weigher(atoms)
        for batch in batches:
            rows = [clause_features(t, weight) for t in batch["text"]]
            yield batch.drop(columns="text").assign(**{o: [s[i] for s in rows] for i, o in enumerate(FEATURES)})

    kinds = ", ".join(f"{o} double" for o in FEATURES)
    features = array_to_vector(F.array(*FEATURES))
    fit = staged(taught.filter("part = 2").select("toxic", "text").mapInPandas(run, f"toxic int, {kinds}").withColumn("x", F.array(*FEATURES)), "fit")
    share, low, high = fit.agg(F.avg("toxic"), F.min("toxic"), F.max("toxic")).first()
    sums = docs.mapInPandas(run, f"doc_id long, {kinds}")
    if low == high:
        score = F.lit(float(share or 0.0))
    else:
        model = LogisticRegression(featuresCol="f", labelCol="toxic", regParam=1e-3, maxIter=60, standardization=False).fit(
            fit.select("toxic", features.alias("f")))
        line = F.lit(float(model.intercept))
        for name, c in zip(FEATURES, model.coefficients):
            line = line + F.col(name) * F.lit(float(c))
        score = 1 / (1 + F.exp(-line))
    return sums.select(
        "doc_id", (part == 1).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *FEATURES)
