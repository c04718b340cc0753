"""Toxic texts by a weighted finite-state grammar of clauses.

Words and punctuation become symbols (insult, threat, target, negation, report, other; break, quote, end).
Small transducers mark what stands around a match: the negation transducer marks matches shortly after a
negation, words set off by commas right behind it not counted; the report transducer those after a verb of
speech, to the end of the sentence or, behind a quotation mark, of the quotation; the target transducer those
aimed at somebody in the same clause, and it turns a threat followed by a target into a match. Composed into
one machine they read each line once, clause after clause. A speech verb behind its quotation is not seen.

A match weighs its word's weight, at most ``WEIGHT_MOST``, times the scale of its context. Evidence sums over
the clauses of a text: aimed and direct matches add up over distinct clauses; any other match of a word counts
once, in the heaviest clause, with at most ``lone``, which is under the bias. So a lone word does not decide,
unless labelled texts with nothing but one such word are toxic: ``lone`` may rise by these. The score is
the evidence's logistic value.

Weights come from labelled rows: a term (word or word beginning) is an insult if its share of toxic
texts is significantly over the average, its weight the log odds of that share. Context scales start at
defaults and move with the labelled matches. Learning takes at most ``max_rows`` labelled rows, chosen
by a hash of their id, and keeps at most ``max_terms`` terms; both bound what is broadcast.

Defined cases: a null text counts as empty and gets the bias alone; rows with a null id or label teach
nothing; of several labels of an id the largest holds; without any labels only the built-in insults
count. Extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convolens.llm.text import bounded_batches, first_missing, hashed_sample, remainder, whole
from convolens.scale import keep

# Seed words of the grammar, by part.
SEEDS = {
    "insult": "idiot moron stupid imbecile fool loser scum trash filth vermin pathetic worthless disgusting clown jerk "
              "dumb dumm trottel abschaum imbécile crétin ordure basura imbécil estúpido".split(),
    "threat": "kill hurt destroy beat stab shoot burn töten umbringen tuer frapper matar golpear".split(),
    "target": "you your yours yourself they them he she him her dich euch du ihr toi vous ti ustedes".split(),
    "negation": "not never no nor without nicht kein keine nie pas jamais sin nunca".split(),
    "report": "said says wrote claimed quoted called alleged sagte schrieb disait écrivait dijo escribió".split(),
}
SEED_WEIGHT = 4.0
BIAS = -3.5
MIN_WEIGHT = 2.0
NEGATION_SCOPE = 3
WEIGHT_MOST = 6.0
LONE_MOST = 3.0
AIMED = "+"
SCALES = {"": 1.0, "+": 1.2, "-": 0.3, "~": 0.5, "+-": 0.3, "+~": 0.5, "-~": 0.2, "+-~": 0.2}
PRIOR_DOCUMENTS = 10
MAX_ROWS = 50_000
MAX_TERMS = 50_000
FLUSH = 200_000

WORDS = re.compile(r"[^\W\d_]+")
LINES = re.compile(r"[\n\r]+")
PARTS = re.compile(r"([^\W\d_]+)|([.!?;]+)|([\"“”„«»])|[:,()\[\]]+")
MATCHES = ("insult", "threat")
PUNCTUATION = ("break", "quote", "end")
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other", *PUNCTUATION)


# Transducers: {(state, symbol): (next state, symbol out)}, from state 0; a missing arc copies the symbol.

def negation_transducer(scope: int = NEGATION_SCOPE) -> dict:
    """States: how many more words are in scope, or "aside" from a break right behind the negation to the next break."""
    arcs = {}
    for state, symbol in product(range(scope + 1), SYMBOLS):
        after = scope if symbol == "negation" else max(0, state - 1)
        arcs[state, symbol] = (after, symbol + "-" if state and symbol in MATCHES else symbol)
        if symbol in PUNCTUATION:
            arcs[state, symbol] = (0 if symbol == "end" else state, symbol)
    arcs[scope, "break"] = ("aside", "break")
    arcs |= {("aside", "break"): (scope, "break"), ("aside", "end"): (0, "end"), ("aside", "negation"): (scope, "negation")}
    return arcs


def report_transducer() -> dict:
    """States: 0 direct, 1 reported to the end of the sentence, 2 to the end of the quotation, 3 in one without a report."""
    arcs = {}
    for state, symbol in product(range(4), SYMBOLS + tuple(m + "-" for m in MATCHES)):
        marked = state in (1, 2) and symbol.startswith(MATCHES)
        arcs[state, symbol] = (state, symbol + "~" if marked else symbol)
    arcs |= {(0, "report"): (1, "report"), (1, "end"): (0, "end")}
    arcs |= {(state, "quote"): (after, "quote") for state, after in enumerate((3, 2, 0, 0))}
    return arcs


def target_transducer() -> dict:
    """States: 0 nothing, 1 target seen in this clause, and ("threat", marks) while a threat waits for its target."""
    marks = ("", "-", "~", "-~")
    arcs = {}
    for state in (0, 1, *(("threat", m) for m in marks)):
        waits = isinstance(state, tuple)
        for symbol in SYMBOLS:
            arcs[state, symbol] = (0 if symbol in PUNCTUATION else state, symbol)
        arcs[state, "target"] = (1, "threat+" + state[1]) if waits else (1, "target")
        for m in marks:
            arcs[state, "insult" + m] = (state, ("insult+" if state == 1 else "insult") + m)
            arcs[state, "threat" + m] = (("threat", m), "other")
    return arcs


def compose(first: dict, second: dict) -> dict:
    """The machine that feeds the output of ``first`` to ``second``."""
    arcs, reached = {}, [(0, 0)]
    for a, b in reached:
        for symbol in SYMBOLS:
            a2, middle = first.get((a, symbol), (a, symbol))
            b2, out = second.get((b, middle), (b, middle))
            arcs[(a, b), symbol] = ((a2, b2), out)
            if (a2, b2) not in reached:
                reached.append((a2, b2))
    # States get plain numbers, so that the result can be composed again.
    number = {state: i for i, state in enumerate(reached)}
    return {(number[s], symbol): (number[t], out) for (s, symbol), (t, out) in arcs.items()}


def grammar() -> dict:
    return compose(compose(negation_transducer(), report_transducer()), target_transducer())


def terms(word: str) -> list[str]:
    """The word and its beginnings, the features that may carry weight."""
    return [word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)]


class Scorer:
    """Reads texts with the composed machine. ``weights``: of terms; ``scales``: of contexts; ``lone``: the most that
    matches of one word give that are not aimed and direct."""

    def __init__(self, weights: dict[str, float], scales: dict[str, float] = SCALES, bias: float = BIAS, lone: float = LONE_MOST):
        self.weights, self.scales, self.bias, self.lone, self.arcs = weights, scales, bias, lone, grammar()
        self.symbols = {w: s for s in ("threat", "target", "negation", "report") for w in SEEDS[s]}

    def weight(self, word: str) -> float:
        return max((self.weights.get(t, 0.0) for t in terms(word)), default=0.0)

    def matches(self, text: str):
        """(clause, word, context, weight before scaling) of each match."""
        lowered = text.lower()
        heavy = {w: v for w in set(WORDS.findall(lowered)) if (v := self.weight(w)) or self.symbols.get(w) == "threat"}
        if not heavy:
            return
        for line in LINES.split(lowered):
            if not heavy.keys().isdisjoint(WORDS.findall(line)):
                yield from self._line(line, heavy)

    def _line(self, line: str, heavy: dict[str, float]):
        state, threat, start, found = 0, "", 0, []
        for part in PARTS.finditer(line):
            word, end, quote = part.groups()
            if word is None:
                state, _ = self.arcs[state, "end" if end else "quote" if quote else "break"]
                for match in found:
                    yield line[start:part.start()].strip(), *match
                start, found = part.end(), []
                continue
            symbol = "insult" if heavy.get(word) else self.symbols.get(word, "other")
            state, out = self.arcs[state, symbol]
            if symbol == "threat":
                threat = word
            if out.startswith("insult"):
                found.append((word, out[6:], heavy[word]))
            elif out.startswith("threat"):
                found.append((threat, out[6:], SEED_WEIGHT))
        for match in found:
            yield line[start:].strip(), *match

    def clauses(self, text: str) -> dict[str, float]:
        """The matched clauses of a text and what each gives."""
        aimed, other = {}, {}
        for clause, word, context, weight in self.matches(text):
            value = min(weight, WEIGHT_MOST) * self.scales[context]
            if context == AIMED:
                aimed[clause, word] = value
            elif (value := min(value, self.lone)) > other.get(word, ("", -1.0))[1]:
                other[word] = clause, value
        direct, out = {word for _, word in aimed}, defaultdict(float)
        for (clause, _), value in aimed.items():
            out[clause] += value
        for word, (clause, value) in other.items():
            out[clause] += 0.0 if word in direct else value
        return out

    def score(self, text: str) -> tuple[float, int, str | None]:
        """Score, number of matched clauses, the heaviest of them."""
        clauses = self.clauses(text)
        evidence = self.bias + math.fsum(clauses.values())
        top = max(sorted(clauses), key=clauses.get) if clauses else None
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, evidence)))), len(clauses), top


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text and toxic of the labelled rows to learn from: at most ``max_rows`` ids, held-out ids never."""
    usable = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id") != 0))
    chosen = usable.join(F.broadcast(hashed_sample(usable, "doc_id", max_rows)), "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    # At most max_rows pairs of an id and a number: small enough to send everywhere.
    return docs.select("doc_id", whole("text").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("text", "toxic")


def _counted(batches, found):
    """Sum (toxic, clean) texts per feature of ``found(text)``; flushes before the table grows large."""
    def flush(counts):
        keys = list(counts)
        return pa.RecordBatch.from_pydict({
            "term": pa.array(keys, pa.string()), "toxic": pa.array([counts[k][1] for k in keys], pa.int64()),
            "clean": pa.array([counts[k][0] for k in keys], pa.int64())})
    counts = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for feature in found(text):
                counts[feature][1 if toxic else 0] += 1
            if len(counts) > FLUSH:
                yield flush(counts)
                counts.clear()
    yield flush(counts)


def learn_terms(rows: DataFrame, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Weights of the terms that stand out in toxic texts."""
    def run(batches):
        return _counted(batches, lambda text: {t for w in set(WORDS.findall(text.lower())) for t in terms(w)} | {""})

    counts = rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("n"))
    counts = keep(counts.where("t >= 4 OR term = ''"))
    total = counts.where("term = ''").first()
    if total is None or not total.t or not total.n:
        return {w: SEED_WEIGHT for w in SEEDS["insult"]}
    base = F.lit(total.t / (total.t + total.n))
    share = F.col("t") / (F.col("t") + F.col("n"))
    gain = F.col("t") * F.log(share / base) + F.when(
        F.col("n") > 0, F.col("n") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    chosen = (
        counts.where("term <> ''")
        .withColumn("weight", F.log((F.col("t") + 0.1) / (F.col("n") + 0.5)))
        # Over a million terms chance alone would lift one so far.
        .where((share > base) & (F.col("weight") > MIN_WEIGHT) & (gain >= math.log(1e6)))
        .orderBy(F.desc("weight"), "term").limit(max_terms).collect())
    # A seed that the labels show to be harmless loses its weight.
    harmless = {r.term for r in counts.where(F.col("term").isin(SEEDS["insult"]) & (F.col("n") > F.col("t"))).collect()}
    seeds = {w: SEED_WEIGHT for w in SEEDS["insult"] if w not in harmless}
    return seeds | {r.term: float(r.weight) for r in chosen}


def learn_scales(rows: DataFrame, weights: dict[str, float], bias: float = BIAS) -> tuple[dict[str, float], float]:
    """Context scales and ``lone``: defaults, moved by how toxic the labelled texts with such matches are."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        scorer = Scorer(sent.value)

        def found(text):
            seen = {(word, context) for _, word, context, _ in scorer.matches(text)}
            return {context for _, context in seen} | ({"lone"} if len(seen) == 1 and AIMED not in next(iter(seen))[1] else set())
        return _counted(batches, found)

    counts = {r.term: (r.t, r.n) for r in rows.mapInArrow(run, "term string, toxic long, clean long")
              .groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("n")).collect()}
    t, n = counts.pop("lone", (0, 0))
    # The evidence that gives the score which these texts deserve.
    deserved = max(0.0, math.log((t + 1) / (n + 1)) - bias)
    # Clean texts with one weak word say nothing against several words, so it only rises.
    lone = max(LONE_MOST, (PRIOR_DOCUMENTS * LONE_MOST + (t + n) * deserved) / (PRIOR_DOCUMENTS + t + n))
    odds = {c: math.log((t + 1) / (n + 1)) for c, (t, n) in counts.items()}
    plain = odds.get("", 0.0)
    scales = dict(SCALES)
    if plain <= 0:
        return scales, lone
    for context, (t, n) in counts.items():
        if context:
            # With few texts the odds cannot reach those of the plain context; compare at equal counts.
            like = min(plain, math.log(t + n + 1))
            seen = min(1.5, max(0.1, odds[context] / like)) if like > 0 else SCALES[context]
            scales[context] = (PRIOR_DOCUMENTS * SCALES[context] + (t + n) * seen) / (PRIOR_DOCUMENTS + t + n)
    return scales, lone


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Scorer:
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, max_rows)
    weights = learn_terms(rows, max_terms)
    scales, lone = learn_scales(rows, weights)
    return Scorer(weights, scales, lone=lone)


def judged(spark, scorer: Scorer, text: str | Column) -> Column:
    """struct(score, clauses, clause) of a text column."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((scorer.weights, scorer.scales, scorer.bias, scorer.lone))
    kept = []

    @F.pandas_udf("score double, clauses int, clause string")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(Scorer(*sent.value))
        return pd.DataFrame([kept[0].score(t) for t in texts], columns=["score", "clauses", "clause"])

    return run(whole(text))


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted, matched clauses and the heaviest of them."""
    rows = docs.select("doc_id", judged(docs.sparkSession, scorer, "text").alias("j"))
    return rows.select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "j.score",
        (F.col("j.score") >= 0.5).cast("int").alias("predicted"),
        F.col("j.clauses").alias("matched_clauses"), F.col("j.clause").alias("top_clause"))


def reject_toxic(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents that score under 0.5, columns as they are."""
    [j] = first_missing(docs, "judged")
    return docs.withColumn(j, judged(docs.sparkSession, scorer, "text")).where(
        F.col(j)["score"] < 0.5).select(*docs.columns)
