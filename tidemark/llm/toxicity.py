"""Toxicity (operator 9): a weighted finite-state grammar over clauses, with an insult lexicon learned from labels.

Five small transducers read a clause word by word: insults and threats emit weight, a target raises it, negation and
reported speech lower it. Their product is run at once; a document's score grows with the sum over its matched clauses.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Labelled rows that the lexicon and the scale are fitted on, at most; the rows with the smallest hash of their id.
FIT_ROWS = 20_000
#: A term must stand after so many different words in toxic rows (copies of one document count once), and be so much commoner there.
LEAST_CONTEXTS = 6
LEAST_LOG_ODDS = 3.0
#: Terms kept, the heaviest first: the model's size.
LEXICON_SIZE = 20_000
PREFIXES = (4, 5, 6)
SHOWN = 0.3

#: Closed word classes of the grammar, in the four languages of the corpus.
TARGETS = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros they them he she him her".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't without nicht kein keine nie ne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says reported claimed quoted wrote called sagte schrieb nannte zitierte dit écrit cité appelé dijo escribió llamó citó".split())
THREATS = frozenset("kill hurt destroy beat shoot töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_ENDS = re.compile(r"[.!?;\n]+")
REACH = 4
NEGATED, REPORTED, TARGETED, THREAT = 0.4, 0.6, 1.5, 1.0


def clause_weight(clause: str, weight_of) -> float:
    """Run the product automaton over one clause.

    State: words left under a negation, words left near a target, whether speech is reported, weight of the insult or threat
    that still waits for a target. A target after an insult raises it as one before it does; a threat counts only with one.
    """
    negated = near = 0
    reported = False
    total = 0.0
    waiting: tuple[float, int] | None = None  # gain on meeting a target, words left
    for word in WORD.findall(clause):
        factor = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
        weight = weight_of(word)
        if weight:
            total += weight * factor * (TARGETED if near else 1.0)
            waiting = None if near else (weight * factor * (TARGETED - 1), REACH)
        elif word in THREATS:
            if near:
                total += THREAT * factor
            else:
                waiting = (THREAT * factor, REACH)
        elif word in TARGETS:
            if waiting:
                total += waiting[0]
                waiting = None
            near = REACH + 1
        elif word in NEGATIONS:
            negated = REACH + 1
        elif word in REPORTS:
            reported = True
        negated, near = max(0, negated - 1), max(0, near - 1)
        if waiting:
            waiting = (waiting[0], waiting[1] - 1) if waiting[1] > 1 else None
    return total


class Grammar:
    """Scores texts with a lexicon: term -> weight in 0..1; a term that ends in `*` stands for all words it begins."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {t: w for t, w in lexicon.items() if not t.endswith("*")}
        self.starts = {t[:-1]: w for t, w in lexicon.items() if t.endswith("*")}
        self.finder = ahocorasick.Automaton()
        for term in {*self.words, *self.starts, *THREATS}:
            self.finder.add_word(term, len(term))
        self.finder.make_automaton()

    def weight_of(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.starts.get(word[:n], 0.0))
        return found

    def weight(self, text: str) -> float:
        """Sum over all clauses with a match; only those are read word by word."""
        low = text.lower()
        total, done = 0.0, 0
        for end, size in self.finder.iter(low):
            begin = end - size + 1
            if begin < done or begin and low[begin - 1].isalpha():
                continue
            stop = CLAUSE_ENDS.search(low, begin)
            stop = stop.start() if stop else len(low)
            first = max(low.rfind(mark, done, begin) for mark in ".!?;\n") + 1
            total += clause_weight(low[max(first, done) : stop], self.weight_of)
            done = stop
        return total


def terms(text: str) -> Iterator[tuple[str, str]]:
    """Each word and its beginnings, with the word before it."""
    before = ""
    for word in WORD.findall(text.lower()):
        yield word, before
        for n in PREFIXES:
            if len(word) > n:
                yield word[:n] + "*", before
        before = word


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float, float]:
    """Lexicon, slope and intercept from the labelled rows that are not held out.

    Toxic rows name the candidate terms; the clean rows of the sample then only count those. Everything that is
    collected is bounded by LEXICON_SIZE or FIT_ROWS. Without toxic rows the lexicon is empty.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    sample = stored(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"]).select("text", "toxic"), "sample")
    sizes = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, dict[str, int]] = {}
            documents: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                own = set()
                for term, before in terms(text):
                    found.setdefault(term, {})[before] = 1
                    own.add(term)
                for term in own:
                    documents[term] = documents.get(term, 0) + 1
            # Counts per batch; contexts as a short list, at most LEAST_CONTEXTS are of interest.
            names = [*found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([documents[n] for n in names], pa.int64()), pa.array([[*found[n]][:LEAST_CONTEXTS] for n in names], pa.list_(pa.string()))], ["term", "n", "contexts"])

    toxic = sample.where("toxic = 1").select("text").mapInArrow(pairs, "term string, n long, contexts array<string>")
    candidates = toxic.groupBy("term").agg(F.sum("n").alias("toxic_rows"), F.array_size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    names = {r["term"]: r["toxic_rows"] for r in candidates.orderBy(F.desc("toxic_rows"), "term").limit(4 * LEXICON_SIZE).collect()}
    wanted = frozenset(names)

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for term in wanted.intersection(t for t, _ in terms(text)):
                    counts[term] = counts.get(term, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["term", "n"])

    clean = {r["term"]: r["n"] for r in sample.where("toxic = 0").select("text").mapInArrow(clean_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} if wanted else {}
    odds = {t: math.log((n + 0.5) / (sizes.get(1, 0) + 1)) - math.log((clean.get(t, 0) + 0.5) / (sizes.get(0, 0) + 1)) for t, n in names.items()}
    kept = sorted((t for t, w in odds.items() if w >= LEAST_LOG_ODDS), key=lambda t: (-odds[t], t))[:LEXICON_SIZE]
    lexicon = {t: min(1.0, odds[t] / 6) for t in kept}
    grammar_weight = weights(lexicon)
    pairs_ = np.array([(r["w"], r["toxic"]) for r in sample.select(grammar_weight(F.col("text")).alias("w"), "toxic").collect()] or [(0.0, 0)], float)
    return lexicon, *logistic(pairs_[:, 0], pairs_[:, 1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic fit (Newton steps, light shrinkage); the slope is never negative."""
    z = np.log1p(x)
    design = np.stack([z, np.ones_like(z)], 1)
    beta = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(design @ beta).clip(-30, 30)))
        gradient = design.T @ (y - p) - 0.1 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, gradient).clip(-4, 4)
    return max(0.0, float(beta[0])), float(beta[1])


_grammars: dict[int, Grammar] = {}


def weights(lexicon: dict[str, float]):
    """A column function: the grammar's weight of a text; null texts weigh nothing. A worker builds the grammar once."""
    name = zlib.crc32(json.dumps(lexicon, sort_keys=True).encode())

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        if name not in _grammars:
            _grammars.clear()
            _grammars[name] = Grammar(lexicon)
        grammar = _grammars[name]
        return pd.Series([grammar.weight(t) if t else 0.0 for t in texts], dtype="float64")

    return weigh


def scorer(docs: DataFrame, labels: DataFrame):
    """Fit on the labelled rows of docs; a function from a text column to weight and one from weight to score."""
    lexicon, slope, intercept = fit(docs, labels)
    return weights(lexicon), lambda weight: 1 / (1 + F.exp(-(slope * F.log1p(weight) + intercept)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and weight of every row, by text alone.

    Null and empty texts get the score of a text without a match. Null labels and null ids teach nothing; a repeated
    label row counts once, toxic if any is. Rows of docs are kept as they are, repeated or not.
    """
    weigh, score_of = scorer(docs, labels)
    scored = docs.select("doc_id", weigh(F.col("text")).alias("weight"))
    score = score_of(F.col("weight"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= SHOWN).cast("int").alias("predicted"), "weight")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is below SHOWN."""
    weigh, score_of = scorer(docs, labels)
    return docs.withColumn("__weight", weigh(F.col("text"))).where(score_of(F.col("__weight")) < SHOWN).drop("__weight")
