"""Toxicity by a weighted finite-state pattern grammar.

A word becomes a symbol: insult, threat, target, negation, report or other. Small transducers
over symbols rewrite insults and threats that stand behind a negation, under a verb of saying,
or next to a target. What a target follows is marked by a machine that reads the clause from its
end; the others are composed to one table of (state, symbol) that reads on from there. A clause
counts by what it matched, not by the words it holds. Weights of insults are log ratios of
documents learned from labelled rows, for words and for word beginnings; a logistic curve weighs
the kinds of matched clauses against each other, those of threats about a prior.

The lexicon and the curve are fitted on at most `sample` labelled rows of each class, the curve on
rows whose half of the sample taught nothing to the lexicon they are read with.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.quality import sampled_texts
from waymark.llm.shared import held_out, small_batches, table, written
from waymark.llm.tokens import text_list

SAMPLE = 4000
THRESHOLD = 0.3
# The lexicon: the strongest terms, each in this share of toxic samples at least, and this
# many times likelier in them (as a logarithm).
LEXICON = 4000
SUPPORT = 0.003
LEAST_WEIGHT = 3.0
# A beginning stands for words never seen, so it must be clearer.
LEAST_BEGINNING = 4.0
BEGINNINGS = (4, 5, 6)
CACHED = 400_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# What a match turns into on its way through the transducers.
PLAIN, AIMED, DENIED, REPORTED = range(4)
KINDS = 4
FUNCTION_WORDS = {
    TARGET: "you your yours he she him her they them people du dich dir ihr euch sie tu toi vous te ti usted ustedes vosotros ellos ils elles",
    NEGATION: "not no never none nobody without isn aren don nicht kein keine keinen nie niemals pas jamais aucun sans nunca jamás ningún sin",
    REPORT: "said says say wrote claimed quoted called sagte sagt schrieb dit disait écrit dijo dice escribió",
}
# Threats as stems and their endings, and forms that follow no such rule.
THREAT_FORMS = (
    ("kill murder hurt destroy burn beat crush shoot", ",s,ed,ing"),
    ("strangl", "e,es,ed,ing"),
    ("töt schlag würg", "en,e,est,et,t,te,ten"),
    ("tu frapp brûl étrangl", "er,e,es,ez,ent,erai,eras,era,é,és"),
    ("mat golpe quem", "ar,o,as,an,aré,arás,ará,ado,ando"),
    ("stab stabs stabbed stabbing shot beaten burnt schlägt schlägst getötet geschlagen umbringen", ""),
)
# What the curve expects of threats before it has seen any, by kind.
THREAT_PRIOR = (0.2, 3.0, 0.3, 0.3)
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """`arcs[state][symbol]` is the next state and the symbol to write; missing: stay, copy."""

    arcs: dict[int, dict[int, tuple[int, int]]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get(state, {}).get(symbol, (state, symbol))


# Symbols of matches within the machine: 10 * kind + INSULT or THREAT; kind 0 is PLAIN.
def _marked(kind: int, symbol: int) -> int:
    return 10 * kind + symbol


def _scope(opener: int, kind: int, reach: int | None) -> Transducer:
    """Matches behind `opener` become `kind`: for `reach` symbols, or to the clause's end."""
    arcs: dict[int, dict[int, tuple[int, int]]] = {}
    last = reach or 1
    matches = [_marked(k, m) for k in range(KINDS) for m in (INSULT, THREAT)]
    for left in range(last + 1):
        after = (left if reach is None else left - 1) if left else 0
        arcs[left] = {s: (after, s) for s in (OTHER, TARGET, NEGATION, REPORT)}
        arcs[left] |= {m: (after, _marked(kind, m % 10) if left else m) for m in matches}
        arcs[left][opener] = (last, opener)
    return Transducer(arcs)


def compose(machines: list[Transducer], symbols: list[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """One table for the machines run after each other, over the states reached from the start."""
    numbers = {(0,) * len(machines): 0}
    todo, out = [(0,) * len(machines)], {}
    while todo:
        states = todo.pop()
        for symbol in symbols:
            written, after = symbol, []
            for machine, state in zip(machines, states):
                state, written = machine.step(state, written)
                after.append(state)
            key = tuple(after)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            out[numbers[states], symbol] = (numbers[key], written)
    return out


_SYMBOLS = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]
# From the clause's end: matches before a target. Then from its beginning, over what that wrote.
BACKWARD = compose([_scope(TARGET, AIMED, 3)], _SYMBOLS)
GRAMMAR = compose(
    [_scope(TARGET, AIMED, 4), _scope(NEGATION, DENIED, 3), _scope(REPORT, REPORTED, None)],
    [*_SYMBOLS, _marked(AIMED, INSULT), _marked(AIMED, THREAT)],
)


def read_clause(symbols: list[int]) -> list[int]:
    """A clause's symbols with its matches marked by their kinds."""
    if TARGET in symbols:
        state, marked = 0, []
        for symbol in reversed(symbols):
            state, symbol = BACKWARD[state, symbol]
            marked.append(symbol)
        symbols = marked[::-1]
    state, out = 0, []
    for symbol in symbols:
        state, symbol = GRAMMAR[state, symbol]
        out.append(symbol)
    return out


@dataclass
class Grammar:
    """The fitted grammar: weights of words and of beginnings, and the curve over clause kinds."""

    words: dict[str, float]
    beginnings: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [0.0] * (3 * KINDS + 2))

    def __post_init__(self) -> None:
        threats = {stem + e for stems, ends in THREAT_FORMS for stem in stems.split() for e in ends.split(",")}
        self._fixed = {w: (THREAT, 1.0) for w in threats}
        self._fixed |= {w: (s, 1.0) for s, words in FUNCTION_WORDS.items() for w in words.split()}
        self._cache: dict[str, tuple[int, float] | None] = {}

    def symbol(self, word: str) -> tuple[int, float] | None:
        """A lower-case word's symbol and weight, None for an ordinary word."""
        found = self._fixed.get(word)
        if found is None or word in self.words:
            weight = self.words.get(word, 0.0)
            for size in BEGINNINGS:
                if len(word) > size:
                    weight = max(weight, self.beginnings.get(word[:size], 0.0))
            if weight:
                found = (INSULT, weight)
        return found

    def features(self, text: str) -> np.ndarray:
        """Per kind of match the sum of clause weights, damped, and the greatest, and its threats; and the share of insults."""
        out = np.zeros(3 * KINDS + 1)
        text = text.lower()
        words = _WORD.findall(text)
        cache = self._cache
        try:
            symbols = set(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > CACHED:
                cache.clear()
            for word in set(words):
                if word not in cache:
                    cache[word] = self.symbol(word)
            symbols = {cache[w] for w in words}
        if not any(s and s[0] in (INSULT, THREAT) for s in symbols):
            return out
        hits = 0
        for clause in _CLAUSE.split(text):
            read = [cache[word] or (OTHER, 0.0) for word in _WORD.findall(clause)]
            if not any(symbol in (INSULT, THREAT) for symbol, _ in read):
                continue
            best: dict[int, float] = {}
            for symbol, (_, weight) in zip(read_clause([symbol for symbol, _ in read]), read):
                kind, match = divmod(symbol, 10)
                if match == INSULT:
                    hits += 1
                    best[kind] = best.get(kind, 0.0) + weight
                elif match == THREAT:
                    out[2 * KINDS + kind] += 1.0
            for kind, weight in best.items():
                out[kind] += weight
                out[KINDS + kind] = max(out[KINDS + kind], weight)
        out[:KINDS] = np.log1p(out[:KINDS])
        out[2 * KINDS : -1] = np.log1p(out[2 * KINDS : -1])
        out[-1] = hits / len(words)
        return out

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.curve[:-1] + self.curve[-1])
        return 1 / (1 + exp(-min(max(z, -30.0), 30.0)))


def _terms(text: str) -> set[str]:
    """A text's words, and beginnings of its longer words (marked by a star)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def _curve(rows: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method, damped towards the prior: weights, then constant."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    prior = np.zeros(x.shape[1])
    prior[2 * KINDS : 3 * KINDS] = THREAT_PRIOR
    beta, damp = prior.copy(), np.eye(x.shape[1]) * 0.5
    damp[-1, -1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - damp @ (beta - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, gradient)
        beta = beta + step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
    return beta.tolist()


def _half(text: str) -> int:
    """Which half of the sample a text belongs to; equal texts to the same."""
    return zlib.crc32(text.encode()) & 1


def _lexicon(counts: DataFrame) -> Grammar:
    """The strongest terms of counted documents (`term, toxic, clean`; the empty term: all of them)."""
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    size = counts.where("term = ''").select(F.col("toxic").alias("all_toxic"), F.col("clean").alias("all_clean"))
    # Cautious counts, a standard deviation towards each other: few samples prove little.
    weight = F.log((F.col("toxic") - F.sqrt("toxic")) / (F.col("all_toxic") + 1)) - F.log(
        (F.col("clean") + F.sqrt("clean") + 0.5) / (F.col("all_clean") + 1)
    )
    ranked = (
        counts.where("term <> ''")
        .join(F.broadcast(size))  # one row
        .where(F.col("toxic") >= F.greatest(F.lit(2), F.col("all_toxic") * SUPPORT))
        .select("term", weight.alias("weight"), (F.col("toxic") * weight).alias("evidence"))
        .where(
            F.col("weight")
            >= F.when(F.col("term").endswith("*"), LEAST_BEGINNING).otherwise(LEAST_WEIGHT)
        )
        .orderBy(F.desc("evidence"), "term")
        .limit(LEXICON)
    )
    lexicon = {r.term: r.weight for r in ranked.collect()}
    return Grammar(
        {t: w for t, w in lexicon.items() if not t.endswith("*")},
        {t[:-1]: w for t, w in lexicon.items() if t.endswith("*")},
    )


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Fit on `docs` (`doc_id`, `text`) whose `labels` (`doc_id`, `toxic`) may be learned from.

    Rows of null id or label teach nothing; without rows of both classes every score is the
    share of toxic rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    known = known.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = min(max(totals.get(1, 0) / max(1, sum(totals.values())), 1e-9), 1 - 1e-9)
        return Grammar({}, {}, [0.0] * (3 * KINDS + 1) + [log(share / (1 - share))])
    taught = sampled_texts(docs, known, sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(half, toxic): Counter() for half in (0, 1) for toxic in (0, 1)}
            for text, toxic in zip(text_list(batch["text"]), batch["toxic"]):
                own = found[_half(text), int(toxic)]
                own.update(_terms(text))
                own[""] += 1
            rows = [(t, h, found[h, 1][t], found[h, 0][t]) for h in (0, 1) for t in found[h, 0] | found[h, 1]]
            yield pd.DataFrame(rows, columns=["term", "half", "toxic", "clean"])

    counts = taught.mapInPandas(count, "term string, half int, toxic long, clean long")
    counts = counts.groupBy("term", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "toxic-terms")
    grammar = _lexicon(counts)
    # Each half is described by what the other half taught.
    shared = spark.sparkContext.broadcast([_lexicon(counts.where(F.col("half") != half)) for half in (0, 1)])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = text_list(batch["text"])
            rows = [shared.value[_half(t)].features(t).tolist() for t in texts]
            yield pd.DataFrame({"features": rows, "toxic": batch["toxic"]})

    # At most 2 * `sample` rows of a dozen numbers.
    rows = taught.mapInPandas(describe, "features array<double>, toxic int").toPandas()
    order = np.lexsort([*np.array(rows["features"].tolist()).T, rows["toxic"]])
    x, y = np.array(rows["features"].tolist())[order], rows["toxic"].to_numpy()[order].astype(float)
    grammar.curve = _curve(x, y)
    # The sample is balanced, the corpus is not.
    grammar.curve[-1] += log(totals[1] / totals[0]) - log(y.sum() / (len(y) - y.sum()))
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """`doc` (the whole row as a struct) and `score` of each row of `docs`, from `text` alone.

    A null or empty text has the score of a text without a match; every row gives one row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(grammar)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in text_list(texts)], dtype=float)

    scored = F.pandas_udf(score, "double")
    return docs.select(F.struct("*").alias("doc"), scored(F.col("text").cast("string")).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    grammar = train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), grammar)
    return scored.select(
        "doc.doc_id",
        held_out(F.col("doc.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
