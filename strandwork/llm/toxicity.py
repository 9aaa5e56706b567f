"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers are composed into one machine. The lexical transducer turns a
word into a class: insult, threat, target, negation, reported speech or other.
The modifiers read classes and remember, inside a clause, that it was negated,
that it reports somebody else's words, that it names a target. Their product
gives every insult or threat a factor that depends on its clause, and the score
of a text is formed from matched clauses, not from isolated words.

The insults are learned from labels: whole words, and word beginnings for
languages that compound. The other classes are closed lists.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import text_of

#: Bound of the labelled rows that the lexicon and the calibration are fitted on.
FIT_ROWS = 12_000
#: Bound of the learned lexicon; a worker holds it in memory.
LEXICON_ENTRIES = 5_000
STEM_LENGTHS = (4, 5, 6)
LEAST_LOG_ODDS = 3.0
STEM_LOG_ODDS = 4.5

# Closed word classes of the grammar in English, German, Spanish, French.
THREATS = "kill destroy hurt beat töten umbringen schlagen matar golpear destruir tuer frapper détruire".split()
TARGETS = "you your yourself du dich dir ihr tú te ti usted ustedes vosotros tu toi vous".split()
NEGATIONS = "not never no nicht nie kein keine nunca jamás ne pas jamais".split()
REPORTS = "said says told called wrote sagte sagt schrieb nannte dijo dice llamó escribió dit disait écrit appelé".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLAUSE = re.compile(r"[^.,;:!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """States 0..n-1 from state 0; ``arcs[state][symbol]`` is (next state, symbol out, weight)."""

    def __init__(self, arcs: list[dict[int, tuple[int, int, float]]]):
        self.arcs = arcs

    def compose(self, then: Transducer) -> Transducer:
        """Feed the symbols that this one writes to ``then``; weights multiply."""
        states = list(product(range(len(self.arcs)), range(len(then.arcs))))
        number = {s: i for i, s in enumerate(states)}
        arcs = []
        for a, b in states:
            out = {}
            for symbol, (a2, mid, w) in self.arcs[a].items():
                b2, last, v = then.arcs[b][mid]
                out[symbol] = (number[a2, b2], last, w * v)
            arcs.append(out)
        return Transducer(arcs)


def _switch(symbol: int, before: dict[int, float], after: dict[int, float]) -> Transducer:
    """Two states; ``symbol`` turns the second on until the clause ends. The
    dictionaries scale symbols in either state; all symbols pass."""
    every = range(6)
    first = {s: (1 if s == symbol else 0, s, before.get(s, 1.0)) for s in every}
    second = {s: (1, s, after.get(s, 1.0)) for s in every}
    return Transducer([first, second])


@functools.lru_cache(maxsize=1)
def grammar() -> Transducer:
    """Negation softens, reported speech softens, a named target makes insults heavier
    and turns threatening words into threats."""
    negation = _switch(NEGATION, {}, {INSULT: 0.6, THREAT: 0.1})
    reported = _switch(REPORT, {}, {INSULT: 0.7, THREAT: 0.5})
    target = _switch(TARGET, {THREAT: 0.1}, {INSULT: 1.3, THREAT: 1.0})
    return negation.compose(reported).compose(target)


@dataclass(frozen=True)
class ToxicityModel:
    """Learned insults (``"word"`` or ``"stem*"`` to weight) and the calibration."""

    insults: tuple[tuple[str, float], ...]
    offset: float
    slope: float

    @functools.cached_property
    def machine(self):
        """(search automaton over insult and threat words, class of closed words, insult weights)."""
        import ahocorasick

        weights = dict(self.insults)
        find = ahocorasick.Automaton()
        for entry in [*weights, *THREATS]:
            find.add_word(entry.rstrip("*"), len(entry.rstrip("*")))
        if len(find):
            find.make_automaton()
        closed = {w: c for words, c in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
        return find, closed, weights

    def weight(self, word: str) -> float:
        """Weight of a word's heaviest entry, 0 for a word without one."""
        weights = self.machine[2]
        return max([weights.get(word, 0.0), *(weights.get(word[:n] + "*", 0.0) for n in STEM_LENGTHS if len(word) >= n)])

    def clause_weights(self, text: str) -> list[float]:
        """Weights of the clauses of one text that match the grammar."""
        find, closed, _ = self.machine
        text = text.lower()
        hits = [end - n + 1 for end, n in find.iter(text)]
        hits = sorted(h for h in hits if h == 0 or not text[h - 1].isalpha())
        out, arcs, at = [], grammar().arcs, 0
        for h in hits:
            if h < at:
                continue  # its clause has been read
            start = max(text.rfind(c, at, h) for c in ".,;:!?\n") + 1
            clause = _CLAUSE.match(text, max(start, at))
            at = clause.end()
            state, total = 0, 0.0
            for word in _WORD.findall(clause.group()):
                insult = self.weight(word)
                symbol = INSULT if insult else closed.get(word, OTHER)
                state, symbol, factor = arcs[state][symbol]
                total += factor * (insult if symbol == INSULT else 1.0 if symbol == THREAT else 0.0)
            if total:
                out.append(total)
        return out

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.offset + self.slope * min(evidence, 8.0))))


def _entries(word: Column) -> Column:
    """The lexicon entries that a word may match: itself and its beginnings."""
    return F.filter(F.array(
        F.when(F.length(word) >= 3, word),
        *[F.when(F.length(word) >= n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in STEM_LENGTHS],
    ), lambda x: x.isNotNull())


def held_out(ident: str = "doc_id") -> Column:
    """Rows kept from fitting: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn insults and calibration from at most ``fit_rows`` labelled rows that are not held out.

    The rows are those of the least id hashes. Equal texts count once. An entry
    must stand in enough toxic texts and be far likelier there than elsewhere.
    Without labels of both kinds the lexicon is empty and only threats score.
    Null ids and labels are left out; of several labels of an id the largest holds.
    """
    known = labels.filter(F.col(ident).isNotNull() & F.col(label).isin(0, 1) & ~held_out(ident))
    known = known.groupBy(F.col(ident).alias("id")).agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col(ident).alias("id"), text_of(text).alias("t")).join(F.broadcast(known), "id")  # at most fit_rows rows of two numbers
    rows = rows.groupBy("t").agg(F.max("y").alias("y"))
    words = F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: w != "")
    terms = rows.select("y", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct(words), _entries)))).alias("term"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    least = max(4, round(0.008 * toxic))
    counts = terms.groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).filter(F.col("pos") >= least)
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("pos") + 0.5) / (total - toxic + 1.0))
    likely = counts.withColumn("w", odds).filter(F.col("w") >= F.when(F.col("term").endswith("*"), STEM_LOG_ODDS).otherwise(LEAST_LOG_ODDS))
    # A word of one text and its near copies always follows the same word; an
    # insult stands in many contexts.
    follows = rows.filter("y = 1").select(words.alias("ws")).select(F.explode(F.transform("ws", lambda w, i: F.struct(w.alias("w"), F.get("ws", i - 1).alias("prev")))).alias("p"))
    contexts = follows.select(F.explode(_entries(F.col("p.w"))).alias("term"), F.coalesce("p.prev", F.lit("")).alias("prev"))
    contexts = contexts.join(likely.select("term"), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("contexts"))
    found = likely.join(contexts.filter(F.col("contexts") >= least), "term").orderBy(F.desc(F.col("pos") * F.col("w")), "term").limit(LEXICON_ENTRIES)
    entries = tuple((r.term, min(r.w, 6.0) / 6.0) for r in found.collect())
    raw = ToxicityModel(entries, 0.0, 0.0)
    scored = _evidence(rows, raw, "t", "evidence").groupBy(F.round(F.least("evidence", F.lit(8.0)) * 4).alias("bin"), "y").agg(F.count("*").alias("n"))
    return ToxicityModel(entries, *_calibrate([(r.bin / 4, r.y, r.n) for r in scored.collect()]))


def _calibrate(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope of a logistic curve by Newton steps; two pseudo rows and a
    small penalty keep them finite."""
    x, y, n = (np.array(c, float) for c in zip(*points, (0.0, 0, 1), (2.0, 1, 1)))
    beta = np.array([-2.0, 3.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * (y - p)) - 0.05 * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def _evidence(df: DataFrame, model: ToxicityModel, text: str, out: str, probability: bool = False) -> DataFrame:
    """``df`` with the summed clause weights, or their calibrated probability."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [sum(ours.clause_weights(t)) if t else 0.0 for t in part.column(text).to_pylist()]
                if probability:
                    found = [ours.probability(x) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], schema.names)

    return df.mapInArrow(run, schema)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``: the probability, 0 to 1, that a text is toxic.

    Null and empty texts have no clause and get the probability of a text without
    evidence. Only the text decides. A column named ``out`` is replaced.
    """
    return _evidence(df.drop(*[c for c in df.columns if c.lower() == out.lower()]), model, text, out, True)
