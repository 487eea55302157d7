"""Operator 6: toxicity by a weighted finite-state pattern grammar.

Five transducers read a text word by word: insults, threats, targets (whom they are
aimed at), negation and reported speech.  They are composed into one machine whose
state is the product of theirs.  An arc says how much of a matched word's weight counts
(negation and reported speech take from it) and whether it counts at once or waits,
and which waiting weights it sets free:

* an insult counts at once if a target stands up to four words before it or the text has
  had an insult already; else it waits for a target right after it or for a second insult
  anywhere later.  What nothing sets free counts a tenth: one word that nobody is called is
  no insult, as in a book about a stupid idea;
* a threat waits for a target up to three words after it in its clause ("will kill
  you"); without one a fiftieth counts, as in killing a process.

A clause's score is what counted in it.  A document scores by its clauses together; a
logistic calibration makes this the probability that the label is 1.

The arcs' weights for insults are learnt from labelled rows (crc32(doc_id) mod 5 not
0): words and beginnings of words of 4 to 8 letters whose documents are mostly toxic.
The grammar's own words below are of everyday language.

Null and empty texts score like any text without a match.  Texts are read whole,
whatever their length.  A sample without rows of both labels leaves the grammar's own
words, with a fixed calibration.  Repeated rows and ids give a row each; an empty table
gives none; other columns than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress
from math import log, prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text
from foliant.llm.learn import as_text, fold, labelled_sample, logistic, probability

#: Bounds of the labelled sample: rows of each label, bytes of a row.
PER_CLASS, MOST_BYTES = 3000, 16 << 10
THRESHOLD = 0.5

INSULTS = "idiot idiots moron morons imbecile stupid dumb fool loser losers scum trash pathetic worthless disgusting clown vermin".split()
THREATS = "kill destroy hurt punish smash burn hang strangle".split()
TARGETS = "you your yours he him she her they them du dich dein ihr tu toi ton vous usted te ti ellos".split()
NEGATIONS = "not never no neither nor nicht kein keine nie jamais pas ni nunca jamás".split()
REPORTS = "said says called wrote quoted alleged reported sagte nannte écrit disait dijo llamó".split()

_WORD = re.compile(r"[^\W_]+|[.!?;:\n|]")
INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER = range(7)
SHORTEST, LONGEST = 4, 8
#: Weight of a threat; what counts of a match that nothing sets free.
THREAT_WEIGHT, UNAIMED, EVERYDAY = 5.0, 0.1, 0.02
_MATCH = (INSULT, THREAT)


class Step(NamedTuple):
    """What one transducer says to a word: its next state, the share of a match that
    counts, whether an insult counts at once, and what is set free."""

    state: int
    share: float = 1.0
    now: bool = False
    frees_insult: bool = False
    frees_threat: bool = False
    frees_all: bool = False


def _target(state: int, kind: int) -> Step:
    """Counts down four words from a target; a verb of speaking ends it, for who speaks is not meant."""
    if kind == TARGET:
        return Step(4)
    return Step(0 if kind in (END, REPORT) else max(0, state - 1), now=kind == INSULT and state > 0)


def _insult(state: int, kind: int) -> Step:
    """0 before any insult, 1 after one, 2 right after one.  Goes on over the ends of clauses."""
    if kind == INSULT:
        return Step(2, now=state > 0, frees_all=state > 0)
    return Step(min(state, 1), frees_insult=kind == TARGET and state == 2)


def _threat(state: int, kind: int) -> Step:
    """Counts down three words from a threat, in which a target completes it."""
    if kind == THREAT:
        return Step(3)
    return Step(0 if kind == END else max(0, state - 1), frees_threat=kind == TARGET and state > 0)


def _negation(state: int, kind: int) -> Step:
    """Counts down three words from a negation."""
    if kind == NEGATION:
        return Step(3)
    return Step(0 if kind == END else max(0, state - 1), share=0.4 if state and kind in _MATCH else 1.0)


def _report(state: int, kind: int) -> Step:
    """1 after a verb of speaking, up to the end of the clause."""
    if kind == REPORT:
        return Step(1)
    return Step(0 if kind == END else state, share=0.5 if state and kind in _MATCH else 1.0)


PARTS = (_insult, _threat, _target, _negation, _report)


class Composed:
    """The product machine; states are numbers, arcs are made when first asked for."""

    def __init__(self):
        self.states = [(0,) * len(PARTS)]
        self.arcs: list[list[Step | None]] = [[None] * (OTHER + 1)]
        self._numbers = {self.states[0]: 0}

    def arc(self, number: int, kind: int) -> Step:
        steps = [part(own, kind) for part, own in zip(PARTS, self.states[number], strict=True)]
        state = tuple(s.state for s in steps)
        if state not in self._numbers:
            self._numbers[state] = len(self.states)
            self.states.append(state)
            self.arcs.append([None] * (OTHER + 1))
        flags = (any(s[k] for s in steps) for k in range(2, 6))
        made = self.arcs[number][kind] = Step(self._numbers[state], prod(s.share for s in steps), *flags)
        return made


@dataclass
class Grammar:
    #: Words and word beginnings (those end in *) with weights.
    lexicon: dict[str, float]
    weights: np.ndarray
    machine: Composed = field(default_factory=Composed)

    def __post_init__(self):
        self._own = {w: k for words, k in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}
        self._memo: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def kind(self, word: str) -> tuple[int, float]:
        known = self._memo.get(word)
        if known is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            known = self._memo[word] = self._kind(word.lower())
        return known

    def _kind(self, word: str) -> tuple[int, float]:
        weight = self.lexicon.get(word)
        for n in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
            if weight is not None:
                break
            weight = self.lexicon.get(word[:n] + "*")
        if weight is not None:
            return INSULT, weight
        if word in self._own:
            return self._own[word], THREAT_WEIGHT if self._own[word] == THREAT else 0.0
        return (END if word in ".!?;:\n|" else OTHER), 0.0

    def clauses(self, text: str) -> list[tuple[float, int]]:
        """Score and number of matches of each clause that has one."""
        kinds = list(map(self.kind, _WORD.findall(text)))
        if not any(k <= THREAT for k, _ in kinds):
            return []
        arcs, arc = self.machine.arcs, self.machine.arc
        out, state, total, matches = [], 0, 0.0, 0
        insults = threats = earlier = 0.0  # weights that wait; those of the clauses before
        for kind, weight in [*kinds, (END, 0.0)]:
            step = arcs[state][kind] or arc(state, kind)
            state = step.state
            if kind == OTHER:
                continue
            if kind == INSULT:
                matches += 1
                if step.now:
                    total += weight * step.share
                else:
                    insults += weight * step.share
            elif kind == THREAT:
                threats, matches = threats + weight * step.share, matches + 1
            if step.frees_all:
                total, insults, earlier = total + insults + earlier, 0.0, 0.0
            if step.frees_insult:
                total, insults = total + insults, 0.0
            if step.frees_threat:
                total, threats = total + threats, 0.0
            if kind == END and matches:
                out.append((total + EVERYDAY * threats, matches))
                earlier, insults, threats, total, matches = earlier + insults, 0.0, 0.0, 0.0, 0
        return [*out, (UNAIMED * earlier, 0)] if earlier else out

    def features(self, text: str) -> tuple[float, ...]:
        found = self.clauses(text)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(s for s, _ in found)
        return max(s for s, _ in found), log(1 + total), total / (1 + len(text) / 200)

    def scores(self, texts: list[str]) -> np.ndarray:
        return probability(np.array([self.features(t) for t in texts]).reshape(-1, 3), self.weights)


#: Counters by hash that tell which words and beginnings can be frequent.
_BUCKETS = 1 << 23


def _words_and_beginnings(text: str | bytes) -> list[str]:
    words = {w.lower() for w in re.findall(r"[^\W_]+", as_text(text))}
    return list(words | {w[:n] + "*" for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)})


def _buckets(features: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, features), np.int64, len(features)) & (_BUCKETS - 1)


def learn_lexicon(sample: list[tuple[str | bytes, int]]) -> dict[str, float]:
    """Log odds, document by document, of words and beginnings that are clearly toxic.

    Texts may be rich in words: only those are counted by name whose bucket is full enough,
    which all are that stand in enough toxic documents."""
    rows = Counter(label for _, label in sample)
    if not rows[0] or not rows[1]:
        return {w: 3.0 for w in INSULTS}
    least, seen = max(4, 0.004 * rows[1]), np.zeros(_BUCKETS, np.uint32)
    for text, label in sample:
        if label == 1:
            seen[np.unique(_buckets(_words_and_beginnings(text)))] += 1
    often = seen >= least
    often[_buckets(INSULTS)] = True
    counts = {0: Counter(), 1: Counter()}
    for text, label in sample:
        own = _words_and_beginnings(text)
        counts[label].update(compress(own, often[_buckets(own)].tolist()))
    out = {w: 3.0 for w in INSULTS if not counts[0][w]}
    for feature, n in counts[1].items():
        if n >= least:
            odds = log((n + 0.1) / rows[1]) - log((counts[0][feature] + 0.1) / rows[0])
            if odds > 2.5:
                out[feature] = min(odds, 6.0)
    return out


def fit(sample: list[tuple[str | bytes, int]]) -> Grammar:
    """The lexicon from every other row, the calibration from the rest; then the lexicon from all."""
    by = {y: [x for x in sample if x[1] == y] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 8:
        return Grammar(learn_lexicon([]), np.array([1.0, 1.0, 0.0, -4.0]))
    first = Grammar(learn_lexicon(by[0][::2] + by[1][::2]), np.zeros(4))
    rest = by[0][1::2] + by[1][1::2]
    weights = logistic(np.array([first.features(as_text(t)) for t, _ in rest]), np.array([y for _, y in rest], float), ridge=1e-2)
    return Grammar(learn_lexicon(sample), weights)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Grammar:
    return fit(labelled_sample(docs, labels, "toxic", per_class, most_bytes))


def _score(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(grammar.scores(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = id_and_text(docs, id_col, text_col).mapInArrow(_score(grammar), "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text scores below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(grammar.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
