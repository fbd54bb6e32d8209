"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed into one machine that reads a clause word
by word:

* insult: an acceptor of words and word stems, with a weight each;
* threat: volition, a verb of harm and a target, in that order and close by;
* target: somebody addressed or spoken of near an insult, before or after it;
* negation: a few words in which insults and threats count less;
* reported speech: what follows in a clause is somebody else's word.

Each transducer rewrites a stream of word classes (it marks what is in its
scope); composition feeds the output of one to the next. Weights of what the
last one emits add up to a clause's score, so a word counts by the clause it
stands in. A text's score is a logistic function of its strongest clause and
of all its clauses together.

The acceptor is learned: words and stems that labelled toxic texts have and
clean ones don't, found by sequential covering, each with its log odds; so is
the logistic function. Learning uses a bounded sample of labelled rows
(SAMPLE, the lowest hashes of the ids); scoring is one narrow pass over whole
texts, in which an Aho-Corasick search finds the clauses worth reading.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ids_and_texts, lean

#: Labelled rows to learn from, at most.
SAMPLE = 16_384
#: Candidate words and stems to weigh, at most; those in most toxic rows of the sample come first.
CANDIDATES = 50_000
THRESHOLD = 0.3
STEMS = range(3, 9)
#: Share of the sample's rows with a learned word that must be toxic; share of the toxic rows that make a word worth having beside others.
PRECISE, RATHER = 0.9, 0.02

INSULTS = ("idiot moron scum trash stupid pathetic worthless loser clown disgusting imbecile dumbass bastard scumbag "
           "idiota estúpido imbécil dummkopf arschloch abschaum connard ordure").split()
HARM = "kill hurt destroy murder beat stab shoot strangle töten umbringen tuer matar".split()
VOLITION = "will gonna going shall i'll we'll want should werde werden vais voy".split()
TARGET = "you your you're u he she they him her them his their du dich dir ihr euch tu vous toi eres usted".split()
NEGATION = "not no never neither nor isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais nunca".split()
REPORT = "said says say wrote writes called calls told claimed claims quote quoted reportedly sagte schrieb dit dijo \" “ ” « »".split()

#: Factors of what an insult's or a threat's scope does to its weight.
FACTORS = {"n": 0.4, "r": 0.6, "t": 1.3}
LATE_TARGET, THREAT, SEED_WEIGHT = 0.3, 4.0, 1.0

_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: start state and (state, symbol) -> (state, output)."""
    start: object
    arcs: dict

    @classmethod
    def of(cls, start, step: Callable, alphabet: list[str]) -> Transducer:
        """The reachable part of a step function, as a table."""
        arcs, todo, seen = {}, [start], {start}
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                arcs[state, symbol] = then = step(state, symbol)
                if then[0] not in seen:
                    seen.add(then[0])
                    todo.append(then[0])
        return cls(start, arcs)

    def outputs(self) -> list[str]:
        return sorted({out for _, out in self.arcs.values()})

    def alphabet(self) -> list[str]:
        return sorted({s for _, s in self.arcs})

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one emits is what the other reads."""
        def step(state, symbol):
            own, out = self.arcs[state[0], symbol]
            theirs, out = other.arcs[state[1], out]
            return (own, theirs), out
        return Transducer.of((self.start, other.start), step, self.alphabet())


CLASSES = ["-", "I", "H", "V", "T", "N", "R"]


def _scoped(opens: str, flag: str, width: int) -> Callable:
    """Marks I and H within `width` words after the class `opens`."""
    def step(left, symbol):
        if symbol[0] == opens:
            return width, symbol
        return max(0, left - 1), symbol + flag if left and symbol[0] in "IH" else symbol
    return step


def _threat(state, symbol):
    """V ... H ... T within three words each: the T becomes a threat, with the flags of its H."""
    kind, left, flags = state
    if symbol[0] == "V":
        return ("v", 3, ""), symbol
    if symbol[0] == "H" and kind == "v":
        return ("h", 3, symbol[1:]), symbol
    if symbol[0] == "T" and kind == "h":
        return ("", 0, ""), "!" + flags
    return ((kind, left - 1, flags) if left > 1 else ("", 0, "")), symbol


def _target(state, symbol):
    """Marks an I up to four words after a target; a target up to three words after an I that had none is late."""
    before, after = state
    if symbol[0] == "T":
        return (4, 0), "L" if after else "T"
    if symbol[0] == "I":
        return (max(0, before - 1), 0 if before else 3), symbol + "t" if before else symbol
    return (max(0, before - 1), max(0, after - 1)), symbol


def _grammar() -> Transducer:
    machine = Transducer.of(0, _scoped("N", "n", 3), CLASSES)
    for start, step in ((0, _scoped("R", "r", 12)), (("", 0, ""), _threat), ((0, 0), _target)):
        machine = machine.then(Transducer.of(start, step, machine.outputs()))
    return machine


GRAMMAR = _grammar()


@dataclass
class Model:
    """Weights of words and stems (a stem ends in ``*``), and the logistic function (bias, strongest clause, all clauses)."""
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    logistic: tuple[float, float, float] = (-5.0, 1.5, 0.5)

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Scores texts by a model."""

    def __init__(self, model: Model):
        import ahocorasick
        self.logistic = model.logistic
        self.words = {w: v for w, v in model.weights.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in model.weights.items() if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.classes = {w: k for k, words in (("R", REPORT), ("N", NEGATION), ("T", TARGET), ("V", VOLITION), ("H", HARM)) for w in words}
        self.search = ahocorasick.Automaton()
        for w in (*self.words, *self.stems, *HARM):
            self.search.add_word(w, len(w))
        self.search.make_automaton()

    def classify(self, word: str) -> tuple[str, float]:
        """A word's class, and its weight if it is an insult; its own weight before that of its longest stem."""
        if word in self.words:
            return "I", self.words[word]
        for n in self.lengths:
            if (stem := word[:n]) in self.stems and len(word) > n:
                return "I", self.stems[stem]
        return self.classes.get(word, "-"), 0.0

    def clause(self, text: str) -> float:
        """The weight of a lower-cased clause."""
        state, total, last = GRAMMAR.start, 0.0, 0.0
        for word in _TOKEN.findall(text):
            kind, weight = self.classify(word)
            state, out = GRAMMAR.arcs[state, kind]
            scope = math.prod(FACTORS[f] for f in out[1:])
            if out[0] == "I":
                last = weight * scope
                total += last
            elif out[0] == "L":
                total += LATE_TARGET * last
            elif out[0] == "!":
                total += THREAT * scope
        return total

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses in which a word can match."""
        low = text.lower()
        starts = [end - n + 1 for end, n in self.search.iter(low)]
        starts = [a for a in starts if not a or not _LETTER.match(low[a - 1])]
        if not starts:
            return []
        cuts = [m.end() for m in _CLAUSE.finditer(low)]
        bounds = [0, *cuts, len(low)]
        found = sorted({bisect_right(bounds, a, hi=len(bounds) - 1) - 1 for a in starts})
        return [w for i in found if (w := self.clause(low[bounds[i]:bounds[i + 1]])) > 0]

    def features(self, text: str) -> tuple[float, float]:
        """The strongest clause, and the logarithm of all."""
        found = self.clauses(text)
        return max(found, default=0.0), math.log1p(sum(found))

    def score(self, text: str) -> float:
        one, every = self.features(text)
        b, u, v = self.logistic
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, b + u * one + v * every))))


def candidates(text: str) -> set[str]:
    """The words of a text, and the stems (with ``*``) of those that are longer."""
    words = set(_LETTER_RUN.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


_LETTER_RUN = re.compile(r"[^\W\d_]{2,}")


def _sampled(docs: DataFrame, labels: DataFrame, learn_from: Column, size: int) -> DataFrame:
    """(text, toxic) of at most `size` labelled rows, distinct texts. The ids have a proven bound, so they are broadcast."""
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(learn_from)
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(size))
    texts = ids_and_texts(docs)
    return checkpoint(texts.join(F.broadcast(marked), texts["doc_id"] == marked["id"]).groupBy("text").agg(F.max("toxic").alias("toxic")))


def _present(known: list[str] | None = None):
    """Per text and candidate (of `known`, if given) a row; counted per batch where texts needn't be told apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else frozenset(known)
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                own = candidates(text)
                found.update(own if wanted is None else own & wanted)
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
    return run


def _incidence(known: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(known)}
        for batch in batches:
            rows = [[place[w] for w in candidates(t) if w in place] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32()))], names=["held"])
    return run


def _surprise(hits: np.ndarray, of: np.ndarray, share: float) -> np.ndarray:
    """Minus the logarithm of a bound on the chance of so many hits, were each row toxic by the overall share (Chernoff)."""
    q = np.clip(hits / np.maximum(of, 1), 1e-9, 1 - 1e-9)
    return np.where(q > share, of * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share))), 0.0)


def _cover(words: list[str], clean: np.ndarray, rows: list[list[int]], n_clean: int, tested: int) -> dict[str, float]:
    """Words and stems, with their log odds, that together tell the toxic rows.

    First by sequential covering: the most telling one, then the most telling
    for the rows it leaves. Then whatever stands in RATHER of the toxic rows
    without a word or stem of its own family among the chosen. Of equal ones
    the most specific is taken.
    """
    n_toxic, held = len(rows), [set() for _ in words]
    for r, row in enumerate(rows):
        for w in row:
            held[w].add(r)
    share, least = n_toxic / (n_toxic + n_clean), math.log(max(tested, 1) / 0.05)
    specific = np.array([len(w) - 1.5 * w.endswith("*") for w in words], float) * 1e-6
    hits, open_rows, chosen = np.array([len(h) for h in held], float), set(range(n_toxic)), []
    while len(words):
        worth = _surprise(hits, hits + clean, share) + specific
        best = int(np.argmax(worth))
        if worth[best] < least:
            break
        chosen.append(best)
        for r in held[best] & open_rows:
            for w in rows[r]:
                hits[w] -= 1
        open_rows -= held[best]
        hits[best] = 0

    stem = lambda i: words[i].rstrip("*")
    for i in sorted(range(len(words)), key=lambda i: (-len(held[i]), -specific[i])):
        kin = [held[j] for j in chosen if stem(i).startswith(stem(j)) or stem(j).startswith(stem(i))]
        if len(held[i].difference(*kin)) >= max(6, RATHER * n_toxic) and clean[i] <= 0.02 * len(held[i]):
            chosen.append(i)
    return {words[i]: math.log((len(held[i]) + 0.5) / (n_toxic + 1)) - math.log((clean[i] + 0.5) / (n_clean + 1)) for i in chosen}


def _fit_logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, float, float]) -> tuple[float, float, float]:
    """MAP estimate around a prior, by Newton steps; slopes stay positive."""
    a = np.column_stack([np.ones(len(x)), x])
    mean, precision = np.array(prior), np.array([0.05, 1.0, 1.0])
    w = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + precision * (w - mean)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(precision)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 2.0 / np.abs(step).max()) if np.abs(step).max() > 0 else 0
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, size: int = SAMPLE) -> Model:
    """A model from `labels` (doc_id, toxic) of `docs` (doc_id, text).

    `learn_from` is a condition on labels' doc_id. Only whole texts and their
    labels are looked at. Of several labels of one id, or of one text, toxic
    wins; null ids and null labels are left out. Without toxic or without
    clean rows the built-in words keep their built-in weight.
    """
    sample = _sampled(docs, labels, F.lit(True) if learn_from is None else learn_from, size)
    toxic, clean = sample.where("toxic = 1").select("text"), sample.where("toxic <> 1").select("text")
    n_toxic, n_clean = toxic.count(), clean.count()
    model = Model()
    if not n_toxic or not n_clean:
        return model
    schema = "word string, n long"
    held = (toxic.mapInArrow(_present(), schema).groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3")
            .orderBy(F.desc("n"), "word").limit(CANDIDATES).collect())
    words, hits = [r["word"] for r in held], np.array([r["n"] for r in held], float)
    if words:
        seen = dict(clean.mapInArrow(_present(words), schema).groupBy("word").agg(F.sum("n")).collect())
        against = np.array([seen.get(w, 0) for w in words], float)
        share = n_toxic / (n_toxic + n_clean)
        telling = np.flatnonzero((_surprise(hits, hits + against, share) >= math.log(len(words) / 0.05)) & (hits / (hits + against) >= PRECISE))
        known = [words[i] for i in telling]
        rows = [r["held"] for r in toxic.mapInArrow(_incidence(known), "held array<int>").collect()]
        model.weights |= _cover(known, against[telling], rows, n_clean, len(words))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            one, every = zip(*map(reader.features, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.record_batch([pa.array(one, pa.float64()), pa.array(every, pa.float64()), batch.column("toxic")], names=["one", "every", "toxic"])
    table = np.array([tuple(r) for r in sample.mapInArrow(weigh, "one double, every double, toxic int").collect()], float)
    model.logistic = _fit_logistic(table[:, :2], (table[:, 2] == 1).astype(float), model.logistic)
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row per row of `docs`.

    Null and empty texts have the score of a text without a match, below
    THRESHOLD; null ids stay null; repeated rows stay repeated; other columns
    don't matter.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            found = np.array([reader.score(t) for t in batch.column("text").to_pylist()], float)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])
    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            yield batch.filter(pa.array([reader.score(t or "") < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))
    return docs.mapInArrow(lean(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows not learned from: crc32 of the id's digits leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    return scores(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
