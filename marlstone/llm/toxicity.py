"""Toxicity: Levenshtein automata over a lexicon trie find terms and their misspellings; windows around them tell quotation from abuse."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHasher, mixed, remainder, removed, shared_folder, slices, table, written

WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
# Words that report speech, and words that address someone.
REPORTING = frozenset("said says say called calls wrote writes word words term quote quoted quotes insult insults slur slurs meaning reported phrase".split())
ADDRESSING = frozenset("you your youre he she they are is such these those".split())
LEAST_WEIGHT = 1.0  # of a match that says something
STEMS = (4, 5, 6)  # lengths of beginnings that can stand for all their words
OPENING, CLOSING = "\"“«„", "\"”»“"


@dataclass
class Term:
    """A word of the lexicon, or the beginning of words (stem); weights are log odds for a whole match and for a misspelling."""

    text: str
    weight: float
    stem: bool = False
    misspelt: float = 0.0

    @property
    def errors(self) -> int:
        return 0 if self.stem or len(self.text) < 5 else 1 if len(self.text) < 9 else 2


class _Node:
    __slots__ = ("children", "term", "stem", "errors")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.term = self.stem = None
        self.errors = 0  # the most that a term below allows


class _State(dict):
    """A set of (trie node, errors so far), made into one state of a deterministic automaton when a word first reaches it."""

    __slots__ = ("nodes", "stem", "found", "automaton")

    def __missing__(self, char: str) -> _State:
        if char not in self.automaton.alphabet and char != "":
            to = self[char] = self[""]
        else:
            to = self[char] = self.automaton.step(self, char)
        return to


class LexiconAutomaton:
    """The trie of all terms, read with up to each term's number of insertions, deletions and substitutions at once."""

    STATES = 100_000

    def __init__(self, terms: list[Term]):
        self.terms, self.root = terms, _Node()
        for i, term in enumerate(terms):
            node = self.root
            node.errors = max(node.errors, term.errors)
            for char in term.text:
                node = node.children.setdefault(char, _Node())
                node.errors = max(node.errors, term.errors)
            if term.stem:
                node.stem = i
            else:
                node.term = i
        self.alphabet = {c for t in terms for c in t.text}
        self.restart()

    def restart(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state({self.root: 0}, None)

    def _state(self, nodes: dict[_Node, int], stem: int | None) -> _State:
        todo = list(nodes.items())
        while todo:  # deletions
            node, e = todo.pop()
            for child in node.children.values():
                if e < child.errors and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in nodes.items():
            if node.stem is not None and e == 0:
                stem = node.stem
        key = (frozenset(nodes.items()), stem)
        if (state := self.states.get(key)) is None:
            state = self.states[key] = _State()
            state.nodes, state.stem, state.automaton = nodes, stem, self
            found = [(self._weight(node.term, e), node.term, e) for node, e in nodes.items() if node.term is not None and e <= self.terms[node.term].errors]
            state.found = max([*(f for f in found if f[0] >= LEAST_WEIGHT), *([(self.terms[stem].weight, stem, 0)] if stem is not None else [])], default=None)
        return state

    def _weight(self, term: int, errors: int) -> float:
        return self.terms[term].misspelt if errors else self.terms[term].weight

    def step(self, state: _State, char: str) -> _State:
        nodes: dict[_Node, int] = {}
        for node, e in state.nodes.items():
            for own, child in node.children.items():
                cost = e + (own != char)
                if cost <= (child.errors if cost else 9) and cost < nodes.get(child, 9):
                    nodes[child] = cost
            if e < node.errors and e + 1 < nodes.get(node, 9):
                nodes[node] = e + 1
        return self._state(nodes, state.stem)

    def find(self, word: str) -> tuple[float, int, int] | None:
        """(weight, term, errors) of the heaviest term that the word is, or is a misspelling of."""
        if len(self.states) > self.STATES:
            self.restart()
        state = self.start
        for char in word:
            state = state[char]
            if not state.nodes and state.stem is None:
                return None
        return state.found


@dataclass
class ToxicityModel:
    """What fit() learns: a lexicon and the logistic curve from a document's evidence to its score."""

    terms: list[Term] = field(default_factory=list)
    intercept: float = -math.inf
    slope: float = 0.0

    def score(self, evidence: float) -> float:
        x = self.intercept + self.slope * evidence
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class Scorer:
    """Evidence in texts: each different word counts once, by its heaviest term and the window in which it is meant most."""

    REMEMBERED, WINDOW = 150_000, 8

    def __init__(self, model: ToxicityModel):
        self.automaton = LexiconAutomaton(model.terms)
        self.clean: set[str] = set()
        self.flagged: dict[str, tuple[float, int, int]] = {}

    def evidence(self, text: str) -> float:
        text = text.lower()
        words = set(WORD.findall(text))
        new = words - self.clean
        if not new:
            return 0.0
        for word in new - self.flagged.keys():
            if found := self.automaton.find(word):
                self.flagged[word] = found
            else:
                self.clean.add(word)
        hits = words & self.flagged.keys()
        if len(self.clean) + len(self.flagged) > self.REMEMBERED:
            flagged = {w: self.flagged[w] for w in hits}
            self.clean, self.flagged = set(), flagged
        return self._weighed(text, hits) if hits else 0.0

    def _weighed(self, text: str, hits: set[str]) -> float:
        spans = [(m[0], m.start(), m.end()) for m in WORD.finditer(text)]
        best: dict[str, float] = {}
        for i, (word, start, end) in enumerate(spans):
            if word in hits:
                weight = self.flagged[word][0]
                near = [w for w, _, _ in spans[max(0, i - self.WINDOW) : i + self.WINDOW + 1]]
                before, after = text[spans[max(0, i - self.WINDOW)][1] : start], text[end : spans[min(len(spans) - 1, i + self.WINDOW)][2]]
                best[word] = max(best.get(word, 0.0), weight * context(before, after, near))
        return math.fsum(best.values())


def context(before: str, after: str, near: list[str]) -> float:
    """How far a term between these two texts is meant: less inside quotation marks and after words that report, more beside words that address someone."""
    quoted = any(before.rfind(a) > max(before.rfind(b) if a != b else -1, before.rfind("\n")) and before.count(a) % (2 if a == b else 1e9) and b in after for a, b in zip(OPENING, CLOSING, strict=True))
    reported = not REPORTING.isdisjoint(near)
    if quoted:
        return 0.3 if reported else 0.6
    return 0.8 if reported else 1.1 if not ADDRESSING.isdisjoint(near) else 1.0


def _fitting_rows(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of the documents of at most max_rows labels, those with the smallest hashes of their ids; one of each family of copies."""
    chosen = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = texts.join(F.broadcast(chosen), "__id")  # at most max_rows ids
    rows = rows.mapInArrow(_sketches, "__id long, __text string, __toxic int, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(m, "__toxic").orderBy("__id", "__text"))).where("n = 1")
    return rows.select("__text", "__toxic")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds three smallest hashes of four-word shingles: copies of a text agree in most of them, so that what a family of copies says counts about once."""
    hasher = WordHasher()
    for part, texts in slices(batches, "__text", 1 << 20):
        words, begins = hasher(texts)
        chains = mixed(words + np.uint64(3) * np.roll(words, -1) + np.uint64(5) * np.roll(words, -2) + np.uint64(7) * np.roll(words, -3))
        least = [pa.array([int(h[a : max(a + 1, b - 3)].min()) if a < b else 0 for a, b in zip(begins, begins[1:])], pa.int64()) for k in (1, 2, 3) for h in [(mixed(chains * np.uint64(2 * k + 1)) >> np.uint64(1)).astype(np.int64)]]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("__id", "__text", "__toxic")), *least], names=["__id", "__text", "__toxic", "m0", "m1", "m2"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either label each word is; parts of the sums, as memory allows."""
    counts = Counter(), Counter()

    def flushed():
        words = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "clean", "toxic"])
        counts[0].clear()
        counts[1].clear()
        return batch

    for part, texts in slices(batches, "__text", 1 << 20):
        for text, toxic in zip(texts, part.column("__toxic").to_pylist(), strict=True):
            counts[bool(toxic)].update(set(WORD.findall(text.decode().lower())))
        if len(counts[0]) + len(counts[1]) > 400_000:
            yield flushed()
    yield flushed()


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from the documents of at most max_rows labelled ids, of those where usable holds; labels of unknown documents, null ones and null ids teach nothing. Without labels all scores are 0.

    A word enters the lexicon if its share of toxic texts is beyond what chance gives any of the counted words. The beginning of at least five words enters as a stem if that holds for these words without the most toxic one; it then stands for them.
    A term's misspellings weigh by the labels of the near words that the sample has, or by 0.8 of the term if it has none.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = written(_fitting_rows(docs, labels, usable, max_rows, id_col, text_col, label_col), f"{folder}/rows")
    totals = rows.groupBy("__toxic").count().collect()
    n_toxic, n_clean = (sum(r["count"] for r in totals if bool(r["__toxic"]) == y) for y in (True, False))
    if not n_toxic or not n_clean:
        return ToxicityModel()
    words = written(rows.mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), f"{folder}/words")
    base, beyond = n_toxic / (n_toxic + n_clean), math.log(words.count() + 1) + math.log(100)
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    share = (F.col("toxic") + 0.01) / (F.col("toxic") + F.col("clean") + 0.02)
    gain = F.col("toxic") * F.log(share / base) + F.col("clean") * F.log((1 - share) / (1 - base))
    marked = (share > max(0.5, 2 * base)) & (gain > beyond)
    parts = words.where(F.length("word") > 4).select(F.struct("toxic", "clean").alias("own"), F.explode(F.array_distinct(F.array(*(F.substring("word", 1, n) for n in STEMS)))).alias("text"))
    stems = parts.groupBy("text").agg(F.sum("own.toxic").alias("toxic"), F.sum("own.clean").alias("clean"), F.max("own").alias("most"), F.count("*").alias("words")).where("words >= 5")
    stems = stems.withColumn("toxic", F.col("toxic") - F.col("most.toxic")).withColumn("clean", F.col("clean") - F.col("most.clean"))
    stems = stems.where(marked).select("text", "toxic", "clean", weight.alias("weight"), F.lit(True).alias("stem"), gain.alias("gain"))
    exact = words.where(marked).select(F.col("word").alias("text"), "toxic", "clean", weight.alias("weight"), F.lit(False).alias("stem"), gain.alias("gain"))
    top = stems.union(exact).collect()  # of the words of max_rows texts, those that chance does not explain
    kept = _apart({r.text: (r.toxic, r.clean, r.weight) for r in top if r.stem}, base, beyond)
    found = [*((s, w, True) for s, w in sorted(kept.items())), *((r.text, r.weight, False) for r in top if not r.stem and not any(r.text[:n] in kept for n in STEMS))]
    terms = [Term(text, min(w, 8.0), stem, 0.8 * min(w, 8.0)) for text, w, stem in found]
    near: dict[int, list[int]] = {}
    for r in words.mapInArrow(_near_words(terms), "term int, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():
        near[r.term] = [r.clean, r.toxic]
    for i, (clean, toxic) in near.items():
        terms[i].misspelt = min(max(math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)), 0.0), terms[i].weight)
    model = ToxicityModel(terms)
    seen = rows.mapInArrow(_evidence(model), "evidence double, toxic int").collect()  # at most max_rows
    model.intercept, model.slope = _logistic(np.array([r.evidence for r in seen]), np.array([float(r.toxic > 0) for r in seen]))
    removed(spark, folder)
    return model


def _near_words(terms: list[Term]):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton([Term(t.text, t.weight, t.stem, t.weight) for t in terms])
        for batch in batches:
            found = [(f[1], c, t) for w, c, t in zip(*(batch.column(n).to_pylist() for n in ("word", "clean", "toxic")), strict=True) if (f := automaton.find(w)) and f[2]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["term", "clean", "toxic"])

    return near


def _evidence(model: ToxicityModel):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part, texts in slices(batches, "__text", 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.evidence(t.decode()) for t in texts], pa.float64()), part.column("__toxic")], names=["evidence", "toxic"])

    return evidence


def _apart(stems: dict[str, tuple[int, int, float]], base: float, beyond: float) -> dict[str, float]:
    """Weights of the stems to use, of (toxic, clean, weight): a shorter one takes the place of longer ones where it says as much; else it must hold without them."""
    used: dict[str, float] = {}
    for stem in sorted(stems, key=lambda s: (-len(s), s)):
        toxic, clean, weight = stems[stem]
        longer = [s for s in used if s.startswith(stem)]
        if longer and weight < max(used[s] for s in longer) - 0.5:
            toxic, clean = (n - sum(stems[s][i] for s in longer) for i, n in enumerate((toxic, clean)))
            share = (toxic + 0.01) / (toxic + clean + 0.02)
            if share > 0.5 and toxic * math.log(share / base) + clean * math.log((1 - share) / (1 - base)) > beyond:
                used[stem] = weight
        else:
            for s in longer:
                del used[s]
            used[stem] = weight
    return used


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> tuple[float, float]:
    """Intercept and slope of the likeliest curve, the slope held back a little so that separable data give finite values. Newton steps are halved until they help, so they don't overshoot."""
    inputs, beta = np.stack([np.ones_like(x), x], 1), np.array([-3.0, 0.5])
    hold = np.array([1e-3, penalty])

    def loss(b: np.ndarray) -> float:
        z = inputs @ b
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (hold * b * b).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(inputs @ beta, -40, 40)))
        gradient = inputs.T @ (y - p) - hold * beta
        step = np.linalg.solve(inputs.T @ (inputs * (p * (1 - p))[:, None]) + np.diag(hold), gradient)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each document; only its text counts. Null and empty texts have no evidence. Repeated rows and null ids are kept, other columns dropped; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms of at most max_rows texts

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part, texts in slices(batches, "__text", 1 << 20):
            scores = [sent.value.score(scorer.evidence(t.decode())) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[id_col, "score", "predicted"])

    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return named.mapInArrow(scored, f"`{id_col}` {named.schema['__id'].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below the threshold. Null and empty texts have no evidence, long ones are read whole; repeated rows go or stay alike; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part, texts in slices(batches, text_col, 1 << 20):
            yield part.filter(pa.array([sent.value.score(scorer.evidence(t.decode())) < threshold for t in texts]))

    return docs.mapInArrow(kept, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    scores = score(docs, model)
    return scores.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
