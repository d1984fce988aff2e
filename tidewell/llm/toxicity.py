"""Toxicity scores: a lexicon learned from labels, matched with misspellings, weighed by context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import partitions, stage
from tidewell.llm.hashing import tidy

FOLDS = 5
# Bound of the labelled sample that the lexicon and the weights are fitted on. It bounds the lexicon
# too: support keeps at most some 300 times the words and stems of an average toxic row.
MAX_FIT_ROWS = 20_000
# Terms that a task counts before it hands them on; Spark adds up the parts.
FLUSH_TERMS = 100_000
MIN_DOCS = 4
STEM = (4, 8)
# A term must be at least this much likelier in toxic documents.
LIFT = 20.0
FUZZY_LENGTH = 5
# The edit spent in a state: none, any, any on the very last letter, or one that short terms admit too.
EXACT, ANY, LAST, NARROW = 0, 1, 2, 3
# Held instead of a letter: a stem is complete.
STEM_DONE = "*"
WINDOW = 8
FEATURES = ("abuse", "quoted", "density")

WORDS = re.compile(r"[^\W_]+")
# Words that report speech, and signs that open or close a quotation.
REPORTING = frozenset(
    "said says wrote writes called calls quoted quotes quote word term phrase insult slur told tweeted "
    "dit écrit mot cite citation sagte schrieb wort zitat dijo escribió palabra cita".split()
)
SIGNS = '"“”„«»'


class LexiconAutomaton:
    """The Levenshtein automata of all terms at once, run along their trie.

    A state is a set of (trie node, edits, held letter). Terms that end in ``*`` are stems: they
    accept any longer word. A term or stem of FUZZY_LENGTH letters or more also matches with one
    letter added, left out, changed, or swapped with the next; a shorter one with one letter
    doubled or swapped with the next, as any other edit makes it another word. A stem's last letter
    is neither left out nor changed: that would be the stem one letter shorter, which is a
    candidate of its own when terms are learned. States and moves are worked out when first met and kept, so a word costs
    one lookup per letter, and stops at the first letter that leads nowhere. Words in ``known``
    are words of their own and misspell nothing.
    """

    def __init__(self, weights: dict[str, float], known: frozenset[str] = frozenset()) -> None:
        self.known = known
        self.next: list[dict[str, int]] = [{}]
        self.letter = [""]  # that leads to the node
        self.fuzzy = [False]  # whether some long term lies below
        self.words: dict[int, float] = {}
        self.stems: dict[int, float] = {}
        self.long: set[int] = set()  # nodes at which a long term ends
        for term, weight in weights.items():
            text, node = term.rstrip("*"), 0
            long = len(text) >= FUZZY_LENGTH
            for letter in text:
                self.fuzzy[node] |= long
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.letter.append(letter)
                    self.fuzzy.append(False)
                node = self.next[node][letter]
            self.fuzzy[node] |= long
            if long:
                self.long.add(node)
            ends = self.stems if term.endswith("*") else self.words
            ends[node] = max(weight, ends.get(node, 0.0))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.values: list[float] = []
        self.exact: list[float] = []  # the values without edits
        self.start = self._state(self._closed({(0, EXACT, "")}))

    def _closed(self, items: set) -> frozenset:
        """Add what leaving out a letter of the term reaches, and the stems that are complete."""
        out = set(items)
        for node, edits, held in items:
            if edits == EXACT and not held and self.fuzzy[node]:
                out |= {(child, LAST, "") for child in self.next[node].values() if self.fuzzy[child]}
        for node, edits, held in list(out):
            if not held and node in self.stems and self._admits(node, edits) and edits != LAST:
                out.add((node, edits, STEM_DONE))
        return frozenset(out)

    def _admits(self, node: int, edits: int) -> bool:
        return edits in (EXACT, NARROW) or node in self.long

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            value = exact = 0.0
            for node, edits, held in items:
                if held == STEM_DONE:
                    end = self.stems[node]
                elif not held and self._admits(node, edits):
                    end = self.words.get(node, 0.0)
                else:
                    continue
                value = max(value, end * (1.0 if edits == EXACT else 0.8))
                exact = max(exact, end if edits == EXACT else 0.0)
            self.values.append(value)
            self.exact.append(exact)
        return self.states[items]

    def _move(self, state: int, letter: str) -> int:
        """The state behind a letter; -1 if nowhere."""
        out = set()
        for node, edits, held in self.sets[state]:
            if held == STEM_DONE:
                out.add((node, edits, held))
                continue
            below = self.next[node]
            if held:  # two swapped letters: the term's first one must come now
                if letter in below and held in self.next[below[letter]]:
                    out.add((self.next[below[letter]][held], NARROW, ""))
                continue
            child = below.get(letter)
            if child is not None and (edits in (EXACT, NARROW) or self.fuzzy[child]):
                out.add((child, ANY if edits == LAST else edits, ""))
            if edits != EXACT:
                continue
            if self.fuzzy[node]:
                out.add((node, ANY, ""))
                out |= {(c, LAST, "") for x, c in below.items() if x != letter and self.fuzzy[c]}
            if letter == self.letter[node]:
                out.add((node, NARROW, ""))
            if any(letter in self.next[c] for x, c in below.items() if x != letter):
                out.add((node, NARROW, letter))
        return self._state(self._closed(out)) if out else -1

    def weight(self, word: str) -> float:
        """The weight of the term that the word spells or misspells; 0 if none."""
        state = self.start
        for letter in word:
            moves = self.moves[state]
            number = moves.get(letter)
            if number is None:
                number = moves[letter] = self._move(state, letter)
            if number == -1:
                return 0.0
            state = number
        if self.values[state] and word in self.known:
            return self.exact[state]
        return self.values[state]


@dataclass
class Model:
    terms: dict[str, float]
    bias: float = -4.0
    weights: list[float] = field(default_factory=lambda: [3.0, 0.0, 0.0])
    automaton: LexiconAutomaton | None = None
    known: frozenset[str] = frozenset()

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weights of hits in abuse and in quotation, and of all hits for each hundred words.

        A hit counts as quoted by its context of WINDOW words: three quarters if it stands between
        quotation signs, half if a word of reporting is near.
        """
        if self.automaton is None:
            self.automaton = LexiconAutomaton(self.terms, self.known)
        if not text:
            return 0.0, 0.0, 0.0
        low = text.lower()
        words = WORDS.findall(low)
        weigh = self.automaton.weight
        values = list(map(weigh, words))
        if not any(values):
            return 0.0, 0.0, 0.0
        spans = None
        abuse = quoted = 0.0
        for k, value in enumerate(values):
            if value:
                spans = spans or [m.span() for m in WORDS.finditer(low)]
                a, b = max(0, k - WINDOW), min(len(words) - 1, k + WINDOW)
                before, after = low[spans[a][0] : spans[k][0]], low[spans[k][1] : spans[b][1] + 1]
                inside = sum(map(before.count, SIGNS)) % 2 and any(map(after.count, SIGNS))
                reported = any(w in REPORTING for w in words[a : b + 1])
                part = 0.75 * bool(inside) + 0.5 * reported
                part = min(part, 1.0)
                quoted += value * part
                abuse += value * (1 - part)
        return abuse, quoted, 100 * (abuse + quoted) / len(words)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.bias + _scaled(features) @ np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scaled(features: np.ndarray) -> np.ndarray:
    return np.log1p(np.asarray(features, float).reshape(-1, len(FEATURES)))


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(text, toxic) of at most MAX_FIT_ROWS labelled rows outside the held-out fold.

    The labels are chosen by a hash of the id, before the texts are read, and are therefore few
    enough to be sent to every task: documents are not shuffled. Of an id with several texts the
    last in order counts, so that texts are not more than labels.
    """
    chosen = (
        labels.filter((fold(F.col(id_column)) != 0) & F.col("toxic").isin(0, 1))
        .select(F.col(id_column).alias("_label_id"), F.col("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_label_id"), "_label_id", "_toxic")
        .limit(MAX_FIT_ROWS)
    )
    met = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_label_id")
    )
    # ids that repeat in documents would bring more rows than labels
    return met.groupBy("_label_id", F.col("_toxic").alias("toxic")).agg(F.max("text").alias("text")).select("text", "toxic")


def _candidates(text: str | None) -> set[str]:
    """Words of a text, and their beginnings as stems."""
    out = set()
    for word in set(WORDS.findall((text or "").lower())):
        out.add(word)
        out.update(f"{word[:n]}*" for n in range(STEM[0], min(STEM[1], len(word)) + 1))
    return out


def _learn_terms(rows: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    """Weights of terms, and the words like them that the clean rows use as words of their own."""

    def counted_so_far(seen: list[Counter]) -> pa.RecordBatch:
        terms = list(seen[1] | seen[0])
        columns = [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))]
        return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                seen[toxic.as_py()].update(_candidates(text.as_py()))
                if len(seen[0]) + len(seen[1]) >= FLUSH_TERMS:
                    yield counted_so_far(seen)
                    seen = [Counter(), Counter()]
        yield counted_so_far(seen)
        tidy()

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1:
        return {}, frozenset()
    counted = stage(
        rows.select("text", F.col("toxic").cast("int").alias("toxic"))
        .repartition(partitions(rows.sparkSession))
        .mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "toxic-terms",
    )
    lift = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    best = (
        counted.filter(F.col("toxic") >= max(MIN_DOCS, n1 // 250))
        .withColumn("lift", lift)
        .filter(F.col("lift") >= LIFT)
        .collect()
    )
    # a stem that covers a longer stem, misspelled ones too, makes it superfluous; words stay, as
    # they may be misspelled in ways that leave no such stem
    weights: dict[str, float] = {}
    for row in sorted(best, key=lambda r: (-r["toxic"], len(r["term"]), r["term"])):
        term = row["term"]
        text = term.rstrip("*")
        shortest = min(FUZZY_LENGTH, len(text))
        if term.endswith("*") and any(f"{text[:n]}*" in weights for n in range(shortest, len(text))):
            continue
        weights[term] = float(np.log(row["lift"]))
    # a word that is all there is to its own stem stands for it
    support = {r["term"]: r["toxic"] for r in best}
    below: dict[str, list[str]] = {}
    for word in (t for t in support if not t.endswith("*")):
        for n in range(STEM[0], min(STEM[1], len(word)) + 1):
            below.setdefault(f"{word[:n]}*", []).append(word)
    for stem in [t for t in weights if t.endswith("*")]:
        alone = [w for w in below.get(stem, ()) if support[w] >= 0.9 * support[stem]]
        if alone:
            weight = weights.pop(stem)
            weights.update({w: max(weight, weights[w]) for w in alone})
    top = max(weights.values(), default=1.0)
    terms = {t: w / top for t, w in weights.items()}

    def like_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            yield batch[[automaton.weight(t) > 0 for t in batch["term"]]]

    own = counted.filter(~F.col("term").endswith("*") & (F.col("clean") >= MIN_DOCS) & (lift < LIFT)).select("term")
    known = frozenset(r["term"] for r in own.mapInPandas(like_terms, "term string").collect())
    return terms, known


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learn terms and weights from labelled rows outside the held-out fold.

    Without toxic labels the model has no terms and scores every text low.
    """
    rows = stage(sample(docs, labels, id_column, text_column), "toxic-sample")
    terms, known = _learn_terms(rows)
    model = Model(terms, known=known)
    table = features(rows, model, "toxic").toPandas()  # numbers only, MAX_FIT_ROWS at most
    y = table["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return model
    x = np.column_stack([np.ones(len(y)), _scaled(table[list(FEATURES)].to_numpy())])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # ridge-penalised Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    # more abuse never lowers a score, and quoting never weighs more than abuse
    abuse, quoted, density = max(w[1], 0.5), w[2], max(w[3], 0.0)
    model.bias, model.weights = float(w[0]), [float(abuse), float(min(max(quoted, 0.0), 0.5 * abuse)), float(density)]
    model.automaton = None
    return model


def features(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    plain = Model(model.terms, model.bias, model.weights, known=model.known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([plain.features(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
            out = batch.drop(columns="text")
            for k, name in enumerate(FEATURES):
                out[name] = found[:, k]
            yield out
        tidy()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("text", *keep).mapInPandas(run, f"{kinds}, " + ", ".join(f"{f} double" for f in FEATURES))


def score_column(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1, as a column; null and empty texts get the score of no hit."""
    plain = Model(model.terms, model.bias, model.weights, known=model.known)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = [plain.features(None if t is None or t != t else t) for t in texts]
        scores = pd.Series(plain.scores(np.array(found).reshape(-1, len(FEATURES))))
        tidy()
        return scores

    return score(text)


def score(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its text alone.

    Labels serve only to fit the model, on at most MAX_FIT_ROWS rows outside the held-out fold.
    Null and empty texts score as texts without a hit; a null id is held out. Repeated rows stay;
    labels of ids that no document has, or other than 0 and 1, are ignored. Other columns of
    either table are ignored.
    """
    model = fit(docs, labels, id_column, text_column)
    scored = docs.select(
        F.col(id_column).alias("doc_id"),
        (fold(F.col(id_column)) == 0).alias("held_out"),
        score_column(model, F.col(text_column)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
