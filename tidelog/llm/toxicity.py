"""Toxicity: Levenshtein automata intersected with a learned lexicon trie, weighed by the context of each hit.

The lexicon is learned from labelled texts: words, and stems (word beginnings), that occur in toxic texts and hardly in others.
Every word of a text is looked up in a trie of these entries by an automaton that accepts strings within one edit; a stem
accepts any ending, after itself or after what is within one edit of it.  Each hit is scored in a window of words around it: inside quotation marks, after a word that introduces
speech, or plain.  A logistic model over the hits of a text gives its score.  Labels are used only to learn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

# Labelled texts used to learn, half of each class where there are enough.
SAMPLE = 20_000
# Largest number of words, and of stems, in the lexicon.
ENTRIES = 2_000
# Toxic texts that must hold an entry: this many, and one in a hundred.
MIN_TEXTS = 5
MIN_ODDS = 40.0
# Lengths of stems, and the different words of toxic texts that a stem must begin.
STEMS = (4, 5, 6, 7, 8)
FAMILY = 4
FUZZY_FROM = 5
WINDOW = 12
CACHED_WORDS = 400_000
# Letters that stand in for others, signs that open or close a quotation, words that introduce speech.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
QUOTES = "\"“”„«»‹›"
SPEECH = frozenset("said says wrote writes quote quoted quoting called reported schrieb sagte zitat dit écrit citation dijo escribió cita".split())
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}@$]+|[" + QUOTES + "]")


@dataclass
class Trie:
    """Lexicon entries by letter; ``word`` and ``stem`` hold the weight of an entry that ends here."""

    next: dict[str, Trie] = field(default_factory=dict)
    word: float | None = None
    stem: float | None = None

    @classmethod
    def of(cls, words: dict[str, float], stems: dict[str, float]) -> Trie:
        root = cls()
        for entries, slot in ((words, "word"), (stems, "stem")):
            for entry, weight in entries.items():
                node = root
                for letter in entry:
                    node = node.next.setdefault(letter, cls())
                setattr(node, slot, weight)
        return root


class Automaton:
    """Accepts the strings within one edit of ``word``; a state is a pair of bit sets: letters read with 0 and with 1 edit."""

    def __init__(self, word: str):
        self.size = len(word)
        self.masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            self.masks[letter] = self.masks.get(letter, 0) | 1 << i
        self.start = (1, 0b11 if word else 1)

    def step(self, state: tuple[int, int], letter: str) -> tuple[int, int]:
        none, one = state
        mask = self.masks.get(letter, 0)
        same = (none & mask) << 1
        # One edit: a match after it, an added letter, an exchanged letter, or a left-out letter after a match.
        edit = ((one & mask) << 1) | none | (none << 1) | (same << 1)
        return same, edit & ((2 << self.size) - 1)

    def edits(self, state: tuple[int, int]) -> int | None:
        end = 1 << self.size
        return 0 if state[0] & end else 1 if state[1] & end else None


def lookup(trie: Trie, word: str) -> tuple[str, float] | None:
    """Best entry for a word: ``("word" | "stem" | "fuzzy" | "near", weight)``, ``near`` being a misspelled stem with any ending."""
    node, stem = trie, None
    for letter in word:
        node = node.next.get(letter)
        if node is None:
            break
        if node.stem is not None:
            stem = node.stem
    else:
        if node.word is not None:
            return "word", node.word
    if stem is not None:
        return "stem", stem
    if len(word) < FUZZY_FROM - 1:
        return None
    automaton = Automaton(word)
    best = near = None
    todo = [(trie, automaton.start, 0)]
    while todo:
        node, state, depth = todo.pop()
        if node.word is not None and depth >= FUZZY_FROM and automaton.edits(state) is not None and (best is None or node.word > best):
            best = node.word
        # A state that is alive has read a beginning of the word with one edit at most.
        if node.stem is not None and depth >= FUZZY_FROM and (near is None or node.stem > near):
            near = node.stem
        for letter, child in node.next.items():
            after = automaton.step(state, letter)
            if after[0] | after[1]:
                todo.append((child, after, depth + 1))
    return ("fuzzy", best) if best is not None else ("near", near) if near is not None else None


def _shortened(word: str) -> set[str]:
    """The word and what is left of it without one letter."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


_KINDS = ("word", "stem", "fuzzy", "near")
FEATURES = ("plain_word", "plain_stem", "plain_fuzzy", "plain_near", "quoted", "reported", "share")


class Scorer:
    """Features of a text: log-damped weights of its hits by kind and context, and the share of words that hit."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.trie = Trie.of(words, stems)
        # Within one edit of an entry a word keeps the entry's first or last half in place.
        self.heads = {w[: len(w) // 2] for w in words if len(w) >= FUZZY_FROM}
        self.tails = {w[-(len(w) // 2) :] for w in words if len(w) >= FUZZY_FROM}
        self.head_sizes, self.tail_sizes = ({len(x) for x in y} for y in (self.heads, self.tails))
        self.exact = set(words) | set(stems)
        self.stem_sizes = {len(s) for s in stems}
        # Two strings within one edit have a shortening in common; this spares most words the walk.
        long = [s for s in stems if len(s) >= FUZZY_FROM]
        self.near = {x for s in long for x in _shortened(s)}
        self.near_sizes = sorted({n for s in long for n in (len(s) - 1, len(s), len(s) + 1)})
        self.known: dict[str, tuple[str, float] | None] = {}

    def match(self, token: str) -> tuple[str, float] | None:
        if token in self.known:
            return self.known[token]
        # A sign at the end may be a letter or decoration: the token is tried with and without it.
        bare = token.rstrip("$@")
        found = self._found(token.translate(LOOKALIKE))
        if bare and bare != token and (other := self._found(bare.translate(LOOKALIKE))) is not None and (found is None or _KINDS.index(other[0]) < _KINDS.index(found[0])):
            found = other
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        self.known[token] = found
        return found

    def _found(self, word: str) -> tuple[str, float] | None:
        near = any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes) or any(word[:n] in self.exact for n in self.stem_sizes)
        if near or word in self.exact or any(not self.near.isdisjoint(_shortened(word[:n])) for n in self.near_sizes if n <= len(word)):
            return lookup(self.trie, word)
        return None

    def features(self, text: str | None) -> list[float]:
        tokens = _TOKEN.findall((text or "").lower())
        # Matches are kept here: the cache may be emptied in the middle of a text.
        hits = [(i, found) for i, t in enumerate(tokens) if (found := self.match(t)) is not None]
        sums = dict.fromkeys(FEATURES, 0.0)
        for i, (kind, weight) in hits:
            sums[self._context(tokens, i) or f"plain_{kind}"] += weight
        out = [math.log1p(sums[f]) for f in FEATURES[:-1]]
        return [*out, 100.0 * len(hits) / max(1, len(tokens))]

    @staticmethod
    def _context(tokens: list[str], at: int) -> str | None:
        before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
        opened = next((t for t in reversed(before) if t in QUOTES), None)
        if opened is not None and any(t in QUOTES for t in after) and sum(t in QUOTES for t in before) % 2:
            return "quoted"
        return "reported" if any(t in SPEECH for t in before[-4:]) else None


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton steps on a lightly penalised logistic likelihood."""
    full = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(full.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ beta, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty, full.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return beta[:-1], float(beta[-1])


def _odds(counts: DataFrame, toxic: int, clean: int, family: int = 1) -> dict[str, float]:
    """Log odds of the entries of ``counts (term, t, c, words)`` that mark toxic texts: at most ``ENTRIES`` rows."""
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    good = (F.col("t") >= max(MIN_TEXTS, toxic // 100)) & (F.col("odds") >= MIN_ODDS) & (F.col("words") >= family)
    rows = counts.withColumn("odds", ratio).filter(good).orderBy(F.desc("odds"), "term").limit(ENTRIES).collect()
    return {r["term"]: math.log(r["odds"]) for r in rows}


def _featured(scorer_of, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, model = scorer_of()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = np.array([scorer.features(t.as_py()) for t in part.column(columns)]).reshape(-1, len(FEATURES))
                kept = [part.column(i) for i in range(columns)]
                if model is None:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(rows.tolist(), pa.list_(pa.float64()))], [*part.schema.names[:columns], "features"])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(rows))], [*part.schema.names[:columns], "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from at most ``sample`` labelled rows of ``labels (doc_id, toxic)``, chosen by a hash of the id."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = labels.filter("toxic = 1").orderBy(order).limit(sample // 2).unionByName(labels.filter("toxic = 0").orderBy(order).limit(sample // 2))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").select("toxic", "text").filter(F.col("text").isNotNull())
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, {}, np.zeros(len(FEATURES)), -3.0 if not toxic else 0.0)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"), lambda w: F.length(w) >= 3)
    counts = texts.select("toxic", F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = Scratch(docs.sparkSession).cut(counts.filter("t > 0 OR length(term) > 3"), "terms")
    lexicon = _odds(counts.withColumn("words", F.lit(1)), toxic, clean)
    stems: dict[str, float] = {}
    for size in STEMS:
        longer = counts.filter(F.length("term") > size).groupBy(F.substring("term", 1, size).alias("term"))
        found = _odds(longer.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.when(F.col("t") > 0, 1).otherwise(0)).alias("words")), toxic, clean, FAMILY)
        stems |= {s: w for s, w in found.items() if not any(s[:n] in stems for n in STEMS if n < size)}
    rows = texts.mapInArrow(_featured(lambda: (Scorer(lexicon, stems), None), 1), "toxic int, features array<double>").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    weights, bias = _logistic(x, y)
    return Model(lexicon, stems, weights, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    Rows with ``crc32(id as text) mod 3 = 1`` are held out: their labels teach nothing.  ``predicted`` is 1 from a score of
    0.7.  A null or empty text gets the score of a text without hits; a null id is not held out; repeated ids keep a row each;
    other columns are ignored.  Without labels of both classes nothing is learned and no text reaches 0.7.
    """
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs, labels.filter(third != 1), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_featured(lambda: (Scorer(shared.value.words, shared.value.stems), shared.value), 1), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
