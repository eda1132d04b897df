"""Toxicity: a learnt lexicon, met by Levenshtein automata intersected with its trie, weighed by context windows.

The lexicon comes from labelled rows: words, and stems with many endings, that toxic rows use far beyond chance in both
halves of them. Use is counted in distinct contexts (the neighbouring words), so that copies of one text count once. The
trie holds the terms; the automaton runs all terms' edit-distance automata over it at once and is made deterministic as
words ask for states. A misspelt hit counts like an exact one, divided by one more than the ordinary words (those of
clean rows) that are as close to its term; ordinary words themselves are no misspellings. Hits are scored by their
window: quotation marks around them and verbs of reporting lower a hit, second-person address raises it. A logistic
regression on these scores, whose weights can't be negative, gives the probability: no hit ever lowers it.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, release, sampled, trim

#: Labelled rows that are learnt from, at most about so many.
TRAIN_ROWS = 6_000
#: Characters that the sample has at most about, beside one text of any length.
TRAIN_CHARS = 60_000_000
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")
#: Stems have at least so many letters and endings.
STEM, ENDINGS = 4, 4
#: Share of a stem's uses that clean rows may have, against the toxic ones.
STEM_CLEAN = 0.3
#: Edits allowed in terms from so many letters on; stems have one at most.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words and characters on either side that a hit's window has.
NEAR_WORDS, NEAR_CHARS = 5, 60
#: What a hit without any cue counts; where the slope of the score over the hits' sum may change: after one such hit, after two.
PLAIN = 0.7
KNOTS = (0.0, PLAIN, 2 * PLAIN, 4.0)

# Cues of quotation and of address.
OPEN, CLOSE = "\"“„«‘‹'", "\"”“»’›'"
REPORTING = frozenset("said says wrote writes called quote quoted quotes term word slur sagte schrieb zitat wort nannte dit écrit cite mot appelé dijo escribió cita palabra llamó".split())
ADDRESS = frozenset("you your youre du dein dich ihr euch tu toi te ton vous tú ti eres usted".split())


@dataclass
class Automaton:
    """The lexicon's trie with lazily made states; a state is a set of (trie node, edits)."""

    words: frozenset[str]
    stems: frozenset[str]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[str, int, bool]] = field(default_factory=dict)

    def __post_init__(self):
        for stem, terms in ((False, self.words), (True, self.stems)):
            for term in sorted(terms):
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children.append({})
                        self.children[node][c] = len(self.children) - 1
                    node = self.children[node][c]
                edits = (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS and not stem)
                self.ends[node] = (term, edits, stem)
        self.most = max((x[1] for x in self.ends.values()), default=0)
        self._restart()

    def _restart(self):
        start = self._closed({(0, 0)})
        self.numbers, self.sets, self.steps = {start: 0}, [start], [{}]
        self.word_hits, self.stem_hits = [self._end(start, False)], [self._end(start, True)]

    def _closed(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of the term left out; of a node only the fewest edits."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e <= self.most and e < best.get(node, 99):
                best[node] = e
                todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _end(self, states: frozenset, stem: bool) -> tuple[str, int] | None:
        """(term, edits) of the best term of the kind that ends here."""
        hits = [(e, self.ends[n][0]) for n, e in states if n in self.ends and self.ends[n][2] == stem and e <= self.ends[n][1]]
        return min(hits)[::-1] if hits else None

    def _step(self, number: int, c: str) -> int:
        moved: set[tuple[int, int]] = set()
        for node, e in self.sets[number]:
            moved.add((node, e + 1))
            for letter, child in self.children[node].items():
                moved.add((child, e + (letter != c)))
        target = self._closed({x for x in moved if x[1] <= self.most})
        if not target:
            out = -1
        elif (out := self.numbers.get(target)) is None:
            out = self.numbers[target] = len(self.sets)
            self.sets.append(target)
            self.steps.append({})
            self.word_hits.append(self._end(target, False))
            self.stem_hits.append(self._end(target, True))
        self.steps[number][c] = out
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the match with the fewest edits: a stem that starts the word, or a term; stems win ties."""
        if len(self.sets) > 200_000:
            self._restart()
        state, stem = 0, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return stem
            hit = self.stem_hits[state]
            if hit and (stem is None or hit[1] < stem[1]):
                if not hit[1]:
                    return hit
                stem = hit
        hit = self.word_hits[state]
        return stem if hit is None or stem and stem[1] <= hit[1] else hit


def context(text: str, a: int, b: int) -> float:
    """From 0 (quotation) to 1 (abuse) for the hit text[a:b]."""
    before, after = text[max(0, a - NEAR_CHARS) : a], text[b : b + NEAR_CHARS]
    words = WORDS.findall(before.lower())[-NEAR_WORDS:], WORDS.findall(after.lower())[:NEAR_WORDS]
    opened = max((before.rfind(c) for c in OPEN), default=-1)
    # an apostrophe within a word is no quotation mark
    quoted = opened >= 0 and (opened == 0 or not before[opened - 1].isalpha()) and any((k := after.find(c)) >= 0 and not after[k + 1 : k + 2].isalpha() for c in CLOSE)
    score = PLAIN - 0.5 * quoted - 0.2 * bool(REPORTING.intersection(words[0])) + 0.3 * bool(ADDRESS.intersection(words[0] + words[1]))
    return min(1.0, max(0.0, score))


def _tail(k: int, n: int, p: float) -> float:
    """log P(at least k of n) for chance p, by its first term's bound."""
    first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)
    return min(0.0, first + log(1 / max(1e-9, 1 - (n - k) / (k + 1) * p / (1 - p))) if k + 1 > (n - k) * p / (1 - p) else 0.0)


def learn_lexicon(rows: list[tuple[str, int]]) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems of toxic rows: at least half of their uses are there, beyond chance at 1 % over all candidates,
    and both halves of the texts (by their crc32, so that copies are in one half) have some."""
    toxic: dict[str, set] = defaultdict(set)
    halves: dict[str, int] = defaultdict(int)
    n = [0, 0]

    def uses_of(text: str) -> list[tuple[str, int]]:
        """(word, context) of every use."""
        words = WORDS.findall(text.lower())
        return list(zip(words, map(hash, zip(["", *words], [*words[1:], ""], strict=False)), strict=False))

    for text, y in rows:
        if y:
            half = 1 << (zlib.crc32(text.encode("utf-8", "replace")) & 1)
            for w, c in uses_of(text):
                toxic[w].add(c)
                halves[w] |= half
                n[1] += 1
    # of clean rows only what toxic rows use often matters, and no more of it than decides
    uses, endings, stem_halves = defaultdict(int), defaultdict(set), defaultdict(int)
    for w, s in toxic.items():
        for k in range(STEM, min(len(w), 8) + 1):
            uses[w[:k]] += len(s)
            endings[w[:k]].add(w)
            stem_halves[w[:k]] |= halves[w]
    stems_wanted = {p for p, e in endings.items() if len(e) >= ENDINGS}
    clean: dict[str, set] = {w: set() for w, s in toxic.items() if len(s) >= 4}
    others: dict[str, int] = dict.fromkeys(stems_wanted, 0)
    for text, y in rows:
        if not y:
            for w, c in uses_of(text):
                n[0] += 1
                if (s := clean.get(w)) is not None and len(s) <= len(toxic[w]):
                    s.add(c)
                for k in range(STEM, min(len(w), 8) + 1):
                    if w[:k] in others:
                        others[w[:k]] += 1
    base = min(0.5, max(1e-6, n[1] / max(1, sum(n))))

    def strong(uses: dict[str, int], others: dict[str, int], halves: dict[str, int]) -> set[str]:
        some = [w for w, k in uses.items() if k >= 4]
        limit = log(0.01 / max(1, len(some)))
        return {w for w in some if halves[w] == 3 and uses[w] >= others.get(w, 0) and _tail(uses[w], uses[w] + others.get(w, 0), base) < limit}

    words = strong({w: len(s) for w, s in toxic.items()}, {w: len(s) for w, s in clean.items()}, halves)
    found = sorted(strong({p: uses[p] for p in stems_wanted}, others, stem_halves), key=len)
    stems: list[str] = []
    for p in found:
        # nearly all uses, with many endings, none of which is most of them
        if others.get(p, 0) <= STEM_CLEAN * uses[p] and max(len(toxic[w]) for w in endings[p]) <= 0.5 * uses[p] and not any(p.startswith(s) for s in stems):
            stems.append(p)
    return frozenset(w for w in words if not any(w.startswith(s) for s in stems) and len(w) >= 3), frozenset(stems)


class Scorer:
    """score(text): the probability of label 1."""

    def __init__(self, words: frozenset[str], stems: frozenset[str], clean: list[str] = ()):
        """clean: texts whose words are ordinary ones."""
        self.words, self.stems, self.weights = words, stems, np.zeros(2 * len(KNOTS) - 1)
        self.automaton, self.cache = Automaton(words, stems), {}
        close: dict[str, int] = defaultdict(int)
        ordinary = set()
        if words or stems:
            for w in sorted({w for text in clean for w in WORDS.findall(text.lower())}):
                hit = self.automaton.match(w)
                if hit and hit[1]:
                    ordinary.add(w)
                    close[hit[0]] += 1
        self.ordinary, self.close = frozenset(ordinary), dict(close)

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "cache": {}}

    def forget(self) -> None:
        """Drop what match() works out anew: the driver, which only learns, keeps a scorer as long as its plan."""
        self.automaton, self.cache = None, {}

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(term, edits, mass) of a word; a misspelling's mass is 1 / (1 + ordinary words as close to the term)."""
        if self.automaton is None:
            self.automaton = Automaton(self.words, self.stems)
        hit = self.automaton.match(word)
        if hit is None or hit[1] and word in self.ordinary:
            return None
        return *hit, 1 / (1 + self.close.get(hit[0], 0)) if hit[1] else 1.0

    def hits(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, term, edits, mass) of every hit in the whole text; the mass is weighed by the context."""
        low = text.lower()
        if len(low) != len(text):
            text = low
        cache, some = self.cache, set()
        if len(cache) > 100_000:
            cache.clear()
        for w in set(WORDS.findall(low)):
            if w not in cache:
                cache[w] = self.match(w)
            if cache[w]:
                some.add(w)
        if not some:
            return []
        return [(m.start(), m.end(), *(h := cache[m[0]])[:2], h[2] * context(text, m.start(), m.end())) for m in WORDS.finditer(low) if m[0] in some]

    def features(self, text: str | None) -> np.ndarray:
        mass = [0.0, 0.0]
        for _, _, term, _, c in self.hits(text) if text else []:
            mass[term in self.stems] += c
        return np.array([1.0, *(min(max(m - low, 0.0), high - low) for m in mass for low, high in zip(KNOTS, KNOTS[1:], strict=False))])

    def fit(self, rows: list[tuple[str, int]], rounds: int = 60, penalty: float = 0.05) -> None:
        """Newton's method with a small quadratic penalty; weights of hits that come out negative are held at 0."""
        x, y = np.stack([self.features(t) for t, _ in rows]), np.array([y for _, y in rows], float)
        free = np.ones(x.shape[1], bool)
        while True:
            w = np.zeros(int(free.sum()))
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(x[:, free] @ w, -30, 30)))
                step = np.linalg.solve(x[:, free].T @ (x[:, free] * (p * (1 - p))[:, None]) + penalty * np.eye(len(w)), x[:, free].T @ (y - p) - penalty * w)
                w += np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-6:
                    break
            self.weights = np.zeros(x.shape[1])
            self.weights[free] = w
            worst = 1 + int(self.weights[1:].argmin())
            if self.weights[worst] >= 0:
                break
            free[worst] = False
        self.weights[1:] = np.maximum(self.weights[1:], 0.0)

    def score(self, text: str | None) -> float:
        return 1 / (1 + exp(-float(np.clip(self.features(text) @ self.weights, -30, 30))))


def train(labelled: DataFrame, docs: DataFrame, bound: int = TRAIN_ROWS) -> Scorer:
    """labelled (doc_id, toxic), docs (doc_id, text). Without labels of both kinds every text has one score."""
    chosen = sampled(labelled.where("doc_id is not null and toxic in (0, 1)").dropDuplicates(["doc_id"]), "doc_id", bound, 23)
    # the sample has `bound` rows of two numbers, whatever the table's size
    rows = bounded(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "doc_id", "text", TRAIN_CHARS, 29).select("text", "toxic").collect()
    rows = sorted((t or "", int(y)) for t, y in rows)
    if not rows or len({y for _, y in rows}) < 2:
        scorer = Scorer(frozenset(), frozenset())
        share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1 or 1)
        scorer.weights[0] = log(share / (1 - share)) if rows else -3.0
        return scorer
    scorer = Scorer(*learn_lexicon(rows), [t for t, y in rows if not y])
    scorer.fit(rows)
    scorer.forget()
    rows.clear()
    trim()
    return scorer


def score_column(text: Column, scorer: Scorer) -> Column:
    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        out = pd.Series([scorer.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")
        release()
        return out

    return udf(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Learns from labelled rows whose id's crc32 modulo 3 isn't 1 (null ids are held out; of repeated labels one
    counts). Null and empty texts have the score of a text without hits. Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scorer = train(labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), rows, bound)
    found = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), scorer).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold, all columns as they are.

    Null and empty texts have the score of a text without hits and stay; repeated rows have one score; an empty table
    gives an empty one. Learns as scored() does."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scorer = train(labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), rows, bound)
    return docs.where(score_column(F.col(text_col), scorer) < threshold)
