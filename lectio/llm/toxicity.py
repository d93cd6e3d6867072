"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import documents, texts, written

FOLDS = 5
#: Labelled training documents read to propose voters and features, and documents of any kind that the
#: classifier is trained on, by order of a hash of doc_id: bounds, which the driver's memory sets. Every
#: document is voted on and scored.
LABELLED_ROWS, TRAINING_ROWS = 6_000, 10_000
#: Units among the linear classifier's features at most: those that tell the classes apart best.
FEATURES = 2_000
#: A unit is a feature if chance explains its share among toxic rows with a probability under 0.001.
MIN_G2 = 10.8
#: Lengths of the prefixes that stand for a family of words, besides the word itself.
PREFIXES = (3, 4, 5, 6, 7)
#: A unit counts once at each of these numbers of distinct words that have it.
LEVELS = (1, 2, 4)
#: Terms and prefixes proposed as voters at most.
PROPOSED = 160
MIN_SUPPORT = 6
#: Voters that speak together more than this (correlation over all documents) are of one profile.
JOINED = 0.12
#: Profiles of toxic documents at most; the voters of smaller groups share the last one.
PROFILES = 12
#: Agreement tells nothing of a voter that never speaks with another: it is taken to be right this often, which
#: counts as much as this share of its votes.
LONE_PRECISION, LONE_BELIEF = 0.7, 0.2
#: Words whose units a task remembers at most; the memory is emptied when full and goes with the task.
REMEMBERED = 50_000

#: Insults by language: fixed values, a seed lexicon.
LEXICON = {
    "en": "asshole bastard bitch clown crap cretin disgusting dumb dumbass filth freak garbage idiot idiotic imbecile jerk loser lowlife moron moronic pathetic pig scum scumbag shit stupid trash ugly vermin worthless",
    "de": "abschaum arschloch bastard bescheuert blödmann depp dreckig dumm dummkopf ekelhaft erbärmlich hurensohn idiot idiotisch schwein scheiße trottel vollidiot wertlos widerlich",
    "fr": "abruti bâtard connard connasse crétin débile dégoûtant idiot idiote imbécile merde minable nul ordure pathétique pourri salaud salope stupide vermine",
    "es": "asqueroso basura bastardo cabrón cretino despreciable escoria estúpido gilipollas idiota imbécil inútil mierda miserable patético perdedor puta repugnante tonto",
}
#: Patterns over lower-cased text: fixed values.
PATTERNS = {
    "you_are": r"\b(?:you|they|he|she) (?:are|is) (?:an? |all |such |so )?(?:idiot|moron|loser|scum|trash|stupid|pathetic|worthless|disgusting)",
    "threat": r"\b(?:i(?: will|'ll)|we(?: will|'ll)) (?:kill|hurt|beat|destroy) (?:you|them|him|her)",
    "shut_up": r"\bshut (?:the \w+ )?up\b",
    "go_die": r"\bgo (?:to hell|die|kill yourself)\b",
    "slur_frame": r"\b(?:stupid|dumb|worthless|filthy|pathetic) (?:people|little|piece|excuse)\b",
}
#: A pattern is looked for where one of these words occurs.
TRIGGERS = {
    "you_are": {"are", "is"},
    "threat": {"kill", "hurt", "beat", "destroy"},
    "shut_up": {"shut"},
    "go_die": {"go"},
    "slur_frame": {"stupid", "dumb", "worthless", "filthy", "pathetic"},
}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_COMPILED = [(TRIGGERS[k], re.compile(v)) for k, v in PATTERNS.items()]


def held_out(doc_id) -> bool:
    return crc32(str(doc_id).encode()) % FOLDS == 0


def held_out_column(column: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("None"))), F.lit(FOLDS)) == 0


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def units_of(word: str) -> list[str]:
    """The word and its prefixes (marked)."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def levels_of(words: set[str]) -> set[tuple[str, int]]:
    """(unit, level reached) of a text's distinct words."""
    counts = Counter(u for w in words for u in units_of(w))
    return {(u, k) for u, n in counts.items() for k in LEVELS if n >= k}


# ---------------------------------------------------------------- voters


class UnitIndex:
    """Numbers of (unit, level) pairs, and which of them a text's distinct words reach."""

    def __init__(self, units: list[tuple[str, int]], first: int = 0):
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for i, (unit, level) in enumerate(units):
            self.levels.setdefault(unit, []).append((level, first + i))
        self.known: dict[str, tuple] = {}

    def _units(self, word: str) -> tuple:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[word] = tuple(u for u in units_of(word) if u in self.levels)
        return found

    def reached(self, words: set[str]) -> list[int]:
        counts = Counter([u for w in words for u in self._units(w)])
        return [i for u, n in counts.items() for level, i in self.levels[u] if n >= level]


class Voters:
    """Each voter says toxic (1) or abstains (0): a lexicon by language, a pattern, a proposed term or prefix."""

    def __init__(self, proposed: list[tuple[str, int]]):
        self.names = [f"lexicon_{k}" for k in LEXICON] + list(PATTERNS) + ["several", "dense"] + [f"{u}#{k}" for u, k in proposed]
        self.lexicon = [frozenset(v.split()) for v in LEXICON.values()]
        self.any_word = frozenset().union(*self.lexicon)
        self.proposed = UnitIndex(proposed, len(LEXICON) + len(PATTERNS) + 2)

    def votes(self, text: str, words: set[str]) -> list[int]:
        """Indices of the voters that say toxic."""
        return self.seed_votes(text, words) + self.proposed.reached(words)

    def seed_votes(self, text: str, words: set[str]) -> list[int]:
        """Those of the lexicon and the patterns alone."""
        strong = len(self.any_word & words)
        found = [i for i, terms in enumerate(self.lexicon) if not terms.isdisjoint(words)] if strong else []
        lower = None
        for i, (trigger, pattern) in enumerate(_COMPILED):
            if not trigger.isdisjoint(words):
                lower = text.lower() if lower is None else lower
                found += [len(self.lexicon) + i] * bool(pattern.search(lower))
        at = len(self.lexicon) + len(PATTERNS)
        found += [at] * (strong >= 2) + [at + 1] * (strong >= 1 and strong * 60 >= len(words))
        return found


def enriched(toxic: dict, clean: dict, positive: int, rows: int) -> list[tuple[float, float, tuple[str, int]]]:
    """(G statistic, lower bound of precision, unit with level) of what stands out in toxic rows, best first.

    ``toxic`` and ``clean`` count the rows of each kind that reach a unit, out of ``positive`` of ``rows``.
    """
    out = []
    for unit, n in toxic.items():
        other = clean.get(unit, 0)
        total = n + other
        if n / total > 2 * positive / rows:
            observed = np.array([n, other, positive - n, rows - positive - other], float)
            expected = np.array([total * positive, total * (rows - positive), (rows - total) * positive, (rows - total) * (rows - positive)]) / rows
            g2 = 2 * float((observed * np.log(np.where(observed > 0, observed, 1) / np.maximum(expected, 1e-9)))[observed > 0].sum())
            p = n / total
            out.append((g2, p - 1.64 * math.sqrt((p * (1 - p) + 0.25 / total) / total), unit))
    return sorted(out, reverse=True)


def propose(found: list[tuple[float, float, tuple[str, int]]], limit: int = PROPOSED) -> list[tuple[str, int]]:
    """Voters: enriched units of a precision over one half. Of a word, its prefixes and levels the best is taken."""
    taken: dict[str, tuple[str, int]] = {}
    heads: set[str] = set()
    for _, low, (unit, level) in found:
        stem = unit.rstrip("*")
        if low > 0.5 and stem not in heads and not any(stem[:n] in taken for n in range(1, len(stem) + 1)):
            taken[stem] = (unit, level)
            heads.update(stem[:n] for n in range(1, len(stem) + 1))
        if len(taken) == limit:
            break
    return list(taken.values())


# ---------------------------------------------------------------- label model


class LabelModel:
    """A latent class of clean documents and one per profile of toxic ones; no label is read.

    Accuracies are each voter's rate of speaking in every class. Correlations come from the moments of
    all documents (how often each voter and each pair of voters speak): voters that speak together
    form a profile, which is a class of its own, so that words of one language or kind are not taken
    for independent of each other; and where a pair still speaks together more often than all classes
    explain, both are discounted (by one plus the sum of these correlations). Rates, discounts and
    posteriors are estimated in turns, by expectation and maximisation over the votes of a sample.
    """

    def __init__(self, n: int):
        self.n = n

    def groups(self, once: np.ndarray, pairs: np.ndarray, total: int) -> tuple[np.ndarray, int]:
        """The profile (0, 1, ...) of each voter, and the last, of lone ones: connected parts of the graph of correlations over JOINED."""
        share = once / max(1, total)
        spread = np.sqrt(np.outer(share * (1 - share), share * (1 - share))) + 1e-12
        joined = (pairs / max(1, total) - np.outer(share, share)) / spread > JOINED
        label = np.arange(self.n)
        while True:
            new = np.minimum(label, np.where(joined, label[None, :], self.n).min(axis=1, initial=self.n))
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        sizes = Counter(label.tolist())
        large = [g for g, size in sizes.most_common() if size > 1][: PROFILES - 1]
        number = {g: k for k, g in enumerate(large)}
        return np.array([number.get(g, len(large)) for g in label.tolist()], int), len(large)

    def fit(self, votes: np.ndarray, once: np.ndarray, pairs: np.ndarray, total: int, rounds: int = 60) -> LabelModel:
        """votes: rows x n of 0 and 1; once, pairs: counts over ``total`` documents."""
        profile, rest = self.groups(once, pairs, total)
        lone = profile == rest
        classes = rest + bool(lone.any())
        believed = np.zeros((classes + 1, self.n))  # votes of lone voters that are taken for granted, by class
        believed[-1, lone] = LONE_PRECISION * LONE_BELIEF * votes[:, lone].sum(0)
        believed[0, lone] = (1 - LONE_PRECISION) * LONE_BELIEF * votes[:, lone].sum(0)
        believed[profile + 1, np.arange(self.n)] += LONE_PRECISION  # and one vote of each voter, which matters in few rows only
        believed[0] += 1 - LONE_PRECISION
        spoken = np.stack([votes[:, profile == k].sum(1) for k in range(classes)], 1)
        toxic = np.where(spoken.sum(1) > 0, np.minimum(0.5 + 0.15 * spoken.sum(1), 0.95), 0.02)
        inside = (spoken + 1e-3) / (spoken + 1e-3).sum(1, keepdims=True)
        q = np.c_[1 - toxic, toxic[:, None] * inside]
        self.discount = np.ones(self.n)
        before = None
        for _ in range(rounds):
            mass = q.sum(0) + believed.sum(1)
            silent = np.r_[5.0, np.zeros(classes)]  # clean documents that no voter speaks on, so that few rows don't all turn toxic
            self.prior = np.clip((mass + silent) / (mass + silent).sum(), 1e-5, 1)
            rates = (q.T @ votes + believed + 0.02) / (mass + np.maximum(silent, 1.0))[:, None]
            self.rates = np.clip(rates, 1e-5, 1 - 1e-3)
            explained = (self.rates.T * self.prior) @ self.rates
            within = self.prior @ (self.rates * (1 - self.rates))  # a voter's variance inside the classes
            excess = np.clip((pairs / max(1, total) - explained) / np.sqrt(np.outer(within, within)), 0, 1)
            np.fill_diagonal(excess, 0)
            self.correlation = np.where(excess > 0.1, excess, 0)
            self.discount = 1 / (1 + self.correlation.sum(1))
            q = self._classes(votes)
            if before is not None and np.abs(q - before).max() < 1e-4:
                break
            before = q
        return self

    def _classes(self, votes: np.ndarray) -> np.ndarray:
        spoke = np.log(self.rates) * self.discount
        silent = np.log(1 - self.rates) * self.discount
        z = np.log(self.prior) + votes @ spoke.T + (1 - votes) @ silent.T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that each row is of a toxic class."""
        return 1 - self._classes(votes)[:, 0]

    @property
    def accuracy(self) -> tuple[np.ndarray, np.ndarray]:
        """Each voter's rate of speaking on toxic and on clean documents."""
        toxic = self.prior[1:] / self.prior[1:].sum()
        return toxic @ self.rates[1:], self.rates[0]


# ---------------------------------------------------------------- linear classifier


class Linear:
    """Logistic regression with an L2 penalty on sparse 0/1 features, by accelerated gradient steps."""

    def __init__(self, n: int, l2: float = 0.05, steps: int = 600):
        self.n, self.l2, self.steps = n, l2, steps

    def fit(self, rows: list[list[int]], targets: np.ndarray, weights: np.ndarray) -> Linear:
        """rows: the features of each; targets: probabilities."""
        n = self.n
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        column = np.array([i for r in rows for i in r], np.int64)
        w, constant = np.zeros(n), 0.0
        speed, drift = np.zeros(n), 0.0
        curve = max(1.0, 0.25 * weights.sum()), np.maximum(1.0, 0.25 * np.bincount(column, weights[at] * np.array([len(r) + 1 for r in rows])[at], n) + self.l2)
        for _ in range(self.steps):
            z = constant + 0.9 * drift + np.bincount(at, (w + 0.9 * speed)[column], len(rows))
            error = weights * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - targets)
            speed = 0.9 * speed - (np.bincount(column, error[at], n) + self.l2 * w) / curve[1]
            drift = 0.9 * drift - error.sum() / curve[0] / 2
            w, constant = w + speed, constant + drift
        self.weights, self.constant = w, float(constant)
        return self

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.constant + self.weights[r].sum() if r else self.constant for r in rows])


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit between two rows that mislabels fewest of them; of equals, the nearest to zero."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], y[order]
    wrong = np.append(0, np.cumsum(y)) + (1 - y).sum() - np.append(0, np.cumsum(1 - y))
    cuts = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
    wrong[1:-1][z[1:] == z[:-1]] = len(y) + 1  # no cut between equal rows
    best = np.flatnonzero(wrong == wrong.min())
    return float(cuts[best[np.abs(cuts[best]).argmin()]])


# ---------------------------------------------------------------- operator


def sample(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> DataFrame:
    """(doc_id, y, open, text): LABELLED_ROWS labelled documents (y) and TRAINING_ROWS of any kind (open), written.

    Both are the first by a hash of doc_id. Labels of the held-out fold are not read. A doc_id that
    is repeated counts once, with its least text; null doc_ids are left out.
    """
    labelled = labels.where(~held_out_column() & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y"))
    known = labelled.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    drawn = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS).select("doc_id", F.lit(True).alias("open"))
    chosen = written(known.join(drawn, "doc_id", "full"), "toxic-chosen")
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")
    return written(rows.groupBy("doc_id", "y", "open").agg(F.min("text").alias("text")), "toxic-sample")


def _count_batches(among: set | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per partition: rows that reach each unit (those of ``among`` only)."""
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = levels_of(words_of(text))
                counts.update(found if among is None else among & found)
        names, levels = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(levels, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["unit", "level", "n"])

    return run


def _counted(rows: DataFrame, among: set | None, least: int) -> dict[tuple[str, int], int]:
    parts = rows.select("text").mapInArrow(_count_batches(among), "unit string, level int, n long")
    return {(r.unit, r.level): r.n for r in parts.groupBy("unit", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}


def standing_out(rows: DataFrame) -> list[tuple[float, float, tuple[str, int]]]:
    """:func:`enriched` over the labelled rows of a sample, counted where the rows are."""
    positive, n = rows.agg(F.count_if(F.col("y") > 0), F.count("y")).first()
    if not 0 < positive < n:
        return []
    toxic = _counted(rows.where("y > 0"), None, MIN_SUPPORT)
    return enriched(toxic, _counted(rows.where("y <= 0"), set(toxic), 1), positive, n)


def _vote_batches(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per partition: how often each voter, and each pair of voters, speaks."""
        n = len(voters.names)
        pairs, total = np.zeros((n, n), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = voters.votes(text, words_of(text))
                total += 1
                if found:
                    pairs[np.ix_(found, found)] += 1
        i, j = np.nonzero(np.triu(pairs))
        rows = [np.r_[-1, i], np.r_[-1, j], np.r_[total, pairs[i, j]]]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], ["i", "j", "n"])

    return run


def vote_moments(docs: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray, int]:
    """(times each voter speaks, times each pair does, documents) over all of ``docs``: voters squared at most."""
    parts = texts(docs).select("text").mapInArrow(_vote_batches(voters), "i long, j long, n long")
    n = len(voters.names)
    pairs, total = np.zeros((n, n)), 0
    for r in parts.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            total = r.n
        else:
            pairs[r.i, r.j] = pairs[r.j, r.i] = r.n
    return pairs.diagonal().copy(), pairs, total


class Scorer:
    """A fitted classifier: the voters' votes and the units are its features."""

    def __init__(self, voters: Voters, units: list[tuple[str, int]]):
        self.voters, self.units, self.size = voters, UnitIndex(units, len(voters.names)), len(voters.names) + len(units)
        for unit, levels in voters.proposed.levels.items():  # one look at a text's units for voters and features
            self.units.levels.setdefault(unit, []).extend(levels)
        self.weights, self.constant = np.zeros(self.size), 0.0

    def features(self, text: str) -> list[int]:
        words = words_of(text)
        return sorted(self.voters.seed_votes(text, words) + self.units.reached(words))

    def score(self, text: str) -> float:
        z = self.constant
        for i in self.features(text):
            z += self.weights[i]
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _featured(rows: DataFrame, scorer: Scorer) -> list:
    """(y, open, features) of each row of a sample, in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.features(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "open", "features"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "y", "open", "text").mapInArrow(run, f"doc_id {kind}, y int, open boolean, features array<int>").orderBy("doc_id").collect()


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> tuple[Scorer, LabelModel]:
    """The classifier and the label model.

    Labels propose terms as voters and units as features, and place the threshold; they are no targets.
    The voters' moments are counted over every document; rates and correlations follow from those and
    from the votes of the training documents, most of them unlabelled; the classifier's targets are the
    label model's posteriors on them and nothing else. Without labels the seed voters are all there is.
    """
    rows = sample(docs, labels, column)
    found = standing_out(rows)
    scorer = Scorer(Voters(propose(found)), [unit for g2, _, unit in found[:FEATURES] if g2 >= MIN_G2])
    n = len(scorer.voters.names)
    once, pairs, total = vote_moments(docs, scorer.voters)
    drawn = _featured(rows, scorer)
    training = [r.features for r in drawn if r.open]
    model = LabelModel(n)
    if not training:
        return scorer, model
    votes = np.zeros((len(training), n))
    for k, features in enumerate(training):
        votes[k, [i for i in features if i < n]] = 1
    targets = model.fit(votes, once, pairs, total).posterior(votes)
    balance = min(20.0, max(1.0, (1 - targets).sum() / max(1.0, targets.sum())))
    linear = Linear(scorer.size).fit(training, targets, 1 + targets * (balance - 1))
    known = [r for r in drawn if r.y is not None]
    threshold = 0.0
    if len({r.y > 0 for r in known}) == 2:
        threshold = best_threshold(linear.logits([r.features for r in known]), np.array([float(r.y > 0) for r in known]))
    scorer.weights, scorer.constant = linear.weights, linear.constant - threshold
    return scorer, model


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Every document is scored from its whole text by the linear classifier; a null text is empty and
    gets the constant's score, and so does a text of any length without a feature. A score of exactly
    0.5 counts as toxic. Without labelled training rows only the seed lexicon and patterns vote. A null
    doc_id hashes as the text None; repeated rows are scored alike; extra columns are ignored; an empty
    table gives an empty table.
    """
    scorer, _ = fit(docs, labels, column)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
