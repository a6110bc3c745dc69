"""Toxicity after noisy-channel deobfuscation.

Readers see through "1d10t", "i d i o t" and "idiooot"; a word classifier does not. Every
token that is not plain is opened to a character lattice: a digit or symbol may stand for
the letters it looks like, a separator inside a token for nothing, a run of one letter for one
or two of it, single characters in a row for one word or several. Viterbi search takes the
path of least channel cost and highest probability under a character language model, and a
noisy-or model of word stems scores the restored text. Tokens and runs of single characters are
decoded whole, however long. A token without any letter is restored where that gives a word of
the character model; a number stays a number.

Learned from all usable labelled rows: words of both classes, from which the character model, the
word features and their weights follow.
Scoring is a map over all whole texts.

Contract of `score`: null and empty texts get the score of a text without any feature. Rows
of `labels` without label or key are left out, several labels of a key count as the largest.
Without labelled rows of both classes every score is the share of label 1 (0 without rows).
Rows that repeat are scored alike; they keep all their columns in the struct `row`.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from couponloom.llm.text import appended, chunks, give_back, id_remainder, text_bytes
from couponloom.workspace import private_stage

#: Labelled documents a word or stem must be in to be learned from.
LEAST_DOCS = 4
#: Log-likelihood ratio from which a word tells the classes apart.
LEAST_RATIO = 15.0
#: Smoothed share of label 1 among the documents that hold a feature.
LEAST_PRECISION = 0.75
#: Letters of the shortest and longest stem.
STEM = (3, 12)
#: Grades of a stem in a text: at least this share of its words, and so many of them.
GRADES = ((0.0, 1), (0.005, 2), (0.008, 1), (0.012, 1), (0.012, 2))

#: A stem and its grade.
Feature = tuple[str, int]
THRESHOLD = 0.3

# Letters that digits and symbols are written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
_SUBSTITUTE, _DROP, _REPEAT, _BREAK, _KEEP = 0.7, 0.4, 0.3, 1.0, 1.5
_EDGES = ".,;:?!\"'`´“”„«»()[]{}<>*#%&~^=/\\-_…"
_RUN = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t.\-_*]\S){3,}(?!\S)")
#: Longer tokens are not remembered, and may be words joined by separators.
_ONE_WORD = 64
#: UTF-8 with a space for each mark of ASCII; other characters hold none of these bytes.
_PUNCTUATION = bytes(0x20 if 0x20 < i < 0x7F and not chr(i).isalnum() else i for i in range(256))
#: Tokens of a text with single spaces that are no letters with marks after them.
_ODD = rf"(?<![^ ])(?![a-zß-öø-ɏ]+[{re.escape(_EDGES)}]*(?![^ ]))[^ ]+"


class CharacterModel:
    """Interpolated character n-grams of words; a space is the edge of a word."""

    def __init__(self, words: dict[str, float], order: int = 4, weight: float = 2.0):
        self.order, self._weight, self.words = order, weight, words
        grams: dict[str, float] = defaultdict(float)
        contexts: dict[str, float] = defaultdict(float)
        for word, n in words.items():
            marked = " " * (order - 1) + word + " "
            for i in range(order - 1, len(marked)):
                for k in range(order):
                    grams[marked[i - k : i + 1]] += n
                    contexts[marked[i - k : i]] += n
        self._grams, self._contexts = dict(grams), dict(contexts)
        self._letters = max(1, sum(1 for g in grams if len(g) == 1)) + 1
        self._known: dict[str, float] = {}

    def __call__(self, context: str, letter: str) -> float:
        """Log probability of the letter after the last order - 1 characters."""
        gram = context + letter
        found = self._known.get(gram)
        if found is None:
            p = 1.0 / self._letters
            for k in range(self.order):
                tail = gram[self.order - 1 - k :]
                p = (self._grams.get(tail, 0.0) + self._weight * p) / (self._contexts.get(tail[:-1], 0.0) + self._weight)
            if len(self._known) > 100_000:
                self._known.clear()
            found = self._known[gram] = math.log(p)
        return found


def lattice(token: str, spelled: bool = False) -> Iterator[list[tuple[str, float]]]:
    """(output, cost) choices for each part of a lower-case token.

    Where it is spelled in digits and symbols alone, those that look like letters stand for them.
    A token that is longer than words are may hold several, so its separators may end a word.
    """
    apart = [("", _DROP), (" ", _BREAK)] if len(token) > _ONE_WORD else [("", _DROP)]
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            if run >= 3:
                yield [(c, _REPEAT), (c + c, _REPEAT)]
            else:
                yield from [[(c, 0.0)]] * run
        elif c in " \t":
            yield [("", _DROP / 4), (" ", _BREAK)]
        elif run >= 3 and not (spelled and c in LOOKS_LIKE):
            yield apart
        else:
            choices = [(letter, _SUBSTITUTE) for letter in LOOKS_LIKE.get(c, "")]
            if not (spelled and choices):
                choices += [(c, _KEEP)] if c.isdigit() else apart
            yield from [choices] * min(run, 2)
        i = j


#: The last text put out and the path before it; paths share what they have in common.
Path = tuple["Path", str] | None


def decode(token: str, model: CharacterModel, spelled: bool = False) -> str:
    """Best path through the token's lattice."""
    width = model.order - 1
    best: dict[str, tuple[float, Path]] = {" " * width: (0.0, None)}
    for choices in chain(lattice(token, spelled), [[(" ", 0.0)]]):
        ahead: dict[str, tuple[float, Path]] = {}
        for state, (score, path) in best.items():
            for text, cost in choices:
                value, at = score - cost, state
                for letter in text:
                    value += model(at, letter)
                    at = (at + letter)[1:]
                found = ahead.get(at)
                if found is None or value > found[0]:
                    ahead[at] = value, (path, text) if text else path
        best = ahead
    path, output = max(best.values(), key=lambda found: found[0])[1], []
    while path is not None:
        path, text = path
        output.append(text)
    return "".join(reversed(output)).strip()


class Restorer:
    """Restores texts; remembers what became of a token."""

    def __init__(self, model: CharacterModel, memory: int = 100_000):
        self._model, self._memory = model, memory
        self._known: dict[str, str] = {}

    def token(self, token: str) -> str:
        found = self._known.get(token)
        if found is None:
            found = self._restore(token)
            if len(self._known) > self._memory:
                self._known.clear()
            if len(token) <= _ONE_WORD:
                self._known[token] = found
        return found

    def _restore(self, token: str) -> str:
        core = token.rstrip(_EDGES).lstrip(_EDGES.replace("!", ""))
        if not core:
            return token
        if core.isalpha():
            return token if not _RUN.search(core) else decode(core, self._model)
        if not any(c.isalpha() for c in core):
            if not any(c in LOOKS_LIKE and not c.isdigit() for c in core):
                return token
            found = decode(core, self._model, spelled=True)
            return found if found in self._model.words else token
        return decode(core, self._model)

    def text(self, text: str) -> str:
        """Restored text of lower-case text; tokens are joined by single spaces."""
        text = " ".join(_SPACED.sub(lambda m: decode(m[0], self._model), text).split())
        # Letters with marks after them stay as they are, but for runs of a letter.
        odd = "|".join([_ODD, *[rf"(?<![^ ])(?=[^ ]*?{run})[^ ]+" for run in _runs(text)]])
        return re.sub(odd, lambda m: self.token(m[0]), text)


def _runs(text: str) -> list[str]:
    """Letters that come three times in a row, so often each."""
    units = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    same = units[1:] == units[:-1]
    letters = map(chr, np.unique(units[:-2][same[1:] & same[:-1]]).tolist())
    return [letter * 3 for letter in letters if letter.isalpha()]


def words(text: str) -> list[str]:
    return text.encode().translate(_PUNCTUATION).decode().split()


def features(counts: Counter[str], n_words: int) -> set[Feature]:
    """Stems in a text of n words, once for each grade they reach.

    Stems are beginnings of words, which languages with endings share between forms; long
    clean texts hold some by chance, so their share of the words tells more.
    """
    held: Counter[str] = Counter()
    for word, n in counts.items():
        if word.isalpha():
            for k in range(STEM[0], min(len(word), STEM[1]) + 1):
                held[word[:k]] += n
    least = [max(share * n_words, n) for share, n in GRADES]
    return {(stem, grade) for stem, n in held.items() for grade, most in enumerate(least) if n >= most}


@dataclass(frozen=True)
class ToxicityModel:
    """Words of the character model, probability of label 1 for each feature alone and for none (None: not known yet)."""

    letters: dict[str, float]
    stems: dict[Feature, float]
    base: float | None


class Scorer:
    """Noisy-or: a text is clean if none of the stems in it made it toxic."""

    def __init__(self, model: ToxicityModel, letters: CharacterModel | None = None):
        self._clean = {feature: 1.0 - p for feature, p in model.stems.items()}
        self._heads = frozenset(stem[: STEM[0]] for stem, _ in model.stems)
        self._base = model.base or 0.0
        self.restorer = Restorer(letters or CharacterModel(model.letters))

    def found(self, text: str) -> set[Feature]:
        """Known features of the restored text."""
        restored, heads = words(self.restorer.text(text.lower())), self._heads
        held = Counter([w for w in restored if w[: STEM[0]] in heads])
        return features(held, len(restored)) & self._clean.keys() if held else set()

    def clean(self, text: str) -> float:
        """Probability that no feature of the text made it toxic: 1 without any, else less."""
        return math.prod(self._clean[f] for f in sorted(self.found(text)))

    def __call__(self, text: str) -> float:
        return 1.0 - (1.0 - self._base) * self.clean(text)


#: Letters of the words that the character model learns from: longer runs of letters are noise more often than
#: words. Stems are learned from words of any length, and restoring reads tokens of any length.
MODEL_WORD = 24
#: What is counted beside the grades of stems: whole words.
_WHOLE = len(GRADES)
#: Documents of each class, clean before toxic, for each grade of a stem and for the whole word.
_COUNTS = [f"n{kind}_{label}" for kind in range(_WHOLE + 1) for label in (0, 1)]
#: Stems and words that a task holds before it sends their counts on, and bytes of text it counts at once.
_HELD = 500_000
_AT_ONCE = 2 << 20


def _groups(of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of equal neighbours and the sums of their numbers."""
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return first, np.add.reduceat(n, first) if len(first) else n


class _Tally:
    """Documents of each class that hold a stem in a grade, or a whole word."""

    def __init__(self):
        self._names: dict[str, int] = {}
        self._counts = np.zeros((0, len(_COUNTS)), dtype=np.int64)

    def __len__(self) -> int:
        return len(self._names)

    def _codes(self, names: list[str]) -> np.ndarray:
        held = self._names
        codes = np.fromiter([held.setdefault(name, len(held)) for name in names], np.int64, len(names))
        if len(held) > len(self._counts):
            more = max(len(held), 2 * len(self._counts)) - len(self._counts)
            self._counts = np.concatenate([self._counts, np.zeros((more, len(_COUNTS)), np.int64)])
        return codes

    def _add(self, kind: int, codes: np.ndarray, of: np.ndarray, label: np.ndarray) -> None:
        found = np.bincount(of * 2 + label, minlength=2 * len(codes)).reshape(-1, 2)
        own = np.flatnonzero(found.any(axis=1))
        self._counts[codes[own], 2 * kind : 2 * kind + 2] += found[own]

    def add(self, texts: list[str], labels: np.ndarray) -> None:
        """Count the words of lower-case texts and their beginnings."""
        found = [words(t) for t in texts]
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        # Words in order, so that words of one stem are neighbours in each text.
        names = sorted(filter(str.isalpha, set(chain.from_iterable(found))))
        if not names:
            return
        place = {name: k for k, name in enumerate(names)}
        at = np.fromiter([place.get(w, -1) for f in found for w in f], np.int64, int(lengths.sum()))
        text = np.repeat(np.arange(len(texts)), lengths)[at >= 0]
        pairs, n = np.unique(text * len(names) + at[at >= 0], return_counts=True)
        text, word = np.divmod(pairs, len(names))
        label = labels[text]
        letters = np.array([len(name) for name in names])
        short = letters <= MODEL_WORD
        keep, number = short[word], np.cumsum(short) - 1
        whole = self._codes([names[i] for i in np.flatnonzero(short).tolist()])
        self._add(_WHOLE, whole, number[word[keep]], label[keep])
        least = [np.maximum(share * lengths, most) for share, most in GRADES]
        for k in range(STEM[0], STEM[1] + 1):
            long = letters >= k
            own = np.flatnonzero(long)
            if not len(own):
                break
            heads = [names[i][:k] for i in own.tolist()]
            new = [True, *[a != b for a, b in zip(heads, heads[1:])]]
            stem = np.full(len(names), -1)
            stem[own] = np.cumsum(new) - 1
            codes = self._codes([head for head, first in zip(heads, new, strict=True) if first])
            keep = long[word]
            text, word, n, label = text[keep], word[keep], n[keep], label[keep]
            first, held = _groups(text * len(names) + stem[word], n)
            of, where, which = stem[word[first]], text[first], label[first]
            for grade, most in enumerate(least):
                reached = held >= most[where]
                if reached.any():
                    self._add(grade, codes, of[reached], which[reached])

    def flush(self) -> pa.RecordBatch:
        held = self._counts[: len(self._names)]
        columns = [pa.array(list(self._names), pa.string()), *[pa.array(held[:, i].copy()) for i in range(len(_COUNTS))]]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["stem", *_COUNTS])


def _class_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a stem or a whole word; those of all texts stand beside the empty word."""
    tally, seen = _Tally(), np.zeros(2, dtype=np.int64)
    for batch in batches:
        labels = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        seen += np.bincount(labels, minlength=2)
        texts = text_bytes(batch.column("text"))
        for part in chunks([len(t) for t in texts], _AT_ONCE):
            tally.add([t.decode().lower() for t in texts[part]], labels[part])
            if len(tally) > _HELD:
                yield tally.flush()
    yield tally.flush()
    none = [pa.array([int(n) if name.startswith(f"n{_WHOLE}_") else 0], pa.int64()) for name, n in zip(_COUNTS, np.tile(seen, _WHOLE + 1))]
    yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), *none], names=["stem", *_COUNTS])
    give_back()


def _ratio(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """Log-likelihood ratio of a stem's presence in two classes."""

    def part(x: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return x * np.log(p) + (n - x) * np.log(1 - p)

    both = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, both) - part(b, n_b, both))


def choose_stems(counts: list[tuple[Feature, int, int]], n_clean: int, n_toxic: int) -> dict[Feature, float]:
    """Features that tell label 1, no stem the beginning of another: (feature, clean, toxic) to probability."""
    if not counts:
        return {}
    clean = np.array([c for _, c, _ in counts], dtype=float)
    toxic = np.array([t for _, _, t in counts], dtype=float)
    ratio = _ratio(toxic, clean, n_toxic, n_clean)
    p = (toxic + n_toxic / (n_toxic + n_clean)) / (toxic + clean + 1.0)
    usable = (ratio >= LEAST_RATIO) & (p >= LEAST_PRECISION) & (toxic >= LEAST_DOCS)
    order = sorted(np.flatnonzero(usable).tolist(), key=lambda i: (-ratio[i], -len(counts[i][0][0]), counts[i][0]))
    chosen: dict[Feature, float] = {}
    whole: set[str] = set()
    begun: set[str] = set()
    for i in order:
        stem = counts[i][0][0]
        if stem not in begun and not any(stem[:k] in whole for k in range(1, len(stem))):
            chosen[counts[i][0]] = float(p[i])
            whole.add(stem)
            begun.update(stem[:k] for k in range(1, len(stem) + 1))
    return chosen


def _label_keys(labels: DataFrame, usable: Column, key: str, label: str) -> DataFrame:
    return (
        labels.where(usable & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    )


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """Words and features of all labelled keys among the usable rows of labels.

    The base is known only where there are no features to learn, without labelled rows of both classes.
    """
    keys = _label_keys(labels, usable, key, label)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # Texts are shuffled once, here, and at any size: labels grow with the documents.
    learned = texts.join(keys.hint("merge"), "key").select("toxic", "text")
    counted = learned.mapInArrow(_class_words, ", ".join(["stem string", *[f"{name} long" for name in _COUNTS]]))
    counted = counted.groupBy("stem").agg(*[F.sum(name).alias(name) for name in _COUNTS])
    graded = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("grade"), F.col(f"n{kind}_0").alias("clean"), F.col(f"n{kind}_1").alias("toxic"))
        for kind in range(_WHOLE + 1)
    ])).alias("of")
    found = (
        counted.select("stem", graded).select("stem", "of.*")
        .where((F.col("stem") == "") | (F.col("clean") + F.col("toxic") >= LEAST_DOCS))
        .where((F.col("grade") == _WHOLE) | (F.col("toxic") >= F.col("clean"))).collect()
    )
    found.sort(key=lambda r: (r["grade"], r["stem"]))
    n_clean, n_toxic = next(((r["clean"], r["toxic"]) for r in found if r["stem"] == "" and r["grade"] == _WHOLE), (0, 0))
    if not n_clean or not n_toxic:
        return ToxicityModel({}, {}, n_toxic / max(1, n_clean + n_toxic))
    found = [r for r in found if r["stem"]]
    letters = {r["stem"]: math.log1p(r["clean"] + r["toxic"]) for r in found if r["grade"] == _WHOLE}
    counts = [((r["stem"], r["grade"]), r["clean"], r["toxic"]) for r in found if r["grade"] != _WHOLE]
    return ToxicityModel(letters, choose_stems(counts, n_clean, n_toxic), None)


def with_base(
    model: ToxicityModel, scored: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", label: str = "toxic"
) -> ToxicityModel:
    """The model with its base: the share of label 1 among texts learned from without any feature.

    scored: key and clean of `score` by the model for all documents. Their texts need not meet the labels.
    """
    if model.base is not None:
        return model
    keys = _label_keys(labels, usable, key, label)
    left = scored.where("clean = 1").select(F.col(key).alias("key")).join(keys, "key").groupBy("toxic").agg(F.count("*").alias("n"))
    rest = {r["toxic"]: r["n"] for r in left.collect()}
    return replace(model, base=(rest.get(1, 0) + 0.5) / (rest.get(0, 0) + rest.get(1, 0) + 1.0))


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """The model of all labelled keys among the usable rows of labels."""
    model = learn(docs, labels, usable, key, text, label)
    scored = score(docs.select(key, text), model, text).select(f"row.{key}", "clean")
    return with_base(model, scored, labels, usable, key, label)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Each row of docs with the score of its whole text, and the probability that no feature made it toxic."""
    # The character model's words are many and its n-grams few: they are counted once, not in every task.
    given = docs.sparkSession.sparkContext.broadcast((replace(model, letters={}), CharacterModel(model.letters)))
    base = model.base or 0.0

    def make():
        scorer = Scorer(*given.value)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            clean = np.array([scorer.clean(t.decode()) for t in texts], dtype=float)
            return [pa.array(1.0 - (1.0 - base) * clean), pa.array(clean)]

        return compute

    return appended(docs, text, make, "score double, clean double")


def usable_label() -> Column:
    """Labels to learn from: keys whose crc32 is not 2 modulo 4."""
    return id_remainder("doc_id", 4) != 2


def op5_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all `documents`; learns from `labels` that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, usable_label())
    # Texts are restored once: what they hold is written, and the base follows from it.
    held = private_stage(spark, "held", lambda: score(docs, model).select("row.doc_id", "clean"))
    model = with_base(model, held, labels, usable_label())
    return held.withColumn("score", F.lit(1.0) - F.lit(1.0 - model.base) * F.col("clean")).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
