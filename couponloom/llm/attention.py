"""A causal self-attention language model over classes of subword ids, in numpy.

An id is predicted in two steps: its class, then the id within the class. The class comes
from a softmax over the classes that the corpus has after the id before, plus what one
attention head adds from all ids before; the id within its class from corpus counts after
the id before and after its class. Both steps sum to one, so the probabilities of all ids do.

Texts are cut into windows of `CONTEXT + SCORED` ids that overlap by CONTEXT: every id is
scored once, in the window whose last SCORED places hold it, and attends to all ids before
it in that window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

CONTEXT = 8
SCORED = 24
WIDTH = 16
CLASSES = 64
#: Counts that shares weigh after a class, and the count of unseen ids. After an id the coarser
#: distribution weighs as many counts as different continuations were seen.
_BACKOFF, _UNSEEN = 4.0, 0.01
#: Few enough windows for their arrays to stay in a core's cache.
_WINDOWS_AT_ONCE = 192
#: Batches of training that are cut at once.
_BATCHES_AT_ONCE = 16
_RANGE = 30.0

Weights = dict[str, np.ndarray]


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    return {
        "embed": (classes, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
        "distance": (CONTEXT + SCORED,), "out": (WIDTH, classes), "bias": (classes,),
    }


def initial(classes: int, seed: int) -> Weights:
    """Seeded weights whose attention adds nothing yet."""
    rng = np.random.default_rng(seed)
    found = {k: (rng.standard_normal(s) / np.sqrt(WIDTH)).astype(np.float32) for k, s in shapes(classes).items()}
    for name in ("distance", "out", "bias"):
        found[name][:] = 0
    return found


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(values: np.ndarray, classes: int) -> Weights:
    """The weights of `flat`, as views of the values where these are of their type."""
    found, at = {}, 0
    for name, shape in sorted(shapes(classes).items()):
        size = int(np.prod(shape))
        found[name] = values[at : at + size].reshape(shape).astype(np.float32, copy=False)
        at += size
    return found


_PLACE = np.arange(CONTEXT + SCORED)
_APART = (CONTEXT + np.arange(SCORED))[:, None] - _PLACE[None, :]
_CAUSAL = np.where(_APART >= 0, 0.0, -1e9).astype(np.float32)
_APART = np.maximum(_APART, 0)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the last axis, as a product."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])


def _rows(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of a table at places that are all within it, which numpy need not check."""
    return np.take(table, places, axis=0, mode="clip")


def _forward(weights: Weights, prior: np.ndarray, classes: np.ndarray, ids: np.ndarray, before: np.ndarray):
    """Class scores after the scored places, less a shift of each row that keeps them in range.

    prior: log probability of the classes after each id; before: -1e9 at places ahead of the text.
    Products are worked out window by window: small ones cost less than one large one. Shares of
    attention are a / total, and a column of ones follows h, for the bias.
    """
    embed, n = weights["embed"], len(classes)
    queries, keys = embed @ weights["query"] * np.float32(1 / np.sqrt(WIDTH)), embed @ weights["key"]
    values = embed @ weights["value"]
    q, k, v = _rows(queries, classes[:, CONTEXT:]), _rows(keys, classes), _rows(values, classes)
    a = q @ k.transpose(0, 2, 1)
    a += weights["distance"][_APART] + _CAUSAL
    ahead = np.flatnonzero(before[:, 0])
    a[ahead] += before[ahead, None, :]
    # Every place sees itself; where scores cannot leave the range no row needs a shift.
    if _reach(queries, keys) + np.abs(weights["distance"]).max() > _RANGE:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    total = _sums(a)[:, :, None]
    h = np.ones((n, SCORED, WIDTH + 1), a.dtype)
    np.divide(a @ v, total, out=h[:, :, :WIDTH])
    z = h @ np.concatenate([weights["out"], weights["bias"][None]])
    z += _rows(prior, ids[:, CONTEXT:])
    if _reach(values, weights["out"].T) + np.abs(weights["bias"]).max() > _RANGE:
        z -= z.max(axis=2, keepdims=True)
    return q, k, v, a, total, h, z


def _reach(*tables: np.ndarray) -> float:
    """Bound of the products of any rows of two tables."""
    one, two = (np.sqrt((t * t).sum(axis=-1).max(initial=0.0)) for t in tables)
    return float(one * two)


def _summed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sum over windows and places of the products of their rows, worked out a few windows at a time."""
    several = math.gcd(len(one), 8)
    one, two = (x.reshape(len(x) // several, -1, x.shape[-1]) for x in (one, two))
    return (one.transpose(0, 2, 1) @ two).sum(axis=0)


def _places(target: np.ndarray, classes: int) -> np.ndarray:
    """Places of the targets among the scores of all classes after all scored places."""
    return np.arange(0, target.size * classes, classes) + target.ravel()


def class_scores(
    weights: Weights, prior: np.ndarray, classes: np.ndarray, ids: np.ndarray, before: np.ndarray, target: np.ndarray
) -> np.ndarray:
    """Log probability of the target class at each scored place."""
    z = _forward(weights, prior, classes, ids, before)[-1]
    chosen = z.ravel()[_places(target, z.shape[2])].reshape(target.shape)
    np.exp(z, out=z)
    return chosen - np.log(_sums(z))


def gradient(
    weights: Weights, prior: np.ndarray, classes: np.ndarray, ids: np.ndarray, before: np.ndarray,
    target: np.ndarray, weight: np.ndarray,
) -> Weights:
    """Mean gradient of the negative log probability; weight is 0 at places past the text."""
    q, k, v, a, total, h, z = _forward(weights, prior, classes, ids, before)
    n, c = max(1.0, float(weight.sum())), len(weights["embed"])
    np.exp(z, out=z)
    # Probabilities less 1 at the target, all times their sum; the narrow factors are divided by it.
    sums = _sums(z)
    z.ravel()[_places(target, c)] -= sums.ravel()
    part = (weight / sums / n)[:, :, None].astype(z.dtype)
    dh = z @ np.ascontiguousarray(weights["out"].T)
    dh *= part
    out = _summed(h * part, z)
    near = _sums(dh * h[:, :, :WIDTH])[:, :, None]
    dh /= total
    ds = dh @ v.transpose(0, 2, 1)
    ds -= near / total
    ds *= a
    # For each place what it asks, shows and gives; the first places ask nothing.
    d = np.empty((len(classes), CONTEXT + SCORED, 3 * WIDTH), a.dtype)
    d[:, :CONTEXT, :WIDTH] = 0
    np.matmul(ds, k, out=d[:, CONTEXT:, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dh, out=d[:, :, 2 * WIDTH :])
    # Sums by class as products with 0 and 1.
    tq, tk, tv = np.split(_summed(d, _rows(np.eye(c, dtype=a.dtype), classes)).T, 3, axis=1)
    tq = tq * np.float32(1 / np.sqrt(WIDTH))
    embed = weights["embed"]
    return {
        "embed": tq @ weights["query"].T + tk @ weights["key"].T + tv @ weights["value"].T,
        "query": embed.T @ tq, "key": embed.T @ tk, "value": embed.T @ tv,
        "distance": np.bincount(_APART.ravel(), ds.sum(axis=0).ravel(), minlength=CONTEXT + SCORED).astype(np.float32),
        "out": out[:WIDTH], "bias": out[WIDTH],
    }


def train(
    weights: Weights, prior: np.ndarray, cut: Callable[[np.ndarray], tuple[np.ndarray, ...]], order: np.ndarray,
    batch: int = 64, rate: float = 0.01,
) -> Weights:
    """One pass of Adam over the windows numbered in `order`.

    `cut` gives windows by their numbers: classes, ids, before, target class, weight.
    """
    values = flat(weights)
    weights = unflat(values, len(weights["bias"]))
    first, second = np.zeros_like(values), np.zeros_like(values)
    for at in range(0, len(order), batch * _BATCHES_AT_ONCE):
        many = cut(order[at : at + batch * _BATCHES_AT_ONCE])
        for start in range(0, len(many[0]), batch):
            d = flat(gradient(weights, prior, *(x[start : start + batch] for x in many)))
            step = (at + start) // batch + 1
            first = 0.9 * first + 0.1 * d
            second = 0.99 * second + 0.01 * d**2
            values -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return weights


def window_counts(lengths: np.ndarray) -> np.ndarray:
    """Windows of texts given as start id, ids, end id."""
    return -(-(lengths - 1) // SCORED)


def windows(
    ids: np.ndarray, lengths: np.ndarray, chosen: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts given as start id, ids, end id, one after the other; all, or those of the numbers chosen.

    Returns (text, input ids, places ahead of the text, target ids, target is within the text).
    """
    starts = np.cumsum(lengths) - lengths
    after = np.cumsum(window_counts(lengths))
    number = np.arange(after[-1] if len(after) else 0) if chosen is None else chosen
    text = np.searchsorted(after, number, side="right")
    number = number - (after - window_counts(lengths))[text]
    place = (number * SCORED - CONTEXT)[:, None] + _PLACE[None, :]
    last = lengths[text][:, None] - 1
    inputs = ids[starts[text][:, None] + np.clip(place, 0, last)]
    wanted = place[:, CONTEXT:] + 1
    targets = ids[starts[text][:, None] + np.minimum(wanted, last)]
    return text, inputs, place < 0, targets, wanted <= last


@dataclass(frozen=True)
class Corpus:
    """What is counted over the corpus, as log probabilities.

    place: number of an id in the tables, 0 for all ids that were never seen; the other tables
    know ids by these numbers only, so they are as large as the part of the vocabulary in use.
    classes: class of each id; prior: classes after an id; within: an id among its class after
    a class; seen, kinds: how many ids of a class, and how many different ones, follow an id.
    """

    place: np.ndarray
    classes: np.ndarray
    prior: np.ndarray
    within: np.ndarray
    seen: np.ndarray
    kinds: np.ndarray

    def inner(self, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log probability of ids within their classes; n: how often the pair is in the corpus."""
        own = self.classes[after]
        kinds = self.kinds[before, own] + 0.5
        backed = np.exp(self.within[self.classes[before], after].astype(np.float64))
        return np.log((n + kinds * backed) / (self.seen[before, own] + kinds))


#: Bits of the second id of a pair.
PAIR_BITS = 20


def pairs_of(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring ids of texts in one number each, and each text's first; texts have two ids at least."""
    keep = np.ones(max(len(ids) - 1, 0), dtype=bool)
    keep[np.cumsum(lengths)[:-1] - 1] = False
    return (ids[:-1] << PAIR_BITS | ids[1:])[keep], np.cumsum(lengths - 1) - (lengths - 1)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def corpus_tables(classes: np.ndarray, n_classes: int, after_class: Counts, after_id: Counts, kinds: np.ndarray) -> Corpus:
    """Tables from counts of (class, id after) and (id, class after), the latter also of different ids."""
    vocabulary = len(classes)
    held = np.zeros((n_classes, vocabulary))
    np.add.at(held, after_class[:2], after_class[2])
    single = held.sum(axis=0) + _UNSEEN
    share = single / np.bincount(classes, single, minlength=n_classes)[classes]
    pairs = np.zeros((n_classes, n_classes))
    for c in range(n_classes):
        pairs[:, c] = held[:, classes == c].sum(axis=1)
    within = (held + _BACKOFF * share) / (pairs[:, classes] + _BACKOFF)
    own = pairs.sum(axis=0) + 0.1
    coarse = pairs + _BACKOFF * own / own.sum()
    coarse /= coarse.sum(axis=1, keepdims=True)
    prior, many = np.zeros((vocabulary, n_classes)), np.zeros((vocabulary, n_classes), dtype=np.float32)
    np.add.at(prior, after_id[:2], after_id[2])
    np.add.at(many, after_id[:2], kinds)
    seen = prior.astype(np.float32)
    prior += (1.0 + (prior > 0).sum(axis=1, keepdims=True)) * coarse[classes]
    prior /= prior.sum(axis=1, keepdims=True)
    in_use = np.zeros(vocabulary, dtype=bool)
    in_use[after_class[1]] = in_use[after_id[0]] = True
    place = np.where(in_use, np.cumsum(in_use), 0)
    # Ids never seen are alike: any of them stands for all.
    own = np.concatenate([[int(np.argmin(in_use))], np.flatnonzero(in_use)])
    classes, prior, within = classes[own].astype(np.int64), prior[own], within[:, own]
    return Corpus(
        place, classes, np.log(prior).astype(np.float32), np.log(within).astype(np.float32), seen[own], many[own]
    )


def cluster(profiles: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Classes of rows with like profiles: weighted k-means from the heaviest rows on."""
    if len(profiles) <= k:
        return np.arange(len(profiles))
    order = np.argsort(-weight, kind="stable")
    centres = profiles[order[:k]].copy()
    for _ in range(rounds):
        apart = (centres**2).sum(axis=1)[None, :] - 2 * profiles @ centres.T
        near = apart.argmin(axis=1)
        total = np.bincount(near, weight, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, profiles * weight[:, None])
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centres)
    return near


class Scorer:
    """Log10 probability of texts given as id sequences.

    pairs, n: all pairs of neighbouring ids that occur in the texts, in order, and their counts in the corpus.
    """

    def __init__(self, corpus: Corpus, weights: Weights, pairs: np.ndarray, n: np.ndarray):
        self.corpus, self.weights, self.pairs, self.n = corpus, weights, pairs, n

    def __call__(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Texts as start id, ids, end id; the start id is given, all others are scored."""
        if not len(lengths):
            return np.zeros(0)
        found, starts = pairs_of(ids, lengths)
        distinct, which = np.unique(found, return_inverse=True)
        classes, place = self.corpus.classes, self.corpus.place
        own = place[distinct >> PAIR_BITS], place[distinct & (1 << PAIR_BITS) - 1]
        inner = self.corpus.inner(*own, self.n[np.searchsorted(self.pairs, distinct)])[which]
        total, ids = np.add.reduceat(inner, starts), place[ids]
        for at, (text, inputs, ahead, targets, valid) in self._parts(ids, lengths):
            before = np.where(ahead, np.float32(-1e9), np.float32(0))
            scores = class_scores(self.weights, self.corpus.prior, classes[inputs], inputs, before, classes[targets])
            np.add.at(total, at + text, np.where(valid, scores, 0.0).sum(axis=1, dtype=np.float64))
        return total / np.log(10.0)

    def _parts(self, ids: np.ndarray, lengths: np.ndarray):
        """Windows of some texts after others, _WINDOWS_AT_ONCE at a time."""
        starts = np.cumsum(lengths) - lengths
        count = np.cumsum(window_counts(lengths))
        at = 0
        while at < len(lengths):
            done = count[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(count, done + 16 * _WINDOWS_AT_ONCE, side="right")))
            part = ids[starts[at] : starts[end - 1] + lengths[end - 1]]
            found = windows(part, lengths[at:end])
            for i in range(0, len(found[0]), _WINDOWS_AT_ONCE):
                yield at, tuple(x[i : i + _WINDOWS_AT_ONCE] for x in found)
            at = end
