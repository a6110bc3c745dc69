"""Language model, toxicity and the pipeline."""

import itertools
import math
import random
import re
import resource
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from couponloom.llm import attention, lm_scoring, toxicity
from couponloom.llm.attention import CONTEXT, SCORED
from couponloom.llm.simhash import fingerprint
from couponloom.llm.text import id_remainder
from couponloom.llm.toxicity import CharacterModel, Restorer, Scorer, ToxicityModel, decode
from tests.llm.conftest import ODD, by_id, text
from tests.llm.test_duplicates import brute_components, kept_words

WORDS = public_tokenizers.path("word_bpe_49k.json")


def counted(before, after):
    """Distinct pairs of ids as numbers, both ids, and counts."""
    keys, n = np.unique(np.asarray(before) << attention.PAIR_BITS | np.asarray(after), return_counts=True)
    return keys, keys >> attention.PAIR_BITS, keys & (1 << attention.PAIR_BITS) - 1, n


def tables(classes, n_classes, before, after, n):
    after_id = Counter()
    kinds = Counter()
    for b, c, k in zip(before.tolist(), classes[after].tolist(), n.tolist()):
        after_id[b, c] += k
        kinds[b, c] += 1
    places = np.array(sorted(after_id)).T
    own = (*places, np.array([after_id[x] for x in sorted(after_id)]))
    return attention.corpus_tables(
        classes, n_classes, (classes[before], after, n), own, np.array([kinds[x] for x in sorted(after_id)])
    )


def all_pairs(vocabulary, keys, n):
    """Counts of every pair of ids there could be."""
    ids = np.arange(vocabulary)
    every = (ids[:, None] << attention.PAIR_BITS | ids[None, :]).ravel()
    held = dict(zip(keys.tolist(), n.tolist()))
    return every, np.array([held.get(x, 0) for x in every.tolist()])


def small_corpus(vocabulary=12, n_classes=4, seed=0):
    rng = np.random.default_rng(seed)
    classes = rng.integers(0, n_classes, vocabulary)
    ids = rng.integers(0, vocabulary, 100)
    keys, before, after, n = counted(ids[:-1], ids[1:])
    return tables(classes, n_classes, before, after, n), all_pairs(vocabulary, keys, n)


def weights(n_classes=4, seed=1):
    found = attention.initial(n_classes, seed)
    rng = np.random.default_rng(seed)
    return {k: w + rng.normal(0, 0.3, w.shape).astype(np.float32) for k, w in found.items()}


def test_probabilities_of_all_ids_sum_to_one():
    (corpus, pairs), vocabulary = small_corpus(), 12
    score = attention.Scorer(corpus, weights(), *pairs)
    for history in ([3], [3, 1, 4, 1, 5], list(range(12)) * 5):
        texts = [[*history, i] for i in range(vocabulary)]
        lengths = np.array([len(t) for t in texts])
        whole = score(np.concatenate(texts), lengths)
        before = score(np.array(history), np.array([len(history)]))[0] if len(history) > 1 else 0.0
        assert sum(10 ** (w - before) for w in whole) == pytest.approx(1.0, rel=1e-4)


def test_ids_never_seen_share_what_is_left():
    classes = np.array([0, 0, 0, 1, 2, 2])
    counts = np.array([3, 4, 5, 3]), np.array([4, 5, 3, 5]), np.array([5, 2, 1, 1])
    corpus = tables(classes, 3, *counts)
    score = attention.Scorer(corpus, weights(3), *all_pairs(6, counts[0] << attention.PAIR_BITS | counts[1], counts[2]))
    whole = score(np.array([x for i in range(6) for x in (4, 0, i)]), np.full(6, 3))
    before = score(np.array([4, 0]), np.array([2]))[0]
    assert sum(10 ** (w - before) for w in whole) == pytest.approx(1.0, rel=1e-4)
    assert whole[0] == whole[1] == whole[2] and len(corpus.prior) == 4


def test_scores_do_not_depend_on_the_batch_and_each_id_counts_once():
    (corpus, pairs), rng = small_corpus(), np.random.default_rng(3)
    score = attention.Scorer(corpus, weights(), *pairs)
    texts = [rng.integers(0, 12, n) for n in (2, 3, SCORED + 1, SCORED + 2, 5 * SCORED, 2000)]
    together = score(np.concatenate(texts), np.array([len(t) for t in texts]))
    alone = [score(t, np.array([len(t)]))[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-5)
    text_of, _, ahead, _, valid = attention.windows(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert Counter(np.repeat(text_of, valid.sum(axis=1)).tolist()) == {i: len(t) - 1 for i, t in enumerate(texts)}
    assert ahead[:, CONTEXT:].sum() == 0


def test_scores_equal_a_plain_loop():
    """Every probability worked out for itself, from the counts of the corpus and the weights."""
    rng = np.random.default_rng(0)
    classes, ids = rng.integers(0, 4, 12), rng.integers(0, 12, 100)
    count = Counter(zip(ids[:-1].tolist(), ids[1:].tolist()))
    (corpus, pairs), w = small_corpus(), weights()
    text = rng.integers(0, 12, 70)
    value, place = 0.0, corpus.place
    for at in range(len(text) - 1):
        first = at // SCORED * SCORED - CONTEXT
        seen = text[max(0, first) : at + 1]
        embed = w["embed"][classes[seen]]
        asked = embed[-1] @ w["query"]
        scores = [asked @ (e @ w["key"]) / 4 + w["distance"][len(seen) - 1 - k] for k, e in enumerate(embed)]
        shares = np.exp(scores) / np.exp(scores).sum()
        mixed = sum(s * (e @ w["value"]) for s, e in zip(shares, embed))
        logits = corpus.prior[place[text[at]]] + mixed @ w["out"] + w["bias"]
        b, a = int(text[at]), int(text[at + 1])
        value += logits[classes[a]] - np.log(np.exp(logits).sum())
        own = [x for x in range(12) if classes[x] == classes[a]]
        total, kinds = sum(count[b, x] for x in own), 0.5 + sum(count[b, x] > 0 for x in own)
        # After its class an id has its share of the class's continuations, smoothed by its share of all.
        held = {x: sum(n for (p, q), n in count.items() if q == x and classes[p] == classes[b]) for x in own}
        plain = {x: sum(n for (p, q), n in count.items() if q == x) + 0.01 for x in own}
        backed = (held[a] + 4 * plain[a] / sum(plain.values())) / (sum(held.values()) + 4)
        value += np.log((count[b, a] + kinds * backed) / (total + kinds))
    assert attention.Scorer(corpus, w, *pairs)(text, np.array([len(text)]))[0] == pytest.approx(value / np.log(10), rel=1e-4)


def test_gradient_is_the_slope():
    (corpus, _), w = small_corpus(), {k: v.astype(np.float64) for k, v in weights().items()}
    rng = np.random.default_rng(5)
    ids = corpus.place[rng.integers(0, 12, (3, CONTEXT + SCORED))]
    target = rng.integers(0, 4, (3, SCORED))
    before = np.where(np.arange(CONTEXT + SCORED) < np.array([[0], [3], [8]]), -1e9, 0.0)
    valid = np.ones((3, SCORED))
    valid[1, 10:] = 0

    def loss(w):
        return -(attention.class_scores(w, corpus.prior, corpus.classes[ids], ids, before, target) * valid).sum() / valid.sum()

    found = attention.gradient(w, corpus.prior, corpus.classes[ids], ids, before, target, valid)
    for name in w:
        for _ in range(4):
            place = tuple(rng.integers(0, n) for n in w[name].shape)
            step = {k: v.copy() for k, v in w.items()}
            step[name][place] += 1e-3
            up = loss(step)
            step[name][place] -= 2e-3
            assert found[name][place] == pytest.approx((up - loss(step)) / 2e-3, rel=2e-2, abs=2e-4)


def test_training_lowers_the_loss():
    (corpus, _), rng = small_corpus(), np.random.default_rng(6)
    ids = np.cumsum(rng.integers(0, 2, (300, CONTEXT + SCORED)), axis=1) % 12
    target = corpus.classes[corpus.place[(ids[:, CONTEXT:] + 1) % 12]]
    ids = corpus.place[ids]
    windows = corpus.classes[ids], ids, np.zeros(ids.shape, np.float32), target, np.ones(target.shape, np.float32)
    start = attention.initial(4, 0)
    end = start
    for _ in range(3):
        end = attention.train(end, corpus.prior, lambda own: tuple(x[own] for x in windows), np.arange(300), batch=8)
    mean = [attention.class_scores(w, corpus.prior, *windows[:4]).mean() for w in (start, end)]
    assert mean[1] > mean[0] + 0.05


@pytest.mark.parametrize("least", [10, 1 << 22])
def test_blocks_send_all_pairs_and_the_ids_of_training_texts(monkeypatch, least):
    monkeypatch.setattr(lm_scoring, "_PAIRS_AT_ONCE", least)
    monkeypatch.setattr(lm_scoring, "PART_IDS", 500)
    monkeypatch.setattr(lm_scoring, "_PART_BYTES", 3000)
    texts, learned = [text(k, 3 + k % 90) for k in range(200)], [k % 3 > 0 for k in range(200)]
    split, own, bits = lm_scoring.Subwords(WORDS), [], attention.PAIR_BITS
    blocks = [slice(0, 120), slice(120, 200)]
    packs = []
    for block, part in enumerate(blocks):
        table = pa.table({"text": texts[part], "learned": learned[part]})
        packs.append(lm_scoring._send((pa.scalar(block),), table, 3, WORDS))
    sent = pa.concat_tables(packs).to_pylist()
    for row in sent:
        if row["kind"] == lm_scoring.PART:
            ids, lengths = lm_scoring._read_ids(row["packed"])
            own += [tuple(x) for x in np.split(ids, np.cumsum(lengths)[:-1])]
    ids = [split.encode([t.encode()])[0].tolist() for t in texts]
    assert Counter(own) == Counter(tuple(i) for i, train in zip(ids, learned) if train)
    want = Counter(p for i, train in zip(ids, learned) if train for p in zip(i, i[1:]))
    got = {}
    for bucket in range(3):
        rows = [r for r in sent if r["kind"] == lm_scoring.PAIRS and r["bucket"] == bucket]
        answers = lm_scoring._add((pa.scalar(lm_scoring.PAIRS), pa.scalar(bucket)), pa.Table.from_pylist(rows)).to_pylist()
        for row in answers:
            if row["block"] is None:
                keys, n = lm_scoring._read_pairs(row["totals"])
                got |= {(k >> bits, k & (1 << bits) - 1): c for k, c in zip(keys.tolist(), n.tolist())}
    assert got == dict(want)


def test_texts_are_scored_from_the_ids_and_words_that_were_sent(monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_IDS", 500)
    monkeypatch.setattr(lm_scoring, "_PART_BYTES", 3000)
    texts = [text(k, 3 + k % 90) for k in range(200)] + [None, "", " \n", "  Leading and trailing. ", "\u00dcber\u00a0all \u0130st <|endoftext|>"]
    learned, split = [k % 3 > 0 for k in range(len(texts))], lm_scoring.Subwords(WORDS)
    whole = [split.encode([(t or "").encode().lower()])[0] for t in texts]
    given, encode = [], split._encoder.encode
    monkeypatch.setattr(split._encoder, "encode", lambda words: given.extend(words) or encode(words))
    table = pa.table({"text": texts, "learned": learned, "row": [{"doc_id": i} for i in range(len(texts))]})
    sent = lm_scoring._send((pa.scalar(0),), table, 3, WORDS)
    assert {*given} - {b""} == {w for t in texts for w in (t or "").encode().lower().split()}
    kinds = np.array(sent.column("kind").to_pylist())
    answers = []
    for kind, bucket in itertools.product((lm_scoring.WORDS, lm_scoring.PAIRS), range(3)):
        own = sent.filter(pa.array((kinds == kind) & (np.array(sent.column("bucket").to_pylist()) == bucket)))
        answers.append(lm_scoring._add((pa.scalar(kind), pa.scalar(bucket)), own) if len(own) else None)
    answers = pa.concat_tables([x for x in answers if x is not None])
    answers = answers.filter(answers.column("block").is_valid())
    count = Counter(w for t, train in zip(texts, learned) if train for w in (t or "").encode().lower().split())
    pair = np.concatenate([attention.pairs_of(i.astype(np.int64), np.array([len(i)]))[0] for i, train in zip(whole, learned) if train])
    keys, n = np.unique(pair, return_counts=True)
    classes = np.arange(split.size) % 64
    corpus = tables(classes, 64, keys >> attention.PAIR_BITS, keys & (1 << attention.PAIR_BITS) - 1, n)
    held, w = dict(zip(keys.tolist(), n.tolist())), weights(64)
    sums = sum(count.values()) + sum(learned), len(count) + 1, sum(learned)
    parts = sent.filter(pa.array(kinds >= lm_scoring.PART))
    answers = answers.take(pa.array(np.random.default_rng(0).permutation(len(answers))))
    found = lm_scoring._score(parts, answers, sums, type("Sent", (), {"value": corpus}), w).to_pylist()
    assert sorted(r["row"]["doc_id"] for r in found) == list(range(len(texts)))
    for row in found:
        i = row["row"]["doc_id"]
        words = [*(texts[i] or "").encode().lower().split(), None]
        own = np.unique(attention.pairs_of(whole[i].astype(np.int64), np.array([len(whole[i])]))[0])
        plain = attention.Scorer(corpus, w, own, np.array([held.get(k, 0) for k in own.tolist()]))
        assert row["score"] == pytest.approx(plain(whole[i].astype(np.int64), np.array([len(whole[i])]))[0], rel=1e-5)
        known = [sum(learned) if x is None else count[x] for x in words]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(k > 0 for k in known), sums[0])
        assert row["base_score"] == pytest.approx(sum(math.log10((k + 1) / (sums[0] + sums[1] + 1)) for k in known))


def test_steps_of_training_keep_their_memory():
    """Arrays of a step are not handed back to the system and taken anew in the next."""
    rng = np.random.default_rng(0)
    ids, lengths = rng.integers(0, 500, 48_000), np.full(480, 100)
    (corpus, _) = small_corpus(500, 64)
    part = pa.RecordBatch.from_pylist([{"block": 0, "bucket": 0, "packed": lm_scoring._pack_ids(ids, lengths)}])
    given, values = type("Sent", (), {"value": corpus}), attention.flat(attention.initial(64, 1))
    list(lm_scoring._train_part(iter([part]), given, values, 0))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    list(lm_scoring._train_part(iter([part]), given, values, 0))
    steps = attention.window_counts(lengths).sum() / 64
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / steps < 250


def test_windows_by_number_are_those_of_all():
    lengths = np.array([2, 3, SCORED + 1, SCORED + 2, 2, 200])
    ids = np.arange(lengths.sum())
    every = attention.windows(ids, lengths)
    chosen = np.random.default_rng(1).permutation(len(every[0]))
    for one, all_ in zip(attention.windows(ids, lengths, chosen), every):
        assert (one == all_[chosen]).all()


def test_scoring_of_odd_rows(odd, none):
    learned = id_remainder("doc_id", 7) != 2
    found = lm_scoring.score(odd, learned, WORDS, block_bytes=20_000)
    got = by_id(found.select(F.col("row.doc_id").alias("d"), *found.columns[1:]), "d", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    counts = Counter()
    for i, t in ODD:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t in ODD:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        want.append((i, len(words), sum(counts[w] > 0 for w in words), total, base))
    want.sort(key=lambda r: [(v is not None, v) for v in r])
    assert [r[:4] for r in got] == [w[:4] for w in want]
    assert [r[4] for r in got] == pytest.approx([w[4] for w in want])
    assert all(math.isfinite(r[5]) and r[5] < 0 for r in got)
    assert lm_scoring.score(none, learned, WORDS).count() == 0
    assert lm_scoring.score(odd, F.lit(False), WORDS).where("train_tokens = 0 and n_known = 0").count() == len(ODD)


# Toxicity

LETTERS = {w: 3.0 for w in ("idiot", "moron", "total", "a", "you", "are", "an", "worthless", "thing", "stupid", "loser", "see")}


@pytest.mark.parametrize("given, want", [
    ("1d10t", "idiot"), ("idiooooot", "idiot"), ("m.o.r.o.n", "moron"), ("$tup1d", "stupid"), ("w0rthl3$$", "worthless"),
    ("i d i o t", "idiot"), ("l-o-s-e-r", "loser"),
])
def test_decoding_sees_through(given, want):
    assert decode(given, CharacterModel(LETTERS)) == want


def path_value(model, path):
    """Log probability of a path's letters and the end of the word, less the costs of its choices."""
    letters = " " * (model.order - 1) + "".join(t for t, _ in path) + " "
    spoken = sum(model(letters[i - model.order + 1 : i], letters[i]) for i in range(model.order - 1, len(letters)))
    return spoken - sum(cost for _, cost in path)


@pytest.mark.parametrize("spelled", [False, True])
def test_decoding_finds_the_best_of_all_paths(spelled):
    model, rng = CharacterModel(LETTERS), random.Random(12)
    for _ in range(150):
        token = "".join(rng.choice("idotmrnse1035@$!.-_ii") for _ in range(rng.randrange(1, 8)))
        paths = list(itertools.product(*toxicity.lattice(token, spelled)))
        values = {}
        for path in paths:
            out = "".join(t for t, _ in path).strip()
            values[out] = max(path_value(model, path), values.get(out, -math.inf))
        assert values[decode(token, model, spelled)] == pytest.approx(max(values.values()), abs=1e-9)


def test_restoring_leaves_plain_words_alone():
    restorer = Restorer(CharacterModel(LETTERS))
    for t in ["you are a thing", "total, 2024. see!", "(stupid)", "", "ünï cödé"]:
        assert restorer.text(t) == t
    assert restorer.text("an i d i o t you see") == "an idiot you see"
    assert len(restorer.text("a " * 3000)) > 0


def test_long_runs_and_tokens_are_decoded_whole():
    model = CharacterModel({**LETTERS, "ass": 3.0})
    restorer = Restorer(model)
    for separator in (" ", "."):
        assert restorer.text(separator.join("youareathing" * 40 + "idiot")).replace(" ", "").endswith("idiot")
    assert restorer.text("idi" + "o" * 500 + "t") == "idiot"
    assert "moron" in restorer.text("see" * 40 + ".m.o.r.o.n")
    assert restorer.text("an @$$ $ 2024 $455,00 +") == "an ass $ 2024 $455,00 +"
    score = Scorer(ToxicityModel(LETTERS, {("idiot", 0): 0.9}, 0.01))
    clean = "you are a thing " * 3 + " ".join("seeyou" * 100)
    assert score(clean) == pytest.approx(0.01)
    assert score(clean + " a n i d i o t") > 0.5 and score("thing " + "an.".join([""] * 60) + "1d10t") > 0.5


def test_scores_rise_with_stems_only():
    score = Scorer(ToxicityModel(LETTERS, {("idiot", 0): 0.9, ("moron", 0): 0.8, ("lose", 2): 0.7}, 0.01))
    assert score("") == score("a thing") == pytest.approx(0.01)
    assert score("an 1D10T") == pytest.approx(1 - 0.99 * 0.1)
    assert score("idiots! moron") == pytest.approx(1 - 0.99 * 0.1 * 0.2)
    assert score("losing losers " + "thing " * 500) == pytest.approx(0.01)
    assert score("losers") == pytest.approx(1 - 0.99 * 0.3)


def labelled(documents, spark, n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = text(i, 60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(["idiot", "Moron!", "1d10t", "mooooron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    labels += [(None, 1, 1), (1, None, 1), (0, 1, 1), (99_999, 1, 1)]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_rare_stems_are_learned():
    counts = [(("idiot", 0), 0, 2000), (("estup", 0), 0, 24), (("the", 0), 9000, 2100)]
    assert toxicity.choose_stems(counts, 15_000, 5_000).keys() == {("idiot", 0), ("estup", 0)}


def test_held_out_toxicity(documents, spark, odd, none):
    docs, labels = labelled(documents, spark)
    model = toxicity.train(docs, labels, toxicity.usable_label())
    found = toxicity.score(docs, model).select("row.doc_id", "score").toPandas()
    held = found[[zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]]
    right = (held["score"] >= toxicity.THRESHOLD) == (held["doc_id"] % 5 == 0)
    assert len(held) > 50 and right.mean() > 0.95
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(none, model).count() == 0
    for some in (labels.where("toxic = 0"), labels.where("toxic = 1"), labels.where("false")):
        same = toxicity.train(docs, some, F.lit(True))
        assert not same.stems and same.base in (0.0, 1.0)
    assert toxicity.train(none, labels, F.lit(True)).base == 0.0


def test_toxicity_learns_from_every_usable_label(documents, spark):
    """No number of labels is the last: the model's share of label 1 counts those beyond any bound."""
    n = 20_500
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    texts = F.when(F.col("doc_id") % 4 == 0, "idiot").otherwise("calm")
    docs = labels.select("doc_id", F.concat(texts, F.lit(" word")).alias("text"))
    seen = []
    choose = toxicity.choose_stems
    try:
        toxicity.choose_stems = lambda counts, clean, toxic: seen.append(clean + toxic) or choose(counts, clean, toxic)
        toxicity.train(docs, labels, F.lit(True))
    finally:
        toxicity.choose_stems = choose
    assert seen == [n]


def test_texts_meet_the_labels_once_and_alike_at_any_size(documents, spark, monkeypatch):
    """Only the counting of words shuffles texts, by a join that does not turn with the size of the labels."""
    docs, labels = labelled(documents, spark, 100)
    plans, plain = [], type(docs).mapInArrow

    def watched(self, *given, **more):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *given, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    toxicity.train(docs, labels, toxicity.usable_label())
    joined = [plan for plan in plans if "Join" in plan]
    assert len(plans) == 2 and len(joined) == 1
    assert "SortMergeJoin" in joined[0] and "BroadcastHashJoin" not in joined[0]


def test_counted_words_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(toxicity, "_HELD", 50)
    monkeypatch.setattr(toxicity, "_AT_ONCE", 500)
    texts = [text(k, 5 + 7 * k % 200) for k in range(60)]
    texts += ["", "Straße, ÀÀÀ x² don't", "ab abc abcd abcde", "w" * 30 + " www", "日本語日本 日本語", "idiot! Idiots 1d10t"]
    labels = [k % 3 == 0 for k in range(len(texts))]
    want = Counter()
    for t, label in zip(texts, labels):
        words = toxicity.words(t.lower())
        held = Counter(words)
        for feature in toxicity.features(held, len(words)):
            want[feature, int(label)] += 1
        for word in held:
            if word.isalpha() and len(word) <= toxicity.MODEL_WORD:
                want[(word, toxicity._WHOLE), int(label)] += 1
    given = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(labels).cast(pa.int32())], names=["text", "toxic"])
    got = Counter()
    for batch in toxicity._class_words(iter([given, given])):
        for row in batch.to_pylist():
            for name in toxicity._COUNTS:
                kind, label = map(int, name[1:].split("_"))
                got[(row["stem"], kind), label] += row[name]
    whole = [got.pop((("", kind), label)) for kind in range(toxicity._WHOLE + 1) for label in (0, 1)]
    assert whole == [0] * 2 * toxicity._WHOLE + [2 * labels.count(False), 2 * labels.count(True)]
    assert +got == Counter({k: 2 * n for k, n in want.items()})


def test_restored_texts_are_their_restored_tokens():
    restorer, rng = Restorer(CharacterModel(LETTERS)), random.Random(3)
    texts = ["".join(rng.choice("idotseé1!. -_*'“ßxx日²\t\n\x85") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    for t in [*texts, "idiooot! (moron) abc.. ...x moooron,", "x² ÿÿÿ. ééé idiot"]:
        t = t.lower()
        spaced = toxicity._SPACED.sub(lambda m: decode(m[0], restorer._model), t)
        assert restorer.text(t) == " ".join(restorer.token(w) for w in spaced.split())


# Pipeline


def test_pipeline_of_odd_rows(documents, spark, tmp_path):
    docs, labels = labelled(documents, spark, 200)
    passage = text(900, 60)
    bench = text(901, 40)
    more = [(1000, passage + " " + text(902, 40)), (1001, text(903, 40) + " " + passage), (1002, text(904, 60) + " " + bench[:200]),
            (1003, text(905, 80)), (1004, text(905, 80)), (1005, None), (1006, ""), (None, text(906, 40)), (None, text(906, 40))]
    docs.union(documents(more)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = held.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        assert name == "encoding" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r["doc_id"]: r for r in held.collect()}
    toxic = {i for i in range(200) if i % 5 == 0}
    assert not toxic & seen["toxicity"].keys() and len(seen["toxicity"].keys() & set(range(200))) == 160
    assert 1004 not in seen["near_dedup"] and {1003, 1005, None} <= seen["near_dedup"].keys() and 1006 not in seen["near_dedup"]
    for i in (1000, 1001):
        assert passage not in seen["substring_dedup"][i]["text"]
        assert seen["substring_dedup"][i]["n_chars"] == len(seen["substring_dedup"][i]["text"])
    assert seen["substring_dedup"][1003]["text"] == text(905, 80)
    assert 1002 in seen["substring_dedup"] and 1002 not in seen["decontamination"]
    assert len(seen["decontamination"]) == len(seen["substring_dedup"]) - 1
    assert seen["encoding"].keys() == seen["decontamination"].keys()
    assert all(r["lossless"] for r in seen["encoding"].values())
    assert held.count() == corpus_pipeline.run(spark, str(tmp_path)).count()


def test_each_stage_equals_brute_force(documents, spark, tmp_path):
    """Every row that a stage returns, recounted from the rows it was given."""
    rng = random.Random(3)
    shared = [text(700 + k, 45) for k in range(3)]
    bench = [text(800 + k, n) for k, n in enumerate((30, 12, 4))]
    texts = [" ".join(rng.choice([text(i, 30), rng.choice(shared), text(i + 500, 50)]) for _ in range(3)) for i in range(60)]
    texts += [texts[3], texts[3] + " tail", bench[0] + " " + text(950, 40), text(951, 40) + " " + bench[2], "", None, "Ünï ▁ \x00"]
    docs = documents(list(enumerate(texts)) + [(None, texts[5]), (4, texts[4])])
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def rows_of(frame):
        return [(r["doc_id"], r["text"]) for r in frame.collect()]

    def ordered(rows):
        return sorted(rows, key=str)

    distinct = [*dict.fromkeys(rows_of(docs))]
    values = [fingerprint((t or "").encode()) for _, t in distinct]
    roots = brute_components(values, 3)
    groups = {}
    for (i, t), root in zip(distinct, roots, strict=True):
        groups.setdefault(root, []).append((i is None, i or 0, t))
    want = [(None if none else i, t) for none, i, t in map(lambda g: min(g, key=lambda r: r[:2]), groups.values())]
    deduped = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert ordered(rows_of(deduped)) == ordered(want)

    cleaned = corpus_pipeline.substring_dedup(spark, deduped, str(tmp_path))
    given = rows_of(deduped)
    want = [(i, kept if gone else t) for (i, t), (_, gone, kept) in zip(given, kept_words([t for _, t in given], 35), strict=True)]
    assert ordered(rows_of(cleaned)) == ordered(want) and want != given

    def fold(t):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    def windows(t):
        words = fold(t)
        return {tuple(words[k : k + min(10, len(words))]) for k in range(max(1, len(words) - 9))} if words else set()

    listed = set().union(*map(windows, bench))
    clean = corpus_pipeline.decontamination(spark, cleaned, str(tmp_path))
    want = [
        (i, t) for i, t in rows_of(cleaned)
        if not any(tuple(fold(t)[k : k + len(w)]) == w for w in listed for k in range(len(fold(t))))
    ]
    assert ordered(rows_of(clean)) == ordered(want) and len(want) == cleaned.count() - 2

    coded = corpus_pipeline.encoding(spark, clean, str(tmp_path)).collect()
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(coded) == len(want) and all(r["lossless"] and r["n_ids"] * 2 == len(r["ids"]) for r in coded)
    assert max(max(np.frombuffer(r["ids"], "<u2"), default=0) for r in coded) < pieces.get_piece_size()


def test_different_texts_of_an_id_are_documents_of_their_own(documents, spark):
    one, two, three = text(910, 60), text(911, 60), text(912, 60)
    docs = documents([(1, one), (1, two), (1, two), (2, three), (3, two), (None, three)])
    found = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["text"] for r in found.collect()) == sorted([one, two, three])


def test_run_over_no_documents(none, spark, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
