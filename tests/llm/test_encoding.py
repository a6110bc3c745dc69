"""Merge-dropout encoding and token files."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from couponloom.llm.merge_dropout import SPACE, Encoder, decode, encode, piece_model, unit_starts
from couponloom.llm.text import folder_uri
from couponloom.llm.token_files import TokenFile, pack, read_tokens, write_tokens
from couponloom.llm.word_ids import WordEncoder
from tests.llm.conftest import ODD, by_id

WORDS = public_tokenizers.path("word_bpe_49k.json")


def strange(n: int, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    parts = ["a", "The ", "'s", " ", "\n", ".", ",!", "é", "é", "İ", "Σ", "9", "<|endoftext|>", "<|ENDOFTEXT|>", "　",
             "\x1c", "\x00", SPACE, "가", "’", "therefore", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_word_encoder_equals_the_library():
    texts = strange(800) + [t or "" for _, t in ODD]
    whole, single = WordEncoder(WORDS, memory=300), Tokenizer.from_file(WORDS)
    for part in (texts[:400], texts[400:], texts[::3]):
        ids, counts = whole.encode([t.encode() for t in part])
        want = [single.encode(t, add_special_tokens=False).ids for t in part]
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_token_file_gives_every_token():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2 ** rng.integers(1, 33, 3000), dtype=np.uint64).astype(np.uint32)
    file = TokenFile(pack([5, None, 7], np.array([0, 1800, 1200]), ids))
    assert [file[i] for i in range(3000)] == ids.tolist()
    assert file.keys == [5, None, 7] and len(file.document(0)) == 0
    assert (file.document(1) == ids[:1800]).all() and (file.document(2) == ids[1800:]).all()
    assert (file.tokens(513, 1027) == ids[513:1027]).all()
    with pytest.raises(IndexError):
        file[3000]


def test_folders_keep_the_file_system_that_spark_takes_them_from(spark, tmp_path):
    assert folder_uri(spark, "/x/y") == "file:///x/y" == folder_uri(spark, "file:/x/y") == folder_uri(spark, "file:///x/y")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.viewfs.mounttable.other.link./shared", f"file://{tmp_path}")
        conf.set("fs.defaultFS", "viewfs://other/")
        assert folder_uri(spark, "/shared/x") == "viewfs://other/shared/x"
        assert folder_uri(spark, "file:///x") == "file:///x"
    finally:
        conf.set("fs.defaultFS", before)


def test_token_files_round_trip(odd, none):
    single = Tokenizer.from_file(WORDS)
    index = write_tokens(odd, WORDS, file_bytes=20_000)
    assert index.count() > 1
    found = sorted(read_tokens(index).collect(), key=lambda r: r["start"])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in found] == [i for i, _ in order]
    start, texts = 0, {}
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and ids[-1] == 2
        start += len(ids)
        texts.setdefault(r["doc_id"], []).append(ids[:-1])
    for i in texts:
        want = [single.encode(t or "", add_special_tokens=False).ids for k, t in ODD if k == i]
        assert sorted(texts[i]) == sorted(want)
    assert read_tokens(write_tokens(none, WORDS)).count() == 0


def test_plain_encoding_is_the_models_own():
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    plain = Encoder(piece_model(), 0.0, 1)
    for t in [t for t in strange(300) if SPACE not in t and "\x00" not in t] + [t or "" for _, t in ODD[:6]]:
        assert np.frombuffer(plain.encode([t.encode()])[0], "<u2").tolist() == model.encode(t)


def test_dropout_is_seeded_varied_and_lossless():
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    a, same, other = (Encoder(piece_model(), 0.3, seed, memory=50) for seed in (1, 1, 2))
    texts = [t.encode() for t in [*strange(300), "therefore " * 50]]
    ids = a.encode(texts)
    assert ids == [same.encode([t])[0] for t in texts]
    assert sum(x != y for x, y in zip(ids, other.encode(texts))) > 100
    for t, found in zip(texts, ids):
        assert a.model.decode(np.frombuffer(found, "<u2")) == t
        assert model.decode(np.frombuffer(found, "<u2").tolist()) == t.decode()
    ways = a.encode([b"therefore " * 50])[0]
    assert len(set(np.frombuffer(ways, "<u2").tolist())) > 3
    every = np.frombuffer(Encoder(piece_model(), 1.0, 1).encode([b"therefore"])[0], "<u2")
    assert len(every) == len("therefore") + 1


def test_every_occurrence_draws_for_itself():
    encoder, n = Encoder(piece_model(), 0.1, 1), 3000
    output = encoder.model.output
    ids = np.frombuffer(encoder.encode([b" ".join([b"international"] * n)])[0], "<u2").tolist()
    ways, now = [], []
    for piece in (output[i] for i in ids):
        if piece.startswith(b" "):
            ways.append(tuple(now))
            now = []
        now.append(piece)
    ways = [*ways[1:], tuple(now)]
    assert len(ways) == n and set(map(b"".join, ways)) == {b" international"}
    assert len(set(ways)) > 30 and 0.4 < ways.count((b" international",)) / n < 0.9


def test_outcomes_are_those_of_the_agenda():
    for rate in (0.1, 0.5):
        encoder = Encoder(piece_model(), rate, 3, memory=200)
        for t in [t.encode() for t in [*strange(200, 8), "therefore " * 9, "가" * 60 + "é" * 200] if t]:
            starts = unit_starts(b" " + t, np.array([0]), encoder.model.joins).tolist()
            units = [(b" " + t)[a:b] for a, b in zip(starts, [*starts[1:], len(t) + 1])]
            keys = encoder._keys([t], np.array([len(units)])).tolist()
            want = [i for unit, key in zip(units, keys) for i in encoder.model.encode_bytes(unit, rate, key)]
            assert np.frombuffer(encoder.encode([t])[0], "<u2").tolist() == want


def test_both_agendas_merge_alike(monkeypatch):
    model, texts = Encoder(piece_model(), 0.2, 1).model, [t.replace(" ", SPACE) for t in strange(300, 5)]
    short = [model.encode_unit(t, rate, k) for k, t in enumerate(texts) for rate in (0.0, 0.3)]
    monkeypatch.setattr("couponloom.llm.merge_dropout._SHORT", 0)
    assert short == [model.encode_unit(t, rate, k) for k, t in enumerate(texts) for rate in (0.0, 0.3)]


def test_encode_and_decode_rows(odd, none):
    model = piece_model()
    coded = decode(encode(odd, model), model)
    assert coded.where(F.col("decoded") != F.coalesce(F.col("row.text"), F.lit(""))).count() == 0
    assert coded.count() == len(ODD) and coded.select("row.*").columns == odd.columns
    same = by_id(encode(odd.repartition(5), model).select(F.col("row.doc_id").alias("d"), F.hex("ids").alias("h")), "d", "h")
    assert same == by_id(coded.select(F.col("row.doc_id").alias("d"), F.hex("ids").alias("h")), "d", "h")
    want = Encoder(model, 0.1, 1).encode([ODD[0][1].encode()])[0].hex().upper()
    assert (1, want) in same
    both = encode(odd, model, with_text=True).select(F.col("row.doc_id").alias("d"), F.hex("ids").alias("h"), "decoded")
    assert by_id(both, "d", "h", "decoded") == by_id(coded.select(F.col("row.doc_id").alias("d"), F.hex("ids").alias("h"), "decoded"), "d", "h", "decoded")
    assert encode(none, model).count() == 0
