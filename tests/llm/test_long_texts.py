"""Texts of a megabyte: one word again and again, one word without end, lines, prose; every operator takes them whole."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import SCHEMA
from tests.llm.test_rules_and_mix import brute_measure
from tests.llm.test_simhash import brute_fingerprint
from tidemark.llm.common import stage_path
from tidemark.llm.exact_dedup import keep_last
from tidemark.llm.kneser_ney import classify
from tidemark.llm.license_scan import TEMPLATES, license_matches
from tidemark.llm.mixing import mix
from tidemark.llm.near_copies import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import MEASURES, rule_ledger
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.token_counts import tokenizer_counts
from tidemark.llm.token_store import read_store, write_store

_RNG = random.Random(12)
TEXTS = {
    1: "word " * 200_000,
    2: "x" * 1_000_000,
    3: "A line of text.\n" * 60_000,
    4: " ".join("".join(_RNG.choice("abcdefghij") for _ in range(_RNG.randint(2, 9))) for _ in range(160_000)) + " " + TEMPLATES["MIT (notice)"],
    5: "short",
}


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t), 0) for i, t in TEXTS.items()], SCHEMA).repartition(3)


def test_rules_mix_and_fingerprints(long):
    assert {r.doc_id: tuple(r[m] for m in MEASURES) for r in rule_ledger(long).collect()} == {i: brute_measure(t) for i, t in TEXTS.items()}
    assert {r.doc_id: r.size for r in mix(long).collect()} == {i: len(t.split()) for i, t in TEXTS.items()}
    assert {r.doc_id: r.fp for r in near_duplicates(long).collect()} == {i: brute_fingerprint(t) for i, t in TEXTS.items()}


def test_copies_and_licenses(spark, long):
    again = long.unionByName(spark.createDataFrame([(9, TEXTS[4].upper(), "en", "s", 0, 0)], SCHEMA))
    assert sorted(r.doc_id for r in keep_last(again).select("doc_id").collect()) == [1, 2, 3, 5, 9]
    assert sorted(r.doc_id for r in one_of_each(again).select("doc_id").collect()) == [1, 2, 3, 4, 5]
    got = license_matches(long).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(4, "MIT (notice)", 1.0)] and TEXTS[4][got[0].start_char :] == TEMPLATES["MIT (notice)"][:-1] + "."[: len(TEXTS[4]) - got[0].end_char]


def test_tokens(spark, long):
    path = stage_path(spark, "t-long")
    write_store(long, path, "word_bpe_49k.json", 2)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in TEXTS.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in read_store(spark, path).collect()} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    assert {r.doc_id: r.n_tokens for r in tokenizer_counts(long, {"v": "word_bpe_49k.json"}).collect()} == {i: len(x) - 1 for i, x in want.items()}
    total = {r.doc_id: r.n for r in pack(long).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert total == {i: len(byte.encode(t, add_special_tokens=False).ids) + 1 for i, t in TEXTS.items()}


def test_model(spark, long):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.n_chars16 for r in classify(long, labels).collect()}
    assert got == {i: len(t) for i, t in TEXTS.items()}
