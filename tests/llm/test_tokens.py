import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import stage_path
from tidemark.llm.packing import Packer, pack
from tidemark.llm.token_store import PerfectHash, fetch, key_hash, mix64, open_store, read_store, route, write_store
from tidemark.llm.tokenize import Encoder

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


@pytest.fixture
def uncoalesced(spark):
    """Partitions as dealt: adaptive execution makes one of a test's few rows."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def plain(name, special_as_text=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    if special_as_text:
        t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name, as_text, docs):
    mine, theirs = Encoder(name, limit=60_000, special_as_text=as_text), plain(name, as_text)
    rng = random.Random(3)
    bits = ["the", "Don't", "it's", "ÀÉ", "ß", "ﬁ", "é", "a̧b", " ", "  ", "\n", "\t", " \n", " ", " ", "\x1c", "\x85", "!!", "***", "|", "42", "x1", "“q”", "日本", "🙂", "İ", "Σς", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "\r\n", "'S", "'ll", "l'été", "²", "ª", "×", "_", "~", "'", "᠎", "​"]
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "a ", " a", "a  b"]
    texts += [f"x{s}<|endoftext|>{s}y" for s in ("", " ", "\n")] + ["Ein Wort.\nNeue Zeile\n\n  x", "a\tb\r\nc ", "\n\n", "x" * 5000]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for t in texts:
        assert mine.encode(t).tolist() == theirs(t), repr(t)


def test_repeats_of_one_key_hash_apart_from_repeats_of_others():
    key, nth = (x.ravel() for x in np.meshgrid(np.arange(-40, 400), np.arange(40)))
    null = np.zeros(len(key), bool)
    h = np.r_[key_hash(key, nth, null), key_hash(np.zeros(40, np.int64), np.arange(40), ~null[:40])]
    assert len(np.unique(h)) == len(h)


def test_perfect_hash_is_minimal_and_total():
    h = mix64(np.arange(20000, dtype=np.uint64))
    index = PerfectHash.build(h)
    assert sorted(index.slots(h).tolist()) == list(range(20000))
    assert PerfectHash.build(h[:0]).slots(h[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))


def expected(rows, name, end):
    enc, out, at = plain(name), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*enc(text), end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_store_round_trip(spark, request, which):
    frame = request.getfixturevalue(which)
    path = stage_path(spark, "t-store")
    write_store(frame, path, FILES[0], 2, shard_ids=3000)
    got = [tuple(r) for r in read_store(spark, path).collect()]
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, FILES[0], 2)
    if which == "docs":
        enc = plain(FILES[0])
        keys = spark.createDataFrame([(3,), (17,), (10**12,), (None,), (-4,)], "doc_id long")
        texts = dict(rows)
        assert {r.doc_id: r.ids for r in fetch(spark, path, keys).collect()} == {k: [*enc(texts[k]), 2] for k in (3, 17)}


def test_store_orders_repeats_by_text_and_spreads_null_ids(spark, uncoalesced):
    """Rows without doc_id are a third of all: they are dealt over tasks, and starts don't depend on how rows arrive."""
    rows = [(None if i % 3 == 0 else i // 4, f"text {i * 37 % 101} and more of it") for i in range(900)]
    found = []
    for parts in (2, 7):
        path = stage_path(spark, "t-order")
        write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), path, FILES[0], 2, shard_ids=200)
        found.append(sorted((r.start, r.ids_crc32) for r in read_store(spark, path).collect()))
        assert open_store(spark, path).filter("nulls > 0").select("part").distinct().count() > 1
    assert found[0] == found[1] and len(found[0]) == 900


def test_fetch_reads_the_shards_that_keys_lie_in(spark, uncoalesced):
    """What a lookup scans is one folder and row group of the store, not all of it."""
    path = stage_path(spark, "t-pruned")
    write_store(spark.createDataFrame([(i, f"text number {i}") for i in range(4000)], "doc_id long, text string"), path, FILES[0], 2, shard_ids=500)
    kept = fetch(spark, path, spark.createDataFrame([(77,), (78,)], "doc_id long"))
    enc = plain(FILES[0])
    assert {r.doc_id: r.ids for r in kept.collect()} == {k: [*enc(f"text number {k}"), 2] for k in (77, 78)}
    shards = open_store(spark, path)
    one = shards.filter("first_key <= 77 AND last_key >= 77").select("part", "seq").first()
    named = shards.filter(F.col("part").isin([one.part]) & F.col("seq").isin([one.seq]))
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(seq)" in plan
    assert shards.select("part").distinct().count() > 1 and named.count() == 1


def test_keys_are_routed_to_the_shard_of_their_first_occurrence(spark):
    ids = [-(1 << 62), *[-5] * 9, *range(0, 400, 4), *[400] * 30, 401, 1 << 62]
    path = stage_path(spark, "t-routes")
    write_store(spark.createDataFrame([(i, f"text {i} number {n}") for n, i in enumerate(ids)], "doc_id long, text string"), path, FILES[0], 2, shard_ids=25)
    heads = [tuple(r) for r in open_store(spark, path).select("first_key", "last_key", "part", "seq").collect()]
    asked = sorted({*range(-8, 410), *ids, (1 << 63) - 1, -(1 << 63)})
    frame = spark.createDataFrame([(i,) for i in asked], "asked long")
    got = {r.asked: (r.part, r.seq) for r in route(open_store(spark, path).select("part", "seq", "first_key", "last_key"), frame).collect()}
    want = {k: min(h[2:] for h in heads if h[0] <= k <= h[1]) for k in asked if any(h[0] <= k <= h[1] for h in heads)}
    assert len(heads) > 20 and got == want
    kept = {r.doc_id for r in fetch(spark, path, frame.withColumnRenamed("asked", "doc_id")).collect()}
    assert kept == set(ids)


def check_packing(frame, length=1024, **kw):
    enc = plain(FILES[1])
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = pack(frame, length=length, **kw).collect()
    want = defaultdict(list)
    for doc, text in rows:
        want[doc].append([*enc(text), 0])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc, copies in want.items():
        for r in pieces[doc]:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in copies)
        assert sum(r.length for r in pieces[doc]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert r.start == at and r.length > 0
                at += r.length
    padded = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padded += 0 if at & (at - 1) == 0 else length - at
    assert padded == 0
    return len(seqs)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing(request, which):
    n = check_packing(request.getfixturevalue(which))
    assert (n == 0) == (which == "empty")


def test_packing_many_small_windows(docs):
    check_packing(docs.repartition(5), length=64, windows=3)


def test_packer_keeps_its_space():
    rng, p, sizes = random.Random(1), Packer(100, 4, 0), defaultdict(int)
    for i in range(3000):
        p.add(i, np.arange(rng.randint(1, 250)))
        assert len(p.open) <= 4
    for r in p.out:
        sizes[r[5]] += r[2]
    assert set(sizes.values()) == {100}


def test_words_pattern_matches_bytes_split():
    text = "a\x0bb\x1cc d \te\n"
    assert [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)] == text.encode().split()
