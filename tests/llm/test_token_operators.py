"""Packing, token files and the BPE transducer against the public libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from odd_tables import ROWS
from tokenizers import Tokenizer

from tablewright.llm import bpe_transducer, packing, token_files
from tablewright.llm.registry import QUERIES, table
from tablewright.llm.tokens import ChunkEncoder
from tablewright.session import scratch_path


def library(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_the_whole_text(spark, sf, name, keeps):
    own, whole = ChunkEncoder(public_tokenizers.path(name), keeps), library(name)
    texts = [t for _, t, *_ in ROWS] + [
        "a  b", " a", "a ", "a\nb", "a \nb", "don't DON'T", " x", "a b", "x\x1cy", "12 34a", "é É ÀÖ", "İ Σας", "...",
        "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|startoftext|> y", "<|EndOfText|> A", "a < b <|endof text|>",
    ] + [r["text"] for r in table(spark, sf, "documents").select("text").collect()[:60]]
    for text in texts:
        assert own.encode(text or "").tolist() == whole(text)


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_fills_every_bin_rightly(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 400)))
    patterns = packing.best_two_fit(dict(counts), 100)
    packed = Counter()
    for lengths, times in patterns:
        assert 0 < sum(k * v for k, v in lengths.items()) <= 100
        for length, n in lengths.items():
            packed[length] += n * times
    assert packed == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in patterns) <= -(-total // 100) * 1.12 + 1


def test_two_replace_the_smallest_when_they_fit_tighter():
    # Greedy takes 70 and 20; the 20 gives way to 18 and 12, which fill the gap of 30.
    patterns = packing.best_two_fit({70: 1, 20: 1, 18: 1, 12: 1}, 100)
    assert ({70: 1, 18: 1, 12: 1}, 1) in patterns


def check_packing(rows, documents):
    whole, ids = library("byte_bpe_50k.json"), defaultdict(list)
    for doc_id, text in documents:
        ids[doc_id].append(np.array(whole(text) + [0], "<u4"))
    places = defaultdict(list)
    for r in rows:
        assert any(
            zlib.crc32(x[r["start"]: r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(x) for group in ids.values() for x in group)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_of_odd_documents(spark, odd, none):
    rows = packing.pack_documents(odd).collect()
    check_packing(rows, [(r[0], r[1]) for r in ROWS])
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack_documents(none).count() == 0


def test_packing_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    check_packing(QUERIES["op4_best_two_fit"](spark, sf).collect(), docs)


@pytest.mark.parametrize("numbers", [[], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], list(range(0, 70000, 7))])
def test_variable_length_round_trip(numbers):
    control, data = token_files.encode_ranks(np.array(numbers, "<u4"))
    assert token_files.decode_ranks(control, data, len(numbers)).tolist() == numbers
    assert len(control) == -(-len(numbers) // 4)


def check_store(rows, documents):
    whole, start = library("word_bpe_49k.json"), 0
    rows = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in documents), key=lambda d: (d is not None, d or 0))
    wanted = defaultdict(Counter)
    for doc_id, text in documents:
        wanted[doc_id][zlib.crc32(np.array(whole(text) + [2], "<u4").tobytes())] += 1
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        wanted[r["doc_id"]][r["crc"]] -= 1
    assert not any(n for c in wanted.values() for n in c.values())


def test_store_of_odd_documents(spark, odd, none):
    path = scratch_path(spark, "test")
    token_files.write_token_files(odd, path)
    back = token_files.read_token_files(spark, path).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS crc")
    check_store(back.collect(), [(r[0], r[1]) for r in ROWS])
    empty = scratch_path(spark, "test")
    token_files.write_token_files(none, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_store_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    rows = QUERIES["op10_token_files"](spark, sf).withColumnRenamed("ids_crc32", "crc").collect()
    check_store(rows, docs)


@pytest.fixture(scope="module")
def reference():
    ranks = bpe_transducer.read_ranks(public_tokenizers.path(bpe_transducer.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_merges_on_random_bytes(reference):
    ranks, whole = reference
    machine, rng = bpe_transducer.Transducer(ranks), random.Random(7)
    cases = [bytes(rng.choice(b"aaabbc theing\xc3\xa9\xe4\xb8\xad019") for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    cases += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    cases += [b"a" * 900, b" " * 300, b"ab" * 200, "é".encode() * 100]
    for data in cases:
        assert machine.encode(data) == whole._core_bpe.encode_single_piece(data)


def test_forgetting_changes_no_ids(reference, monkeypatch):
    ranks, whole = reference
    monkeypatch.setattr(bpe_transducer, "TRANSITIONS", 50)
    monkeypatch.setattr(bpe_transducer, "WORDS", 5)
    own = bpe_transducer.Encoder(public_tokenizers.path(bpe_transducer.VOCABULARY))
    text = ROWS[8][1][:4_000]
    assert own.encode(text).tolist() == whole.encode_ordinary(text)


def test_decoder_carries_characters_over_chunks(reference):
    ranks, whole = reference
    text = "é中\U0001f600 " * 50
    for chunk in (1, 2, 3, 7):
        assert bpe_transducer.Decoder(ranks, chunk).decode(whole.encode_ordinary(text)) == text
    assert [bpe_transducer.utf8_tail(x) for x in (b"", b"a", b"\xc3", b"\xe4\xb8", b"\xe4\xb8\xad", b"\xf0\x9f\x98")] == [0, 0, 1, 2, 0, 3]
    lone = [ranks[b"\xc3"]]
    assert bpe_transducer.Decoder(ranks).decode(lone) == "�"


def check_bpe(rows, documents, whole):
    wanted = Counter()
    for doc_id, text in documents:
        ids = whole.encode_ordinary(text or "")
        wanted[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in rows) == wanted


def test_bpe_query(spark, sf, reference):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    check_bpe(QUERIES["op7_bpe_transducer"](spark, sf).collect(), docs, reference[1])


def test_bpe_of_odd_documents(spark, odd, none, reference):
    rows = bpe_transducer.decode(bpe_transducer.encode(odd)).collect()
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in rows) == Counter(
        (d, t or "", tuple(reference[1].encode_ordinary(t or ""))) for d, t, *_ in ROWS)
    assert bpe_transducer.decode(bpe_transducer.encode(none)).count() == 0


def test_a_word_is_remembered_without_its_marks():
    text = "so alpha, alpha. été! x\nbeta; beta"
    plain = ChunkEncoder(public_tokenizers.path(packing.VOCABULARY), keeps_space=True)
    assert plain.encode(text).tolist() == plain.whole.encode(text, add_special_tokens=False).ids
    machine = bpe_transducer.Encoder(public_tokenizers.path(bpe_transducer.VOCABULARY))
    ids = machine.encode(text)
    for encoder in (plain, machine):
        assert {"alpha", "alpha,", "été"} <= set(encoder.after_blank) and "beta" in encoder.first
    assert bpe_transducer.Decoder(machine.machine.ranks).decode(ids.tolist()) == text
    assert machine.encode("so alpha, alpha.").tolist() == [
        i for part in ("so", " alpha", ",", " alpha", ".") for i in machine.machine.encode(part.encode())]
