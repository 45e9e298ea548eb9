"""Token alignment against both libraries on whole texts."""

import hashlib
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
from odd_tables import ROWS
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tablewright.llm import token_alignment
from tablewright.llm.registry import QUERIES, table
from tablewright.llm.tokens import _byte_letters


class Plain:
    """Whole texts, bytes only, every pair of tokens compared by its byte range."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.letters = {c: b for b, c in _byte_letters().items()}

    def tokens(self, text):
        if not text:
            return None
        found = self.a.encode(" " + text, add_special_tokens=False)
        a = [(n, bytes(self.letters[c] for c in t)) for n, t in zip(found.ids, found.tokens)]
        b = [(n, bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode())
             for n, p in zip(self.b.encode(text), self.b.encode(text, out_type=str))]
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return None
        return a, b

    def row(self, text):
        made = self.tokens(text)
        if made is None:
            return (0, 0, 0, 0, ""), []
        spans = []
        for side in made:
            at, out = 0, []
            for n, piece in side:
                out.append((n, at, at + len(piece)))
                at += len(piece)
            spans.append(out)
        both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        parts = [[[] for _ in both] for _ in spans]
        for out, side in zip(parts, spans):
            for n, _, e in side:
                out[bisect_left(both, e)].append(str(n))
        text = ["|".join(",".join(side[k]) for side in parts) for k in range(len(both))]
        links, low = [], 0
        for n, s, e in spans[0]:
            while spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((n, spans[1][k][0]))
                k += 1
        digest = hashlib.sha256(";".join(text).encode()).hexdigest()
        return (len(spans[0]), len(spans[1]), len(both), len(links), digest), links


def expected(documents):
    plain = Plain()
    known = {text: plain.row(text) for _, text in documents}
    rows = [(doc_id, *known[text]) for doc_id, text in documents]
    counts, best = Counter(), Counter()
    for _, _, links in rows:
        counts.update(set(links))
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return Counter(
        (doc_id, *base[:4], sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), base[4])
        for doc_id, base, links in rows)


def rows_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


ODD = [
    " leading", "trailing ", "two  blanks   three", "\nnew\n\nlines \n x", "tab\tand\r\nreturn;\r\n", "a b c　d", "x▁y and ▁ z",
    "<s> </s> <unk> <0x41> <|endoftext|>", "é中😀 naïve 🇩🇪 👩‍👩‍👧", "ﬁ ① ½ Å é ẛ̣", "\x00\x01 \x1c x\x1dy", "word" * 300,
    "  ", " ", "﻿bom", "𝕬𝖇𝖈 ሀሁ ไทย", "12 345 678,9", "don't we'll I'M", "​ zero ‍", "!!! ??? ... ))) \r\r",
]


@pytest.mark.parametrize("text", ODD)
def test_chunks_are_those_of_the_whole_text(text):
    own = token_alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    made = own.describe([text])
    base, links = Plain().row(text)
    assert (*made["counts"][0], made["digests"][0]) == base
    pairs = Counter(a * own.b_size + b for a, b in links)
    assert dict(zip(made["keys"].tolist(), made["times"].tolist())) == pairs


def test_cuts_refine_coarse_spans():
    whole = " é😀x".encode()
    pieces = [b" \xc3", b"\xa9\xf0", b"\x9f", b"\x98\x80x"]
    # Spans of characters that tokens share, empty spans of fallback bytes, and spans that fit.
    assert token_alignment.cuts([3, 7, 7, 8], pieces, whole) == [2, 4, 5, 8]
    assert token_alignment.cuts([0, 0, 0, 8], pieces, whole) == [2, 4, 5, 8]
    assert token_alignment.cuts([2, 4, 5, 8], [b" \xc3", b"\xa9\xf0", b"\x9e", b"\x98\x80x"], whole) is None
    assert token_alignment.cuts([3, 7, 7], pieces[:3], whole) is None


def test_links_overlap():
    groups, links = token_alignment.groups_and_links([2, 5, 6], [1, 2, 6])
    assert links == [(0, 0), (0, 1), (1, 2), (2, 2)]
    assert groups == [(slice(0, 1), slice(0, 2)), (slice(1, 3), slice(2, 3))]


@pytest.mark.parametrize("pairs", [0, 40, 1 << 21])
def test_odd_documents(spark, odd, none, pairs):
    documents = [(r[0], r[1]) for r in ROWS]
    assert rows_of(token_alignment.align_corpus(odd, pairs=pairs)) == expected(documents)
    assert token_alignment.align_corpus(none, pairs=pairs).count() == 0


def test_forgetting_and_slices_change_nothing(spark, odd, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNKS", 3)
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", 50)
    own = token_alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r[1] or "" for r in ROWS if len(r[1] or "") < 1000]
    assert [x for part in token_alignment.text_slices(texts) for x in own.describe(texts[part])["digests"]] == [
        Plain().row(t)[0][4] for t in texts]


def test_query(spark, sf):
    documents = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert rows_of(QUERIES["op11_token_alignment"](spark, sf)) == expected(documents)
