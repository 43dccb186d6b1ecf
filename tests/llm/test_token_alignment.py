"""Token alignment against a plain computation over byte offsets."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shoplens.llm.token_alignment import BYTE_VOCABULARY, PIECE_VOCABULARY, align_tokenizers, byte_alphabet, token_alignment, tokenizers_of
from tests.llm.conftest import AWKWARD, frame

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path(BYTE_VOCABULARY))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_VOCABULARY))


def spelled(models, text):
    """(id, bytes) of every token of both sides."""
    a, b = models
    alphabet = byte_alphabet()
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def groups_of(left, right):
    def ends(tokens):
        at, found = 0, []
        for _, raw in tokens:
            at += len(raw)
            found.append(at)
        return found

    ends_a, ends_b = ends(left), ends(right)
    common = sorted(set(ends_a) & set(ends_b))
    groups, first = [], 0
    for last in common:
        groups.append([[i for (i, _), e in zip(tokens, own) if first < e <= last] for tokens, own in ((left, ends_a), (right, ends_b))])
        first = last
    return groups


def brute_force(models, rows):
    made = []
    for i, text, *_ in rows:
        left, right = spelled(models, text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        fits = text and b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
        made.append((i, left, right, groups_of(left, right)) if fits else (i, [], [], []))
    docs, links = Counter(), []
    for _, _, _, groups in made:
        own = [(a, b) for ga, gb in groups for a in ga for b in gb]
        links.append(own)
        docs.update(set(own))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    found = []
    for (i, left, right, groups), own in zip(made, links):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        found.append((i, len(left), len(right), len(groups), len(own), sum(docs[p] == most[p[0]] for p in own), sum(docs[p] for p in own), digest))
    return found, docs


ROWS = [r for r in AWKWARD if r[0] not in (9, 10)] + [
    (30, "already ▁ marked", "en", "s"),
    (31, "<s> <unk> </s> <0x41> <|endoftext|>", "en", "s"),
    (32, "\x00\x01 tab\tnew\nline\r\n  two  spaces   　", "en", "s"),
    (33, "xyz" * 900 + " \U0001f468‍\U0001f469‍\U0001f467 क्षि é", "en", "s"),
    (34, " leading and trailing ", "en", "s"),
]


@pytest.mark.parametrize("chunk", [1, 10_000_000])
def test_equals_brute_force(spark, models, chunk):
    docs = frame(spark, ROWS)
    done, table = align_tokenizers(docs, pairs_per_chunk=chunk)
    expected, counts = brute_force(models, ROWS)
    assert done.columns == COLUMNS
    assert sorted(map(tuple, done.collect()), key=str) == sorted(expected, key=str)
    found = table.collect()
    assert {(r["a"], r["b"]): r["docs"] for r in found} == counts
    most = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    assert all(r["best"] == (r["docs"] == most[r["a"]]) for r in found)


def test_equals_brute_force_on_the_sample(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    expected, _ = brute_force(models, [tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, token_alignment(docs).collect())) == sorted(expected)


def test_nothing(spark, nothing):
    assert token_alignment(nothing).collect() == []
    empty = token_alignment(frame(spark, [(1, None, None, None), (2, "", None, None)])).collect()
    assert sorted(map(tuple, empty)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_ranks_give_the_ids_of_the_vocabulary(models):
    fast, _ = tokenizers_of(None, None)
    for start in range(0, 0x30000, 0x1000):
        points = [p for p in range(start, start + 0x1000, 7) if not 0xD800 <= p < 0xE000]
        texts = [f"ab{chr(p)}{chr(p)}1  {chr(p)}b {chr(p)} 's" for p in points]
        expected = [x.ids for x in models[0].encode_batch([" " + x for x in texts], add_special_tokens=False)]
        assert fast.ids([x.encode() for x in texts]) == expected
