"""Operators 1 and 8: byte-level BPE, token trees under edits, packing."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentimill.llm import packing, queries, token_trees
from sentimill.llm.bpe import encoder, pieces
from sentimill.llm.packing import assemble, document_pieces, pack_documents, pack_histogram
from sentimill.llm.token_trees import TokenTree, edited_by_log, edited_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF_DIR = "/root/testdata/sf0.001"

TEXT = st.lists(
    st.sampled_from(["a", "bc", " ", "  ", "\n", "\t", "'", "s", "'re", "1", "é", "中", "　", "!", "\r", "x y", "<|endoftext|>"]),
    max_size=25,
).map("".join)


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: found.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_ids_are_those_of_the_tokenizer(reference, text):
    assert "".join(pieces(text)) == text
    assert np.frombuffer(encoder().ids(text), "<u4").tolist() == reference(text)
    assert sum(encoder().counts(pieces(text))) == len(reference(text))


def test_ids_of_documents(documents, reference):
    for row in documents.select("text").collect():
        assert np.frombuffer(encoder().ids(row["text"]), "<u4").tolist() == reference(row["text"])


# ------------------------------------------------------------------ token trees


@settings(max_examples=300, deadline=None)
@given(text=TEXT, edits=st.lists(st.tuples(st.integers(-2, 40), st.integers(-1, 12), TEXT), max_size=6))
def test_edits_against_counting_again(reference, text, edits):
    leaf, split = token_trees.LEAF, token_trees.SPLIT
    token_trees.LEAF, token_trees.SPLIT = 2, 5
    try:
        tree = TokenTree.of(text, encoder())
        for start, length, replacement in edits:
            at = min(max(start, 0), len(text))
            text = text[:at] + replacement + text[min(at + max(length, 0), len(text)) :]
            tree.replace(start, length, replacement)
            chars, sums = tree.node_sums()
            assert tree.text() == text and tree.n_chars == len(text) and tree.n_tokens == len(reference(text))
            assert all(sums[i] == sums[2 * i] + sums[2 * i + 1] for i in range(1, len(sums) // 2))
    finally:
        token_trees.LEAF, token_trees.SPLIT = leaf, split


def test_a_line_break_that_meets_another_white_character(reference):
    for text, at, length in (("ab cd.\nReer", 2, 4), ("ab\ncd", 2, 0), ("a b\nc\n d", 1, 2)):
        tree = TokenTree.of(text, encoder())
        tree.replace(at, length, " ")
        assert tree.n_tokens == len(reference(text[:at] + " " + text[at + length :]))


def test_an_edit_encodes_little():
    random.seed(1)
    text = " ".join("".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(20_000))
    tree = TokenTree.of(text, encoder())
    tree.replace(50_000, 10, "other words")
    assert tree.counted < 100 and tree.text() == text[:50_000] + "other words" + text[50_010:]


def test_query_1_against_brute_force(spark, documents, reference):
    got = {r["doc_id"]: r for r in queries.op1_edit_aware_token_counts(spark, SF_DIR).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        text, n = r["text"], len(r["text"])
        edited = text[: n // 3] + text[n // 3 + 20 :]
        at = min(2 * n // 3, len(edited))
        edited = "New: " + (edited[:at] + f"[edit of {r['doc_id']}]\n" + edited[at:])[5:]
        mine = got[r["doc_id"]]
        assert (mine["n_tokens"], mine["edited_tokens"]) == (len(reference(text)), len(reference(edited)))
        assert (mine["n_chars"], mine["edited_chars"], mine["n_edits"]) == (n, len(edited), 3)


def test_edits_from_a_table_and_odd_rows(spark, odd, empty):
    trees = token_trees.token_trees(odd)
    edits = spark.createDataFrame(
        [(1, 2, 0, 3, "A"), (1, 1, 0, 0, "zz "), (9, 1, 0, 0, "q"), (None, None, None, None, "n"), (2, 1, 99, 5, None)],
        "doc_id long, seq long, start long, length long, replacement string",
    )
    got = edited_by_log(trees, edits).collect()
    assert len(got) == odd.count()
    assert sorted(r["edited_text"] for r in got if r["doc_id"] == 1)[0].startswith("AThe") is True
    assert sorted(r["edited_text"] for r in got if r["doc_id"] is None) == ["n", "na text without a number"]
    assert [r["edited_text"] for r in got if r["doc_id"] == 2] == [""]
    untouched = edited_counts(trees, F.lit(None)).collect()
    assert all(r["n_tokens"] == r["edited_tokens"] and r["encoded_chars"] == 0 for r in untouched)
    assert token_trees.token_trees(empty).count() == 0 and edited_by_log(token_trees.token_trees(empty), edits).count() == 0


# ---------------------------------------------------------------------- packing


@settings(max_examples=200, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_patterns_hold_every_piece(counts):
    placed = Counter()
    for pattern, n in pack_histogram(counts, 32):
        assert sum(pattern) <= 32 and n > 0
        for length in pattern:
            placed[length] += n
    assert placed == Counter(counts)


def check_packed(rows, texts, reference, limit=1024):
    """Every id in one piece, sequences without gaps or overlaps."""
    pieces_of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces_of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in texts.items():
        ids = [*reference(text or ""), 0]
        at = 0
        for r in sorted(pieces_of.pop(doc_id), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces_of
    fills = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limit
        fills.append(at)
    return fills


def test_query_8_against_brute_force(spark, documents, reference):
    rows = queries.op8_shortest_pack_first(spark, SF_DIR).collect()
    fills = check_packed(rows, {r["doc_id"]: r["text"] for r in documents.collect()}, reference)
    padding = sum(1024 - n for n in fills if n & (n - 1))
    assert padding < 0.02 * sum(fills)


def test_sequences(documents):
    packed = pack_documents(documents.limit(40), max_length=64, with_ids=True)
    whole = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in packed.collect()}
    for r in assemble(packed, 64).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 64)
        for (sequence, offset), ids in whole.items():
            if sequence == r["sequence_id"]:
                assert bytes(r["ids"])[4 * offset : 4 * offset + len(ids)] == ids
        assert not any(bytes(r["ids"])[4 * n :])


def test_packing_odd_rows(odd, empty, reference, monkeypatch):
    monkeypatch.setattr(packing, "chunk_count", lambda n: 7)
    rows = pack_documents(odd).collect()
    assert sum(r["length"] for r in rows) == sum(len(reference(r["text"] or "")) + 1 for r in odd.collect())
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert pack_documents(empty).count() == 0 and document_pieces(empty).count() == 0
