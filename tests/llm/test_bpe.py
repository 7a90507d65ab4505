import os
import random

import pytest

bpe = pytest.importorskip("quernstone.llm.bpe")
PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def merges(model, piece):
    """Plain byte-pair merging: the lowest rank first, the leftmost on ties."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, k = min((model.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [model.ranks[p] for p in parts]


def brute(model, text):
    import regex

    return [i for p in regex.findall(bpe.PATTERN, text) for i in merges(model, p.encode())]


ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "。", "12", "!", "…", " ", "　", "ing", "<|endoftext|>", "​", "aaaa", "ก็", "🧭", "nn", "\r\n", "ß", "ا"]


def test_against_merges():
    model, rnd = bpe.tokenizer(PATH), random.Random(9)
    for _ in range(3000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 16)))
        assert model.ids(text) == brute(model, text), repr(text)


def test_long_pieces_without_spaces():
    model, rnd = bpe.tokenizer(PATH), random.Random(1)
    for text in ("a" * 3000, "ab" * 900, "".join(rnd.choice("abcdeé日") for _ in range(2500))):
        ids = model.ids(text)
        assert ids == brute(model, text)
        assert b"".join(model.tokens[i] for i in ids).decode() == text


def test_library_agrees_on_corpus(spark):
    tiktoken = pytest.importorskip("tiktoken")
    model = bpe.tokenizer(PATH)
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs).collect()}
    assert got == {k: lib.encode_ordinary(t) if t else [] for k, t in texts.items()}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "", "x"), (3, "<|endoftext|>", None)], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), list(r.ids)) for r in bpe.encode(df).collect())
    model = bpe.tokenizer(PATH)
    assert [g[1] for g in got] == [[], [], [], model.ids("<|endoftext|>"), model.ids("a b")]
    assert len(model.ids("<|endoftext|>")) > 1
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    counted = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df.filter("doc_id IS NOT NULL"), keep=("ids",)).collect()}
    assert counted == {1: 0, 2: 0, 3: len(model.ids("<|endoftext|>"))}


def test_compatible_pairs_are_what_merges_keep():
    model, rnd = bpe.tokenizer(PATH), random.Random(3)
    tokens = sorted(model.ranks.values())
    for _ in range(3000):
        a, b = rnd.choice(tokens[:4000]), rnd.choice(tokens[:4000])
        assert model.compatible(a, b) == (merges(model, model.tokens[a] + model.tokens[b]) == [a, b])
