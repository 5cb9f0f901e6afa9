import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tiktoken")
from arborgrid.llm import chunk, encode, pack
from arborgrid.llm import vocabulary as V

ALPHABET = ["a", "th", "ing", " ", "  ", "\n", "\n\n", "'s", "'", "9", "12", "!", "?..", "é", "漢字", "。", "\t", "🙂", " ", "<|endoftext|>", "́", "word "]


@pytest.fixture(scope="module")
def voc():
    return V.load(V.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), min_size=1, max_size=6))
def test_joined_parts_equal_the_whole(parts):
    voc = V.load(V.vocabulary_path())
    assert voc.join_all([(p, voc.encode_part(p)) for p in parts])[1] == voc.encode_part("".join(parts))


@pytest.mark.parametrize("text", ["a" * 40000, " " * 30000 + "x", "漢" * 20000, "ab!" * 12000, "".join(random.Random(1).choices("abcdefgh", k=50000)), "\n" * 20000, "word " * 8000])
def test_long_texts(voc, text):
    assert voc.encode(text) == voc.encode_part(text)


def test_against_the_other_library(voc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(V.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", "Hello  world's <|endoftext|>", "été 漢字 🙂", "x" * 3000 + "\n\n 12"]
    assert [voc.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_corpus_edge_cases(spark, voc):
    long = "".join(random.Random(2).choices(ALPHABET, k=6000))
    rows = [(1, None, 5), (2, "", 5), (3, "  ", 5), (4, "a<|endoftext|>b", 5), (5, long, 5), (5, long, 5), (6, "dup", 1), (6, "dup", 2), (None, "no id", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")  # a clashing extra column
    got = encode.encode_corpus(df, long_chars=500).collect()
    want = sorted(((r[0] or -1), voc.encode(r[1])) for r in rows)
    assert sorted(((r["doc_id"] or -1), list(r["ids"])) for r in got) == want
    counts = encode.token_counts(df, long_chars=500).collect()
    assert sorted(((r[0] or -1), r[1]) for r in counts) == sorted((i, len(t)) for i, t in want)
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_pieces_keep_the_limit_and_the_text(voc):
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.random() ** 3 for _ in ALPHABET]
        text = "".join(rng.choices(ALPHABET, w, k=rng.randint(20, 200)))
        limit, overlap = rng.choice([(16, 0), (24, 8), (40, 3)])
        pieces = chunk.split_text(voc, text, limit, overlap)
        assert bool(pieces) == (len(voc.encode(text)) > limit)
        pos = 0
        for i, (a, b, tokens, shared, _) in enumerate(pieces):
            assert len(voc.encode(text[a:b])) <= limit and tokens <= limit and shared <= overlap
            assert a <= pos < b and (i > 0 or a == 0)
            pos = b
        assert not pieces or pos == len(text)


def test_pieces_end_at_paragraphs(voc):
    text = "\n\n".join("One sentence here. Another one follows it." for _ in range(40))
    kinds = [chunk.KINDS[p[4]] for p in chunk.split_text(voc, text, 64, 8)]
    assert kinds[-1] == "end" and set(kinds[:-1]) == {"paragraph"}


def test_split_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short", "x"), (None, "w " * 600, "x"), (4, "w " * 600, "x"), (4, "w " * 600, "x")], "doc_id long, text string, piece string")
    got = chunk.split_oversized(df).collect()
    assert {r["doc_id"] for r in got} == {None, 4} and sum(r["piece"] == 0 for r in got) == 3
    assert chunk.split_oversized(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, None, 1, 5, 40, 100, 101, 250]), 1) for i in range(500)] + [(7, 60, 1), (7, 60, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n int, part int")
    got = [r.asDict() for r in pack.pack(df, "doc_id", "n", len(rows), capacity=100, shard_items=200).collect()]
    assert sum(r["size"] for r in got) == sum(r[1] or 0 for r in rows)
    assert sum(r["part"] == 0 for r in got) == len(rows)
    fill: dict = {}
    for r in sorted(got, key=lambda r: (r["container"], r["offset"])):
        assert r["size"] == 0 or r["offset"] == fill.get(r["container"], 0)
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        assert fill[r["container"]] <= 100 and (r["n_parts"] > 1) == (r["size"] + r["start"] > 100 or r["n_parts"] == 3 or r["n_parts"] == 2)
    assert pack.pack(df.limit(0), "doc_id", "n", 0).count() == 0


def test_packing_wastes_little():
    import numpy as np

    sizes = np.random.default_rng(0).integers(1, 600, 8000)
    bins = pack.sum_of_squares(sizes, 2048)
    used = np.bincount(bins, weights=sizes)
    assert used.max() <= 2048 and len(used) <= -(-sizes.sum() // 2048) + 8
