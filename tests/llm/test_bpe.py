import random

import pytest

from webloom.llm.bpe import WordBpe, encode_documents, vocabulary

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def expected(texts):
    t = tokenizers.Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        yield ids, t.decode(ids, skip_special_tokens=False)


def corpus():
    r = random.Random(1)
    texts = [None, "", " ", "It's WE'LL they'd 'tis 42nd ½ ² Ⅷ", "<|endoftext|>a<|startoftext|> <|x|>", "ΟΔΟΣ İstanbul ǅ ẞ", "é é 한글 가", "😀😃 a😀b   x​y\x1c\x85z", "a" * 5000, "the " * 2000, "!!!???--- $$$ %%%"]
    for _ in range(300):
        texts.append("".join(r.choice(["th", "in", "ing", "er", "qu", "ß", "é", "x", "zz", " ", "'s", "1", "-", "A", "\n", "😀", "한"]) for _ in range(r.randint(1, 60))))
    return texts


def test_matches_library(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: (list(memoryview(bytes(r.ids)).cast("I")), r.decoded) for r in encode_documents(df, vocabulary()).collect()}
    for i, want in enumerate(expected(texts)):
        assert got[i] == want, texts[i]


def test_trie_equals_plain_merges():
    bpe = WordBpe(vocabulary())
    r = random.Random(2)
    words = sorted({"".join(r.choices("abcdeinorst", k=r.randint(1, 14))) for _ in range(3000)})
    assert bpe.encode_words(words) == [bpe.merged([*w[:-1], w[-1] + bpe.end]) for w in words]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    assert encode_documents(df, vocabulary()).count() == 3
    assert encode_documents(df.limit(0), vocabulary()).count() == 0


def test_every_code_point_and_marks():
    r = random.Random(3)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    low = [c for c in every if c < 0x3000]
    texts = ["".join("a" + chr(c) + " " for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    texts += ["".join(chr(r.choice(low)) for _ in range(r.randint(1, 12))) for _ in range(8000)]
    texts.append("α᳣࡙͍ᫌ")
    got = ((list(memoryview(ids).cast("I")), text) for ids, text in WordBpe(vocabulary()).encode(texts))
    assert all(g == w for g, w in zip(got, expected(texts), strict=True))


def test_cache_keeps_its_younger_half(monkeypatch):
    monkeypatch.setattr("webloom.llm.bpe._CACHED_WORDS", 50)
    bpe = WordBpe(vocabulary())
    batches = [[f"word{i} same <|endoftext|> x{i}" for i in range(a, a + 10)] for a in range(0, 100, 10)]
    for batch in batches:
        assert [(list(memoryview(ids).cast("I")), text) for ids, text in bpe.encode(batch)] == list(expected(batch))
    assert 0 < len(bpe.cache) <= 100


def test_long_text_and_result_names(spark):
    df = spark.createDataFrame([(1, "long words " * 200_000)], "doc_id long, text string")
    assert len(encode_documents(df, vocabulary()).first().ids) == 4 * 400_000
    with pytest.raises(ValueError):
        encode_documents(df.selectExpr("*", "1 as ids"), vocabulary(), keep=["ids"])
