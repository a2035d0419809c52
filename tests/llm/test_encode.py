import random

import pytest

from quarrylight.llm import encode

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return encode.Vocabulary(open(encode.BYTE_BPE_50K, "rb").read())


@pytest.fixture(scope="module")
def public():
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["ab", "abc \n", "aeiou", "é漢字😀", "lo he", "  \n\t", "0123", "'sreve", "_-=<>", "<|endoftext|>"]
    return ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equal_to_the_public_encoder(vocabulary, public):
    for t in [*texts(600), "a" * 5000 + "ab" * 900, "<|endoftext|>", " ", "\u00a0\u2003x"]:
        assert vocabulary.encode(t) == public.encode_ordinary(t)


def test_every_prefix_has_its_own_encoding(vocabulary, public):
    word = "internationalisation".encode()
    table = vocabulary.last_tokens(word)
    for n in range(1, len(word) + 1):
        assert vocabulary.read(word[:n], table[: n + 1]) == public.encode_ordinary(word[:n].decode())
    assert vocabulary.last_tokens(word, vocabulary.last_tokens(word[:7])) == table


def test_appends_and_edits(vocabulary, public):
    rng, text, held = random.Random(2), "", encode.Encoded(vocabulary)
    for _ in range(300):
        i = len(text) if rng.random() < 0.4 else rng.randrange(len(text) + 1)
        j = min(len(text), i + rng.randrange(4))
        new = "".join(rng.choice("ab 're\n  é") for _ in range(rng.randrange(6)))
        text = text[:i] + new + text[j:]
        held.edit(i, j, new)
        assert held.text == text and held.ids == public.encode_ordinary(text)


def test_rows(spark, public):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "The notebook.", "x"), (4, "The notebook.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_texts(df).collect())
    assert got == [(1, []), (2, []), (3, public.encode_ordinary("  ")), (4, public.encode_ordinary("The notebook.")), (4, public.encode_ordinary("The notebook."))]
    assert encode.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
