"""op6_byte_bpe: words are taken apart by blanks, with the pre-tokens that the pattern gives over the whole text."""

import random

import public_tokenizers as P

from kgspark.llm import bpe


def coder():
    return bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_known_words_are_not_matched_again(monkeypatch):
    own, seen = coder(), []
    monkeypatch.setattr(own, "memo", {})
    monkeypatch.setattr(own, "words", {})

    class Counting:
        def findall(self, text, pattern=own.pattern):
            seen.append(len(text))
            return pattern.findall(text)

    monkeypatch.setattr(own, "pattern", Counting())
    text = "it's said, and said again; " * 1000
    raw = own.encode(text)
    assert sum(seen) < 100 and raw == own.pieces(text)


def test_words_as_over_the_whole_text():
    own, rng = coder(), random.Random(5)
    signs = [" ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "\r\n", "a", "Bc", "é", "中", "٣", "7", "²", "'s", "'", ".", "?!", "-", "_", "\U0001f600", "é", "​"]
    for text in ["", " ", "   ", "a", " a", "a ", "a  b", "a   b ", "x\n y", "x \n y", "'s 's", "a\t \nb"] + ["".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(5000)]:
        assert own.encode(text) == own.pieces(text), repr(text)
        assert own.decode(bpe.np.frombuffer(own.encode(text), "<u4")) == text.encode()


def test_short_and_long_pretokens_merge_alike(monkeypatch):
    own, rng = coder(), random.Random(6)
    words = ["".join(rng.choices("abeinrst", k=rng.randrange(1, 41))).encode() for _ in range(500)]
    short = [own.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [own.merge(w) for w in words] == short
