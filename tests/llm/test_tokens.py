import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import tokens

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OURS = tokens.Encoder(memo=40)
TEXT = st.one_of(
    st.text(st.sampled_from("aB1é× .,…'!\n\t\0\xa0　\U0001f600³s"), max_size=30),
    st.lists(st.sampled_from(["the", "don't", "x,", "y.", "3.14", "..", ",", "a\nb", "", "<|endoftext|>", "Ünï,"]), max_size=20).map(" ".join),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_ids_equal_the_library_s(texts):
    ids, lengths = OURS.encode_many(pa.array(texts, pa.string()))
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(x) for x in want]
    assert ids.tolist() == [x for y in want for x in y]


def test_long_and_odd_texts():
    for text in ("word, and other. words " * 60, ("a  b c " * 80).strip(), "x" * 500, "y" + " y" * 300, "q\n" * 200, "é, ×, ÷. ß.\nÀ,", "\u2003x y\u3000", "…. a‘, b—. c"):
        assert OURS.encode(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_apostrophes_before_words_against_a_fresh_tokenizer():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("'start", "'second half", "a line\n'start again", "'street 'street", "'responses,\n'though.", "(start", "-x\n1abc"):
        assert OURS.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_strings_of_special_tokens_get_their_ids():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a\n<|endoftext|>", "a<|endoftext|><|endoftext|>b.", "<|endoftext|", "|> x", "plain words <|endoftext"]
    ids, lengths = tokens.Encoder().encode_many(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for y in want for x in y] and lengths.tolist() == [len(x) for x in want]
    assert want[1] == [64, 220, 50256, 275] and want[4] == library.encode("<|endoftext|", add_special_tokens=False).ids


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_words_with_one_hash_keep_their_own_ids(monkeypatch):
    # the two words of a length have equal hashes under any polynomial modulo 2**64
    for n in (8, 16, 512, 1024, 2048, 4096):
        texts = ["x " + thue_morse(n), "x " + thue_morse(n, "b", "a"), thue_morse(n, "b", "a") + ", y"]
        for fresh in (OURS, tokens.Encoder()):
            ids, lengths = fresh.encode_many(pa.array(texts))
            assert ids.tolist() == [i for t in texts for i in PLAIN.encode(t, add_special_tokens=False).ids]
    # any two words may share a hash: all of them here
    monkeypatch.setattr(tokens.Texts, "hashes", lambda self, starts, ends, **_: (ends - starts).astype("uint64") * 0 + 7)
    fresh, texts = tokens.Encoder(), ["one", "alpha beta", "longer-than-eight longer-than-eighT", "beta", "longer-than-eight"]
    for _ in range(2):
        ids, lengths = fresh.encode_many(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in PLAIN.encode(t, add_special_tokens=False).ids]


def test_only_unusual_white_space_is_odd():
    from weftline.llm.shared import Texts

    texts = ["plain, é text.\nMore", "two  spaces", "", " lead", "trail ", "a\tb", "a\xa0b", "x\u3000y", "a…b — c"]
    assert OURS._odd(Texts(pa.array(texts))).tolist() == [False, True, False, True, True, True, True, True, False]


def test_nulls_and_no_rows():
    ids, lengths = OURS.encode_many(pa.array([None, "a", ""], pa.string()))
    assert lengths.tolist() == [0, 1, 0] and len(ids) == 1
    assert len(OURS.encode_many(pa.array([], pa.string()))[0]) == 0


def test_crc32():
    import struct
    import zlib

    ids = OURS.encode("some words here")
    assert tokens.crc32(ids) == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids.tolist()))
