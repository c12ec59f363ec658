import hashlib
import random
import struct

import public_tokenizers
import pytest
from tables import documents  # noqa: F401
from tokenizers import Tokenizer

from lanternfish.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world's  tab\tend ", "a<|endoftext|> b<|endoftext|>", "naïve ÀÉÎ \U0001f600 \U0001f468‍\U0001f469 ß ſ",
    "x" * 3000, "ab" * 2000, "1234567890" * 30, "don't we'll I'VE", "\x1c\x1f\x85  　", "٣٤ 中文 हिन्दी", "՘ࢅ࢏꟏\U0003fc3b ok",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    vocabulary = bpe.vocabulary_at(PATH)
    words = [b" the", b" then", b" thing", b" in", b" ending", b"sending"]
    return bpe.Encoder(vocabulary, bpe.Lexicon(bpe.compile_lexicon({w: vocabulary.merged(w) for w in words})), remembered=50)


def test_same_ids_as_the_library(encoder, library):
    rng = random.Random(2)
    odd = ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(400)]
    mixed = ["".join(rng.choice(" \n'tsabcdeé1,.中<|endoftext|>") for _ in range(200)) for _ in range(200)]
    for text in [t or "" for t in TEXTS] + odd + mixed:
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text)
        assert got == want, text[:80]
        assert encoder.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_automaton_holds_its_words_and_shares_suffixes():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(300)]
    words = {(s + e).encode(): [k, len(e)] for k, s in enumerate(stems) for e in ("ation", "ing", "")}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert lexicon.n_words == len(words)
    assert all(lexicon.find(w) == struct.pack("<2i", *ids) for w, ids in words.items())
    assert lexicon.find(b"zzz") is None and lexicon.find(stems[0][:3].encode()) is None and lexicon.find(b"") is None
    plain = {stems[k].encode() for k in range(300)}
    assert lexicon.n_states < sum(map(len, plain)) + 20  # endings are held once
    assert bpe.Lexicon(bpe.compile_lexicon({})).find(b"a") is None


def test_latin_texts_are_split_alike():
    rng = random.Random(6)
    texts = ["".join(chr(rng.randrange(rng.choice([0x80, 0x100, bpe.LATIN_END]))) for _ in range(60)) for _ in range(2000)]
    texts += ["".join(rng.choice(" \n'sretdlvm.1²\xa0é") for _ in range(60)) for _ in range(2000)]
    assert all(bpe.LATIN_WORD.findall(t) == bpe.WORD.findall(t) for t in texts)


def test_long_and_short_merges_agree():
    vocabulary = bpe.vocabulary_at(PATH)
    rng = random.Random(9)
    for _ in range(200):
        ids = [vocabulary.of_byte[b] for b in "".join(rng.choice("ationsthe ") for _ in range(60)).encode()]
        assert vocabulary._merged_short(list(ids)) == vocabulary._merged_long(list(ids))


def test_documents(documents, library):  # noqa: F811
    docs = documents([(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (4, "again"), (4, "again")])
    rows = bpe.encode(docs, PATH, 50).collect()
    assert len(rows) == len(TEXTS) + 3
    by_id = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(TEXTS):
        if i != 4:
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert by_id[i]["ids"] == ids and by_id[i]["n_tokens"] == len(ids)
            assert by_id[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
            assert by_id[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(docs.where("false"), PATH).count() == 0


def test_frequent_words_are_counted_over_all_texts(documents):  # noqa: F811
    docs = documents([(1, "a big dog and a big cat"), (2, "see a big dog"), (3, None)])
    assert bpe.frequent_words(docs, 3) == [" big", " a", " dog"]
