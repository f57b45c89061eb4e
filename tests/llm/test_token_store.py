import public_tokenizers
from brute import token_rows
from odd_texts import SF, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import numpy as np

from hydrolens.llm import token_store as T

FILE = public_tokenizers.path("word_bpe_49k.json")
SPECIALS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>"]
FULL = Tokenizer.from_file(FILE)


def encode(text):
    return FULL.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from("aZé ñßǰJ̌́　 .,'!\n\x1c1σΣ <|endoftext|>"), st.characters(
    exclude_categories=["Cs"]), st.sampled_from(SPECIALS)), max_size=40).map("".join))
def test_pieces_encode_like_the_whole_text(text):
    got = np.frombuffer(T._coder(FILE, False).encode(text), "<u2").tolist()
    assert got == encode(text)


def test_special_tokens_in_any_case():
    for x in SPECIALS:
        for text in (f"a {x} b", f"É{x}", f"{x}{x.upper()}", f"A{x}Z<|", x):
            assert np.frombuffer(T._coder(FILE, False).encode(text), "<u2").tolist() == encode(text), text


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.uint64)
    sizes, bits = T.build_mph(keys)
    assert sorted(T.mph_slots(sizes, bits, keys)) == list(range(len(keys)))


def test_round_trip(spark, small):
    got = T.op1_token_store(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == token_rows(small, encode)


def test_odd_rows(spark, odd):
    store = T.write_store(odd, FILE, 2, bucket_keys=4)
    got = store.read(store.lookup(store.places())).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = token_rows([r[:2] for r in rows], encode)
    key = lambda r: (r[1], r[2])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == want
    assert sorted(r.copy for r in got if r.doc_id == 5) == [0, 1]


def test_unknown_keys_and_empty(spark, odd, empty):
    store = T.write_store(odd, FILE, 2)
    keys = spark.createDataFrame([(9, 0), (9, 1), (123456, 0)], "doc_id long, copy long")
    assert [(r.doc_id, r.copy) for r in store.lookup(keys).collect()] == [(9, 0)]
    store = T.write_store(empty, FILE, 2)
    assert store.read(store.lookup(store.places())).count() == 0
