"""Properties that hold for any text."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from gridmend.llm import minhash_dedup as mh
from gridmend.llm import sentencepiece_viterbi as sp
from gridmend.llm import token_counts as tc

CODEC = sp.Codec.of(sp.Model.read())
LIBRARY = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TEXT = st.text(st.characters(blacklist_categories=("Cs",)), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(text):
    ids = CODEC.encode(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert CODEC.decode(ids) == text.replace("▁", " ") or "▁" in text


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_token_counts_are_the_librarys(text):
    counter = tc.TokenCounter.of(tc.read_tokenizer())
    assert counter.count(text, {}) == counter.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=40).filter(str.strip), min_size=2, max_size=6))
def test_signatures_don_t_depend_on_company(texts):
    sets = [mh.shingles(t.encode().split()) for t in texts]
    together = mh.signatures(sets)
    for one, row in zip(sets, together, strict=True):
        assert (mh.signatures([one])[0] == row).all()
        assert mh.similar(one, one) == 1.0
    assert mh.bands(together).shape == (len(texts), mh.BANDS) and np.isfinite(together).all()
