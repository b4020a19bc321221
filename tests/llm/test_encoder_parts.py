"""The packing encoder gives the model only parts of words that it has not met."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from graincart.llm import packing
from graincart.llm.common import TOKENIZER


class Watched:
    def __init__(self, bare):
        self.bare, self.given = bare, []

    def encode_batch_fast(self, texts, **how):
        self.given += [w for t in texts for w in t.split()]
        return self.bare.encode_batch_fast(texts, **how)


def test_only_new_parts_go_to_the_model():
    path = str(public_tokenizers.path(TOKENIZER))
    encoder, whole = packing.Encoder(path, remembered=20), Tokenizer.from_file(path)
    encoder.bare = Watched(encoder.bare)
    texts = ["alpha beta 7", "alpha, (beta) 77", "Alpha beta--alpha, it's", "'' ''s 's beta's", "alpha beta's"]
    for text in texts * 2:
        assert encoder.encode([text]) == [np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    encoder, seen = packing.Encoder(path), []
    encoder.bare = Watched(encoder.bare)
    for text in texts:
        encoder.encode([text])
        seen.append(sorted(encoder.bare.given))
        encoder.bare.given = []
    assert seen == [["7", "alpha", "beta"], ["(", ")", ","], ["'s", "--", "it"], ["''", "s"], []]
