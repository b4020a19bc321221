"""The packing encoder looks a part up once however often it occurs, and cuts as the tokenizer does."""

from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from graincart.llm import packing
from graincart.llm.common import TOKENIZER


class Counted(dict):
    lookups = 0

    def get(self, *of):
        self.lookups += 1
        return super().get(*of)


def _ids(tokenizer, texts):
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_repeats_are_not_looked_up_again():
    path = str(public_tokenizers.path(TOKENIZER))
    encoder, texts = packing.Encoder(path), ["Alpha, beta (7) it's ALPHA. " * 200] * 5
    encoder.young = Counted()
    assert encoder.encode(texts) == _ids(Tokenizer.from_file(path), texts)
    assert encoder.young.lookups == len(["alpha", ",", "beta", "(", "7", ")", "it", "'s", "."])


def test_parts_are_cut_as_the_tokenizer_cuts():
    path = str(public_tokenizers.path(TOKENIZER))
    whole = Tokenizer.from_file(path)
    texts = ["".join(cs) for n in range(6) for cs in product("'sre ", repeat=n)] + ["".join(cs) for cs in product("'lLvE7-²", repeat=4)]
    texts += [f"a{chr(c)}{end}{chr(d)}'" for c in range(256) for d in (32, 39, 97, 55, 0xA0) for end in ("'s", "'ll", "''d")]
    # texts of other letters, special tokens and no letters between the plain ones of one call
    texts[5:5] = ["", "你 It's", " \n", "x<|ENDOFTEXT|>'s", "a\x1cb", "It’s it's"]
    assert packing.Encoder(path).encode(texts) == _ids(whole, texts)
    assert packing.Encoder(path).encode([]) == [] and packing.Encoder(path).encode(["", " "]) == [b"", b""]


def test_another_tokenizer_keeps_its_letters(tmp_path):
    path = str(tmp_path / "cased.json")
    cased = Tokenizer(models.WordLevel({"A": 3, "a": 4, "?": 5}, unk_token="?"))
    cased.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    cased.save(path)
    texts = ["A a", "", "a A你 A"]
    assert packing.Encoder(path).encode(texts) == _ids(cased, texts)
