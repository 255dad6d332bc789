import json
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lakeweave.llm import packing
from lakeweave.llm.queries import TOKENIZER

ODD = ["don't stop", "DON'T 'tis 's 'S x's, it's.", "<|endoftext|>", "a<|endoftext|>.", "<|STARTOFTEXT|>", "|x|", "éte É H̱ ẖ", "ÀÉîß ÿ Ÿ × ÷ ª º µ ¼ ²", "12a345 1.2.3 ٣ x٣y", "_a_b_ __ a-b--c", "Σας ΣΑΣ", "İstanbul ǅ ﬁn", "a b   c", "≮ ≠", "x\x00y \x7f", "日本語 and 한글", "A&B ((c)) {d}~e", "​w‍", "AT&T's", None, ""]



def test_ids_are_those_of_whole_texts():
    random.seed(3)
    letters = [chr(c) for c in range(33, 256) if c not in (0x85, 0xA0)] + list("  aaeeounTHE.,'") * 6
    texts = ODD + ["".join(random.choice(letters) for _ in range(200)) for _ in range(300)]
    tokens = packing.Tokens(TOKENIZER)
    assert tokens.model
    encoder = Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # learnt, then known
        ids, n = tokens.of(pa.array(texts))
        for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == encoder.encode(text or "", add_special_tokens=False).ids, text


def test_plain_words_are_not_encoded(monkeypatch):
    """Words of Latin letters, digits and signs go to the model; only others take all the tokenizer's steps."""
    seen, encoded = [], packing.Tokens._encoded
    monkeypatch.setattr(packing.Tokens, "_encoded", lambda self, words: (seen.extend(words.to_pylist()), encoded(self, words))[1])
    packing.Tokens(TOKENIZER).of(pa.array(["Plain (words), été 42 don't", "ﬁn plain é"]))
    assert sorted(seen) == sorted(["don't", "ﬁn", "é"])


def test_other_tokenizers_encode_all(tmp_path):
    form = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    form["normalizer"]["normalizers"].pop()  # it does not lower letters
    (tmp_path / "t.json").write_text(json.dumps(form))
    tokens = packing.Tokens(str(tmp_path / "t.json"))
    assert tokens.model is None
    assert tokens.of(pa.array(["Some WORDS, été"]))[0].tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode("Some WORDS, été", add_special_tokens=False).ids
