"""Runs of letters go to the model many at a time."""

import json
import random

import pyarrow as pa
from tokenizers import Tokenizer

from canonry.llm import tokens


def _as_library(enc, tok, texts):
    ids, begin = enc.encode(pa.array(texts), 7)
    got = [ids[a:e].tolist() for a, e in zip(begin, begin[1:])]
    assert got == [[*tok.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgtheing" * 3 + "ABÀéÿßǁɏªº") for _ in range(rng.randint(1, 12))) + rng.choice(["", "", "", ",", "...", "'s", "7", "ж"])
    return [" ".join(word() for _ in range(300)) for _ in range(20)]


def test_new_words_are_not_encoded_one_by_one():
    path, texts = tokens.default_vocabulary(), _texts(1)
    enc, tok = tokens.Encoder(path), Tokenizer.from_file(path)

    class Counted:
        calls = 0

        def __init__(self, inner):
            self.inner = inner

        def tokenize(self, text):
            Counted.calls += 1
            return self.inner.tokenize(text)

    class Library:
        model = Counted(enc.tok.model)

        def __getattr__(self, name):
            return getattr(tok, name)

    enc.tok = Library()
    _as_library(enc, tok, texts)
    assert Counted.calls < 100  # thousands of words


def test_a_vocabulary_that_joins_words_is_not_used_across_spaces(tmp_path):
    with open(tokens.default_vocabulary()) as f:
        spec = json.load(f)
    spec["model"]["vocab"]["eĠt"] = len(spec["model"]["vocab"]) + 1
    spec["model"]["merges"].insert(0, ["e", "Ġt"] if isinstance(spec["model"]["merges"][0], list) else "e Ġt")
    path = tmp_path / "joins.json"
    path.write_text(json.dumps(spec))
    enc = tokens.Encoder(str(path))
    assert not enc.letters and tokens.Encoder(tokens.default_vocabulary()).letters
    _as_library(enc, Tokenizer.from_file(str(path)), ["the te the tee", *_texts(2)])
