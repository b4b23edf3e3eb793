"""Ids of white-space separated words under a public vocabulary with word ends."""

from __future__ import annotations

from functools import lru_cache
from unicodedata import is_normalized

from .bpe import byte_alphabet


@lru_cache(maxsize=1)
def tokenizer(vocab: str):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(vocab if "/" in vocab else public_tokenizers.path(vocab))
    t.no_truncation()
    t.no_padding()
    return t


class WordIds:
    """A word's ids. A run of lower-case letters is one piece for the vocabulary, and
    so is the punctuation after it, so both are merged on their own; any other
    word goes through the whole tokenizer."""

    def __init__(self, vocab: str):
        t = tokenizer(vocab)
        self.encode, self.merge = t.encode_batch_fast, t.model.tokenize
        letters = {b: c for c, b in byte_alphabet().items()}
        self.letter = [letters[b] for b in range(256)]
        self.after: dict[bytes, list[int]] = {b"": []}

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        hard: list[int] = []
        merge, after = self.merge, self.after
        for i, w in enumerate(words):
            if w.isalpha() and w.islower():  # ASCII letters
                out[i] = [t.id for t in merge(w.decode())]
                continue
            core = w.rstrip(b".,!?;:")
            end = after.get(w[len(core):])
            if end is None:
                end = after[w[len(core):]] = self.encode([w[len(core):].decode()], add_special_tokens=False)[0].ids
            if core.isalpha() and core.islower():
                out[i] = [t.id for t in merge(core.decode())] + end
            elif (s := core.decode("utf-8", "replace")).isalpha() and s == s.lower() and is_normalized("NFC", s):
                out[i] = [t.id for t in merge("".join([self.letter[b] for b in core]))] + end
            else:
                hard.append(i)
        for i, e in zip(hard, self.encode([words[i].decode("utf-8", "replace") for i in hard], add_special_tokens=False)):
            out[i] = e.ids
        return out


@lru_cache(maxsize=1)
def word_encoder(vocab: str) -> WordIds:
    return WordIds(vocab)


def word_ids(vocab: str, words: list[bytes]) -> list[list[int]]:
    return word_encoder(vocab)(words)
