"""Token ids of whole texts through a word memo.

The JSON tokenizer drops white space and no pre-token spans it, so the ids of a text are
the ids of its chunks between spaces and line feeds, in order. Each distinct chunk is
encoded once by the library itself; repeated chunks are looked up.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

from .common import Memo, held

#: Chunks in each generation of a worker's memo, where nothing else says so.
MEMO_WORDS = 250_000
#: Marks at the end of a chunk that neither compose with letters nor occur in special tokens.
MARKS = ".,!?;:"


class _Ids:
    """Ids of a chunk that is new. Marks after an ASCII letter or after a letter that
    normalising keeps one letter are pre-tokens of their own and looked up apart; so is the
    lower case of ASCII letters. (Others, such as U+0130, may end in a combining mark once
    they are normalised, which the tokenizer joins to the marks.)"""

    def __init__(self, tokenizer, size: int):
        self.tokenizer, self.letters, self.splits = tokenizer, {}, _splits(tokenizer)
        self.memo = Memo(self.ids, size)

    def ids(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if core != chunk and core and self.is_letter(core[-1]):
            return self.memo[core] + self.memo[chunk[len(core) :]]
        if chunk.isascii() and chunk.isalpha() and (low := chunk.lower()) != chunk:
            return self.memo[low]
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def is_letter(self, c: str) -> bool:
        if c not in self.letters:
            normal = self.tokenizer.normalizer.normalize_str(c)
            self.letters[c] = len(normal) == 1 and c.isalpha() and normal.isalpha()
        return self.letters[c]


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _splits(tokenizer) -> bool:
    """Whether the file's pipeline is the one for which chunks may be encoded apart."""
    import json

    spec = json.loads(tokenizer.to_str())
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    tokens = [a["content"] for a in spec.get("added_tokens", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and pre[0].get("behavior") == "Removed" and not any(c.isspace() or c in MARKS for x in tokens for c in x) and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])


def ids_bytes(path: str, text: str, memo_words: int = MEMO_WORDS) -> bytes:
    """The ids of text as little-endian unsigned 32-bit numbers."""
    ids = held(("word ids", path, memo_words), lambda: _Ids(_tokenizer(path), memo_words))
    if not ids.splits:
        return array("I", ids.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    return b"".join(map(ids.memo.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count(path: str, text: str) -> int:
    """Tokens of text as the file's library gives them, without any that it would add."""
    if path.endswith(".model"):
        return len(_pieces(path).encode(text))
    return len(ids_bytes(path, text)) // 4
