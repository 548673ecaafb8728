"""Token ids of whole texts by the tokenizers library, in batches inside a task.

The vocabulary file must be a word BPE: white space separates words for good, runs of letters and runs of
other signs are words of their own.  Words repeat, so each worker keeps the ids of words it has seen and only
new words reach the library.  A text with signs outside the plain Latin range goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Signs for which Python and the library agree about white space and lower case.
UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-įı-ſ]")
#: Words kept by a worker; with more, it starts anew.
KEPT_WORDS = 400_000
#: Type code of 32-bit numbers; all machines that Spark runs on here are little-endian.
WIDE = "I"


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class KnownWords(dict):
    """Ids of the words seen so far; a new word is learned when it is looked up."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.signs = _byte_signs()

    def _run(self, run: str) -> bytes:
        """Ids of one run of letters or of other signs."""
        if not run.isascii():
            run = "".join([self.signs[b] for b in run.encode()])
        return array(WIDE, [t.id for t in self.tokenizer.model.tokenize(run)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        if word.isalpha():
            ids = self._run(word)
        else:
            base = word.rstrip(".,")
            if base.isalpha():
                return self[base] + self[word[len(base) :]]
            ids = array(WIDE, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids


class TokenIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = KnownWords(self.tokenizer)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif UNUSUAL.search(text):
                out.append(array(WIDE, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(self.known.__getitem__, text.lower().split())))
        return out


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One tokenizer per worker and file."""
    return TokenIds(path)
