"""Token ids of whole texts with a vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import os
from array import array

WORD_CACHE = 700_000
"""Words whose ids a worker remembers; beyond that it forgets them all and starts anew."""


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The vocabulary drops white space and never joins across it, so a text has the ids of its
    words, one after the other. Only blanks and line feeds are cut at; words with other spaces
    inside go to the library as they are.
    """

    _open: dict[str, "Encoder"] = {}

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.known: dict[str, bytes] = {"": b""}
        self.letters = byte_letters()
        # Does this vocabulary work word by word, and are its words' letters bytes?
        probe = ["strasse", "été", "x", "größe,"]
        self.by_word = self._whole(" ".join(probe)) == [i for w in probe for i in self._whole(w)]
        self.direct = self.by_word and all(self._stem(w) == self._whole(w) for w in probe[:3])

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _stem(self, stem: str) -> list[int]:
        """Ids of lower-case letters, by the vocabulary's merges alone."""
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(stem)]

    @classmethod
    def of(cls, name: str) -> "Encoder":
        """The encoder of this worker process; ``name`` is a file name or a full path."""
        if name not in cls._open:
            cls._open[name] = cls(name if os.path.isabs(name) else vocabulary(name))
        return cls._open[name]

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return array("I", self._whole(text)).tobytes()
        known = self.known
        words = text.replace("\n", " ").split(" ")
        parts = list(map(known.get, words))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    if words[i] not in known:
                        self._learn(words[i])
                    parts[i] = known[words[i]]
            if len(known) > WORD_CACHE:
                known.clear()
                known[""] = b""
        return b"".join(parts)

    def _learn(self, word: str) -> None:
        """Case is dropped, and a comma or stop after letters is a token of its own, so the forms
        of a word share the work."""
        known, stem = self.known, plain_stem(word)
        if not self.direct or not stem:
            known[word] = array("I", self._whole(word)).tobytes()
            return
        if stem not in known:
            known[stem] = array("I", self._stem(stem)).tobytes()
        if stem != word:
            tail = word[-1]
            if tail not in ",.":
                known[word] = known[stem]
                return
            if tail not in known:
                known[tail] = array("I", self._whole(tail)).tobytes()
            known[word] = known[stem] + known[tail]


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others by the
    characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


def plain_stem(word: str) -> str:
    """The word in lower case without one closing comma or stop, if its letters are Latin-1; else
    nothing."""
    stem = word[:-1] if word[-1] in ",." else word
    if stem.isalpha() and max(stem) < "\u0100":
        return stem.lower()
    return ""
