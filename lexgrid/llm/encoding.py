"""Token ids of whole texts, with a bounded memory of words seen before."""

from __future__ import annotations

import json
import os
import string
from array import array

from lexgrid.llm.shared import Words, memory_of

#: Words kept at most in a worker's memory (about 180 MB), and the longest kept; longer ones are encoded anew.
MOST_WORDS, LONGEST_WORD = 900_000, 48
#: Marks, which are no letters, digits or blanks, and the last letter of the Latin blocks.
MARKS, LAST_LATIN = string.punctuation, "\u024f"
#: Byte-level vocabularies write a byte as the character of its number if that is visible in Latin-1, and the others in turn as the characters from 256 on.
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
SPACE = chr(BYTES[0x20])
#: Stands for a line's end at the start of a word; a text that holds it is encoded whole.
LINE = "\x03"

_loaded: dict = {}


class NotByWord(ValueError):
    """A text's words can't be encoded one by one."""


class Encoder:
    """Texts to ids by the tokenizers library, as bytes: little-endian unsigned 32-bit integers.

    A byte-level vocabulary without a normalizer splits a text, before it merges bytes, in front of each single space or line end that stands between two characters which aren't white space; a line end there is a split of its own, and so are both of two line ends, or a line end before a space. So such a text is cut into words, and each distinct word encoded when it is first met. Texts with other white space, such as two line ends before more of it or at the end, which are one split, and all texts of other vocabularies, are encoded whole.
    Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        self.by_word = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.size = self.tokenizer.get_vocab_size()
        self.line = self.whole("\n")
        self.tokenize = self.tokenizer.model.tokenize
        self.words = Words(MOST_WORDS).made_by(self.word, LONGEST_WORD)
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def tail(self, marks: str) -> bytes:
        if len(marks) > LONGEST_WORD:
            return self.whole(marks)
        if marks not in self.marks:
            if len(self.marks) >= MOST_WORDS // 16:
                self.marks.clear()
            self.marks[marks] = self.whole(marks)
        return self.marks[marks]

    def word(self, w: str) -> bytes:
        """Ids of a word and the blank before it.

        A word of Latin letters, and marks after it, is one split of letters and one of marks: the letters go to the model at once, the marks are remembered.
        """
        if w.split() != [w]:
            raise NotByWord
        c = w.rstrip(MARKS)
        if not (x := c[1:] if w[0] == LINE else c).isalpha() or not x.isascii() and max(x) > LAST_LATIN:
            return self.line + self.whole(w[1:]) if w[0] == LINE else self.whole(" " + w)
        if len(c) < len(w):
            return self.words.new[c] + self.tail(w[len(c) :])
        x = x.encode().decode("latin-1").translate(BYTES) if not x.isascii() else x
        raw = array("I", [t.id for t in self.tokenize(x if w[0] == LINE else SPACE + x)]).tobytes()
        return self.line + raw if w[0] == LINE else raw

    def encode(self, text: str) -> bytes:
        if not self.by_word or not text or LINE in text or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n"):
            return self.whole(text)
        try:
            known = self.words.turned().new
            return b"".join(map(known.__getitem__, (LINE + text.replace("\n", " " + LINE)).split(" ")))[len(self.line) :]
        except NotByWord:
            return self.whole(text)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].words = memory_of(path, MOST_WORDS).made_by(_loaded[path].word, LONGEST_WORD)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
