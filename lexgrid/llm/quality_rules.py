"""Quality rules: counts of words, symbols and repeats, and how well a public vocabulary fits the text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from lexgrid.llm.shared import BLANKS, Words, as_row, for_python, memory_of, of_row

#: Fixed values of the contract.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: Scripts by first and last code point of their letters.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
]
#: Rejection bands by script: characters per token at least and at most, byte-fallback share at most, entropy share at least.
BANDS = {
    "latin": (1.2, 9.0, 0.10, 0.68), "greek": (0.6, 6.0, 0.60, 0.55), "cyrillic": (1.0, 8.0, 0.20, 0.62), "hebrew": (0.6, 6.0, 0.60, 0.55), "arabic": (0.6, 6.0, 0.60, 0.55),
    "indic": (0.3, 6.0, 0.90, 0.40), "thai": (0.3, 6.0, 0.90, 0.40), "hangul": (0.3, 5.0, 0.90, 0.50), "kana": (0.3, 5.0, 0.90, 0.50), "han": (0.3, 5.0, 0.90, 0.50), "other": (0.2, 12.0, 0.98, 0.30),
}
#: Entropy is measured against that of so many different tokens.
FULL_TOKENS = 512
MOST_KNOWN, LONGEST_KNOWN = 200_000, 48
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, entropy_share double"

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_STARTS = np.array([0x80 & x == 0 or 0x40 & x != 0 for x in range(256)])
_NAMES = sorted({s for s, _, _ in SCRIPTS})
_loaded: dict = {}


def script_of(text: str) -> str:
    """The script with most letters, by SCRIPTS; "other" if none has one."""
    counts = dict.fromkeys(_NAMES, 0)
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "other"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    for name, first, last in SCRIPTS:
        counts[name] += int(((points >= first) & (points <= last)).sum())
    best = max(_NAMES, key=counts.get)
    return best if counts[best] else "other"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words that the text holds at least twice."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    n, total, factor = len(words) - window + 1, np.zeros(len(words) - window + 1, np.uint64), 1
    for k in range(window):
        total += mixed[k : k + n] * np.uint64(factor)
        factor = factor * 0x94D049BB133111EB % (1 << 64)
    _, back, counts = np.unique(total, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[back] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Fertility:
    """A sentencepiece vocabulary with byte fallback, and a bounded memory of words' ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.pieces.vocab_size())])
        self.known = Words(MOST_KNOWN)

    def ids(self, words: list[bytes]) -> np.ndarray:
        new, extra = self.known.unknown(words), {}
        known = self.known.new
        if new:
            for w, ids in zip(new, self.pieces.encode([w.decode() for w in new], out_type=int, num_threads=1), strict=True):
                (known if len(w) <= LONGEST_KNOWN else extra)[w] = np.array(ids, "<u4").tobytes()
        return np.frombuffer(b"".join([known[w] if w in known else extra[w] for w in words] if extra else map(known.__getitem__, words)), "<u4")


def fits(band: tuple, per: float, share: float, part: float) -> bool:
    """Whether characters per token, byte share and entropy share keep to a band."""
    least, most, most_bytes, least_part = band
    return least <= per <= most and share <= most_bytes and part >= least_part


def measure(text: str | None, vocabulary: Fertility, bands: dict) -> tuple:
    """FIELDS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(counts[_STARTS & ~_BLANK].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS.encode())]
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    ids = vocabulary.ids(words)
    n = len(ids)
    script = script_of(text or "")
    per, share, entropy, part = (chars / n if n else 0.0), 0.0, 0.0, 0.0
    if n:
        p = np.unique(ids, return_counts=True)[1] / n
        share, entropy = float(vocabulary.is_byte[ids].mean()), float(-(p * np.log2(p)).sum()) + 0.0
        part = entropy / float(np.log2(min(max(n, 2), FULL_TOKENS)))
    good = not failed and fits(bands.get(script, bands["other"]), per, share, part)
    return (len(words), chars, int(counts[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated, failed, good, script, n, per, share, entropy, part)


def judged(docs: DataFrame, text: str, vocabulary: str | None, bands: dict | None) -> DataFrame:
    """(row, quality) of each row: quality is a struct of FIELDS."""
    import public_tokenizers

    for_python(docs.sparkSession)
    path, held, at = vocabulary or public_tokenizers.path("piece_bpe_32k.model"), bands or BANDS, docs.columns.index(text)

    def measured(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        fields = [x.split() for x in FIELDS.split(", ")]
        if path not in _loaded:
            _loaded[path] = Fertility(path)
        _loaded[path].known = memory_of(path, MOST_KNOWN)
        for batch in batches:
            rows = [measure(x.as_py(), _loaded[path], held) for x in batch.column(0).field(at)]
            quality = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), quality], names=["row", "quality"])

    boxed = as_row(docs)
    return boxed.mapInArrow(measured, StructType([*boxed.schema.fields, StructField("quality", StructType.fromDDL(FIELDS))]))


def judge(docs: DataFrame, *, text: str = "text", vocabulary: str | None = None, bands: dict | None = None) -> DataFrame:
    """docs' columns, then `quality`: a struct of FIELDS.

    Words, symbols, repeated lines and repeated word windows are counted over the whole text; base_failed says that there are too few words or that too many stand in repeated windows. Each word is then encoded by a public vocabulary: characters per token, share of byte-fallback tokens, and entropy of the tokens, also as a share of what min(tokens, FULL_TOKENS) different tokens have. A text whose script's band doesn't hold them isn't kept, however few its tokens.
    Null or empty texts have no words and fail. Texts of any length are measured whole, one at a time. Each row is judged alone, so ties, repeated rows and empty tables need no rule. A column of docs named quality is dropped.
    """
    return judged(docs, text, vocabulary, bands).select(*of_row(docs.columns, ("quality",)), "quality")


def kept(docs: DataFrame, *, text: str = "text", vocabulary: str | None = None, bands: dict | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns and no other."""
    return judged(docs, text, vocabulary, bands).filter("quality.kept").select(*of_row(docs.columns))
