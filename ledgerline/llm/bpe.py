"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold (rank, place) of each adjacent pair of a word's symbols; the root
is the leftmost pair of the lowest rank. A merge changes three leaves, each in logarithmic
time, until the root holds no mergeable pair. Text is normalised (NFC, lower case character by
character), split by the tokenizer's pattern into words that merge on their own, and special
tokens are cut out of the raw text first, as the tokenizer file says. Results of words are
kept in a bounded cache; every word of every whole text is encoded.

Edge cases: null text -> no tokens, empty decoded text; special tokens inside a text become
their ids; null ids and repeated rows -> a row each; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import on_workers, spread

CACHE = 150_000          # words in each of two generations
WIDE = 16
NONE, LOW = 1 << 62, (1 << 32) - 1
HIGH = NONE - 1 - LOW
HIGHER = re.compile("[\U00010000-\U0010ffff]")
#: White space of the pattern's \s, and its contractions.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def merge_word(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """Merge one word's symbols. ``ranks``: left << 32 | right -> rank << 32 | merged id.

    The tree is wide: each node is the least of ``WIDE`` children, so a short word is one node
    and a point update takes log_WIDE(n) steps."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    leaves = []
    for i in range(n - 1):
        r = get(symbols[i] << 32 | symbols[i + 1])
        leaves.append(NONE if r is None else (r & HIGH) | i)
    levels = [leaves]
    while len(levels[-1]) > WIDE:
        below = levels[-1]
        levels.append([min(below[i:i + WIDE]) for i in range(0, len(below), WIDE)])
    top = levels[-1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    sym = symbols
    while True:
        root = min(top)
        if root == NONE:
            break
        i = root & LOW
        j = after[i]
        right = after[j]
        left = before[i]
        sym[i] = merged = get(sym[i] << 32 | sym[j]) & LOW
        after[i] = right
        if j < n - 1:
            leaves[j] = NONE
        if right < n:
            before[right] = i
            r = get(merged << 32 | sym[right])
            leaves[i] = NONE if r is None else (r & HIGH) | i
        else:
            leaves[i] = NONE
        if left >= 0:
            r = get(sym[left] << 32 | merged)
            leaves[left] = NONE if r is None else (r & HIGH) | left
        if len(levels) > 1:
            for place in {left // WIDE if left >= 0 else i // WIDE, i // WIDE, min(j, n - 2) // WIDE}:
                for level in range(1, len(levels)):
                    low = place * WIDE
                    least = min(levels[level - 1][low:low + WIDE])
                    if levels[level][place] == least:
                        break
                    levels[level][place] = least
                    place //= WIDE
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return out


def _classes(last: int) -> tuple[str, str]:
    """Ranges of letters and of numbers up to a code point, for a character class."""
    found = {"L": [], "N": []}
    start, kind = 0, ""
    for c in range(last + 2):
        k = unicodedata.category(chr(c))[0] if c <= last else ""
        if k != kind:
            if kind in found:
                found[kind].append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start, kind = c, k
    return "".join(found["L"]), "".join(found["N"])


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Encoded(dict):
    """word -> its ids (4 bytes each, little endian), in two generations of CACHE words."""

    def __init__(self, bpe: "Bpe"):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = np.array(self.bpe.word(word), "<u4").tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Bpe:
    """A tokenizer file of words with an end mark: NFC, lower case, white space dropped."""

    def __init__(self, spec: str):
        got = json.loads(spec)
        model = got["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in got["added_tokens"]}
        self.token = [""] * (1 + max([*self.vocab.values(), *self.special.values()], default=0))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(self.vocab[a] << 32 | self.vocab[b], rank << 32 | self.vocab[a + b])
        chars = _byte_chars()
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.end] for c in chars]
        rest = [r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+"]
        for last in (0xFFFF, sys.maxunicode):
            letters, numbers = _classes(last)
            rest.append(f"[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")
        # (without apostrophes, with them) for ASCII, for text without and with higher planes
        self.ascii, self.basic, self.any = ((re.compile(r), re.compile(f"{CONTRACTIONS}|{r}")) for r in rest)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.encoded = _Encoded(self)

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return merge_word([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.ranks)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii["'" in text].findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:        # str.lower() looks at the neighbours of this letter alone
            text = text.replace("\u03a3", "\u03c3")
        text = text.lower()
        return (self.any if HIGHER.search(text) else self.basic)["'" in text].findall(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each, little endian."""
        get = self.encoded.__getitem__
        if not self.special or not any(s in text for s in self.special):
            return b"".join(map(get, self.words(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += map(get, self.words(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens, joined by blanks, as a file without a decoder says."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(spec: str) -> Bpe:
    return Bpe(spec)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, ``ids`` (4 bytes each, little endian), ``decoded`` text, for every row."""
    on_workers(docs.sparkSession)
    with open(path, encoding="utf-8") as f:      # the driver reads the file, workers get its text
        spec = f.read()

    def run(batches):
        bpe = tokenizer(spec)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, said = [], []
                for text in part.column(1).to_pylist():
                    ids.append(bpe.encode(text or ""))
                    said.append(bpe.decode(ids[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()),
                                                  pa.array(said, pa.string())], [key, "ids", "decoded"])

    d = docs.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text"))
    return spread(d, key).mapInArrow(run, f"`{key}` bigint, ids binary, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id", F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more)
