"""SentencePiece encoding and decoding that keeps the source place of every piece.

A model file (protocol buffers, read here field by field) holds scored pieces and a normaliser:
a compiled character map, that is a double-array trie over byte strings and their replacements.
Normalisation takes the longest prefix of the rest of the text that the map knows, else one
character, and notes for each byte of its output the byte of the source where that prefix
began; heading, trailing and repeated blanks are dropped and blanks escaped as the model says.
Pieces then merge by score (the highest first, the leftmost of equals) and every piece is
projected through those notes to a span of source bytes: piece k covers ``bounds[k]`` to
``bounds[k+1]``. Characters without a piece become byte pieces where the model has them (the
last of a character's bytes holds its span) or unknown pieces (neighbours in one).

Two characters that stand together in no piece never merge, so a text is cut there and the
parts are encoded one by one; their results stay in a cache of bounded size. All texts are
encoded whole.

Edge cases: null or empty text -> the end id alone (where asked for), an empty decoded text and
one bound, 0; null ids and repeated rows -> a row each; an empty table -> no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import on_workers, spread

CACHE = 250_000          # parts in each of two generations
SHORT = 64               # symbols that merge in a list instead of a heap
SIDE_BY_SIDE = 20_000    # parts that merge in one pass over arrays
LONG = 4096              # characters of a part that is cut where no piece crosses
ROWS = 128
SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Fixed values of the file format: numbers of fields, and types of pieces.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 3, 4, 5, 6


def message(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffers message: ints, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix rules of a compiled map: size of the trie, its units, replaced strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size:]
        first = [b for b in range(256) if self.units and self._child(self._children(0), b) is not None]
        #: A run of characters that begin no rule.
        self.plain = re.compile(b"[^" + b"".join(b"\\x%02x" % b for b in first) + b"]+" if first else rb"[\x00-\xff]+")

    def _children(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10 << ((unit & 512) >> 6))

    def _child(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        if node < len(self.units) and self.units[node] & 0x800000FF == byte:
            return node
        return None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest rule that matches at a place."""
        base, best, value = self._children(0), 0, 0
        for k in range(at, len(text)):
            node = self._child(base, text[k])
            if node is None:
                break
            base = self._children(node)
            if self.units[node] >> 8 & 1:
                best, value = k + 1 - at, self.units[base] & 0x7FFFFFFF
        if not best:
            return None
        return best, self.strings[value:self.strings.index(b"\0", value)]


class Normaliser:
    """``spec``: the normaliser's message. ``users``: strings that are taken as they are."""

    def __init__(self, spec: bytes, users: list[str] = (), suffix: bool = False):
        own = dict(message(spec))
        blob = own.get(2, b"")
        self.map = CharacterMap(blob)
        self.dummy, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        ordered = sorted((u.encode() for u in users), key=len, reverse=True)
        self.users = re.compile(b"|".join(map(re.escape, ordered))) if ordered else None
        self.simple = not self.map.units and not ordered and not self.squeeze and self.escape

    def _prefixes(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(source place, source bytes, normalised bytes), from left to right; runs of characters
        without a rule come as one."""
        at, n = 0, len(text)
        while at < n:
            user = self.users.match(text, at) if self.users else None
            if user:
                yield at, user.end() - at, user.group()
                at = user.end()
                continue
            rule = self.map.longest(text, at) if self.map.units else None
            if rule:
                yield at, *rule
                at += rule[0]
                continue
            end = at + 1
            while end < n and text[end] & 0xC0 == 0x80:
                end += 1
            if not self.users and (plain := self.map.plain.match(text, end)):
                end = plain.end()
                while end < n and text[end] & 0xC0 == 0x80:
                    end += 1
            yield at, end - at, text[at:end]
            at = end

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and their end the source byte they come from)."""
        if not text:
            return b"", np.zeros(1, np.int64)
        space = SPACE_BYTES if self.escape else b" "
        out, notes, consumed = [], [], 0
        blank = self.squeeze          # the output ends with a blank (or hasn't begun)
        begun = False
        for at, size, said in self._prefixes(text):
            moved = size == len(said) and text[at:at + size] == said
            src = np.frombuffer(text, np.uint8, size, at)
            if moved:                 # each character is a prefix of its own
                from_ = at + np.maximum.accumulate(np.where(src & 0xC0 != 0x80, np.arange(size), 0))
            else:
                from_ = np.full(len(said), at)
            raw = np.frombuffer(said, np.uint8)
            if self.squeeze and len(raw):
                is_space = raw == 32
                keep = ~is_space
                keep[1:] |= is_space[1:] & ~is_space[:-1]
                if not moved:         # inside one replacement only heading blanks go
                    keep = np.ones(len(raw), bool)
                    if blank:
                        keep[:len(said) - len(said.lstrip(b" "))] = False
                else:
                    keep[0] = not (blank and is_space[0])
                if keep.any():
                    blank = bool(raw[-1] == 32)
                raw, from_ = raw[keep], from_[keep]
            if not begun:
                if self.squeeze and not len(raw):
                    continue
                first = int(from_[0]) if self.squeeze else 0
                if self.dummy and not self.suffix:
                    out.append(space)
                    notes.append(np.full(len(space), first))
                begun = True
            times = np.where(raw == 32, len(space), 1)
            out.append(raw.tobytes().replace(b" ", space))
            notes.append(np.repeat(from_, times))
            consumed = at + size
        if not begun:
            return b"", np.zeros(1, np.int64)
        norm, note = b"".join(out), np.concatenate(notes)
        consumed = len(text)
        if self.squeeze:
            while norm.endswith(space):
                consumed = int(note[len(norm) - len(space)])
                norm, note = norm[:-len(space)], note[:-len(space)]
        if self.dummy and self.suffix:
            norm, note = norm + space, np.concatenate([note, np.full(len(space), consumed)])
        return norm, np.append(note, consumed)

    def escaped(self, text: bytes) -> tuple[str, np.ndarray]:
        """``normalise`` without rules: blanks escaped, one put in front."""
        if not text:
            return "", np.zeros(1, np.int64)
        src = np.frombuffer(text, np.uint8)
        from_ = np.arange(len(text))
        if not text.isascii():
            from_ = np.maximum.accumulate(np.where(src & 0xC0 != 0x80, from_, 0))
        note = np.repeat(from_, np.where(src == 32, 3, 1))
        said = text.decode("utf-8", "replace").replace(" ", SPACE)
        before, after = (SPACE if self.dummy and not self.suffix else ""), (SPACE if self.dummy and self.suffix else "")
        return before + said + after, np.concatenate(
            [np.zeros(3 * len(before), np.int64), note, np.full(3 * len(after) + 1, len(text))])


class _Parts(dict):
    """part of a normalised text -> its ids (4 bytes each), in two generations of CACHE parts."""

    def __init__(self, model: "Model"):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            got = np.array(self.model.merged(part), "<i4").tobytes()
        if len(part) <= LONG:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[part] = got
        return got


class PairTable:
    """Ranks and results of pairs of symbols, in an open-addressed table of arrays."""

    NONE = 1 << 62

    def __init__(self, rank: dict[int, int], into: dict[int, int]):
        keys = np.fromiter(rank, np.uint64, len(rank))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(1 << bits, self.NONE, np.int64)
        self.into = np.zeros(1 << bits, np.int32)
        ranks, made = np.fromiter(rank.values(), np.int64, len(rank)), np.fromiter((into[k] for k in rank), np.int32, len(rank))
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.rank[slot[left]] == self.NONE
            here = left[free]
            self.keys[slot[here]] = keys[here]
            won = self.keys[slot[here]] == keys[here]
            self.rank[slot[here[won]]], self.into[slot[here[won]]] = ranks[here[won]], made[here[won]]
            left = np.concatenate([left[~free], here[~won]])
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, or NONE; resulting piece) of each pair."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank = self.rank[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (rank != self.NONE))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            rank[other] = self.rank[slot[other]]
            other = other[(self.keys[slot[other]] != keys[other]) & (rank[other] != self.NONE)]
        return rank, self.into[slot]

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Merge the symbols of many words, ``sizes`` symbols each, one pair of every word a
        round: the lowest rank, the leftmost of equals."""
        out: list[bytes] = [b""] * len(sizes)
        word = np.arange(len(sizes))
        place = np.arange(len(sym))                   # a symbol's place in the order, for equals
        last = np.zeros(len(sym), bool)
        last[np.cumsum(sizes) - 1] = True
        cost, made = np.full(len(sym), self.NONE), np.zeros(len(sym), np.int32)
        at = np.flatnonzero(~last)

        def price(at: np.ndarray) -> None:
            at = at[~last[at]]
            rank, made[at] = self.look_up(sym[at], sym[at + 1])
            cost[at] = np.where(rank == self.NONE, self.NONE, rank << 32 | place[at])

        price(at)
        while len(word):
            ends = np.cumsum(sizes)
            least = np.minimum.reduceat(cost, ends - sizes)
            over = least == self.NONE
            if over.any():
                raw = sym.astype("<i4").tobytes()
                for w, a, b in zip(word[over].tolist(), (4 * (ends - sizes)[over]).tolist(), (4 * ends[over]).tolist()):
                    out[w] = raw[a:b]
                stay = np.repeat(~over, sizes)
                sym, place, last, cost, made = sym[stay], place[stay], last[stay], cost[stay], made[stay]
                word, sizes, least = word[~over], sizes[~over], least[~over]
                if not len(word):
                    break
            hit = np.flatnonzero(cost == np.repeat(least, sizes))
            sym[hit] = made[hit]
            last[hit] = last[hit + 1]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, place, last, cost, made = sym[stay], place[stay], last[stay], cost[stay], made[stay]
            sizes = sizes - 1
            hit = hit - np.arange(len(hit))
            cost[hit] = self.NONE
            price(hit)
            price(hit[hit > 0] - 1)
        return out


class Model:
    """A model of scored pieces that merge pair by pair."""

    def __init__(self, raw: bytes):
        self.piece: list[str] = []
        self.kind: list[int] = []
        self.score: list[float] = []
        normaliser, trainer = b"", {}
        for field, value in message(raw):
            if field == PIECES:
                own = dict(message(value))
                self.piece.append(own[1].decode())
                self.score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, 1))
            elif field == TRAINER:
                trainer = dict(message(value))
            elif field == NORMALIZER:
                normaliser = value
            elif field == DENORMALIZER and dict(message(value)).get(2):
                raise ValueError("a denormaliser's rules aren't supported")
        if trainer.get(3, 1) != 2:
            raise ValueError("only models of merged pairs (BPE) are supported")
        self.fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        kinds = list(enumerate(self.kind))
        self.unknown = next(i for i, k in kinds if k == UNKNOWN)
        name = trainer.get(47, b"</s>").decode()
        self.end_id = next((i for i, k in kinds if k == CONTROL and self.piece[i] == name), self.unknown)
        self.bytes_ = {int(self.piece[i][3:5], 16): i for i, k in kinds if k == BYTE}
        self.merge = {self.piece[i]: i for i, k in kinds if k in (1, USER, UNUSED)}
        users = [self.piece[i] for i, k in kinds if k == USER]
        self.users = re.compile("|".join(map(re.escape, sorted(users, key=len, reverse=True)))) if users else None
        self.normaliser = Normaliser(normaliser, users, bool(trainer.get(24, 0)))
        self.resegment = UNUSED in self.kind
        self.vector = not self.resegment and not users
        #: Pairs of characters that stand together in some piece.
        self.together = {p[k:k + 2] for p in self.merge for k in range(len(p) - 1)}
        starts_only = all(SPACE not in p.lstrip(SPACE) for p in self.merge) and not users
        joined = {c for pair in self.together for c in pair}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")) if starts_only else None
        self._pairs()
        self.parts = _Parts(self)
        self.controls = {i for i, k in kinds if k == CONTROL}
        self.said = [b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN
                     else bytes([int(self.piece[i][3:5], 16)]) if k == BYTE else self.piece[i].replace(SPACE, " ").encode() for i, k in kinds]
        # bytes of the normalised text under a piece (an unknown one: counted where it stands)
        self.size = np.array([0 if k in (CONTROL, UNKNOWN) else 1 if k == BYTE else len(self.piece[i].encode()) for i, k in kinds], np.int64)

    def _pairs(self) -> None:
        """For two symbols that stand side by side (``left << 32 | right``): the rank of the piece
        they make (equal scores, equal ranks) and that piece. A character without a piece of its
        own is a symbol past the pieces."""
        places = {s: k for k, s in enumerate(sorted({self.score[i] for i in self.merge.values()}, reverse=True))}
        self.char: dict[str, int] = {}
        for p in self.merge:
            for c in p:
                self.char.setdefault(c, self.merge.get(c, len(self.piece) + len(self.char)))
        symbol = self.char | self.merge
        self.rank: dict[int, int] = {}
        self.into: dict[int, int] = {}
        for p, i in self.merge.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    self.rank[left << 32 | right] = places[self.score[i]]
                    self.into[left << 32 | right] = i

        pieces_only = max(self.char.values(), default=0) < len(self.piece)
        self.vector = self.vector and pieces_only
        self.table = PairTable(self.rank, self.into) if self.vector else None
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            self.symbol[ord(c)] = i

    def learn(self, parts: set[str]) -> None:
        """Put the ids of parts that the cache doesn't hold into it, merged side by side."""
        found = [p for p in parts if p not in self.parts and p not in self.parts.old and 1 < len(p) <= SHORT] if self.vector else []
        for lo in range(0, len(found), SIDE_BY_SIDE):
            some = found[lo:lo + SIDE_BY_SIDE]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            sym = self.symbol[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")]
            whole = np.minimum.reduceat(sym, np.cumsum(sizes) - sizes) >= 0     # the others hold byte pieces
            sym = sym[np.repeat(whole, sizes)]
            for k, ids in zip(np.flatnonzero(whole).tolist(), self.table.merge(sym, sizes[whole])):
                self.parts[some[k]] = ids
        if len(self.parts) >= CACHE:
            self.parts.old = dict(self.parts)
            self.parts.clear()

    def merged(self, part: str) -> list[int]:
        """Ids of a part of the normalised text."""
        if not self.resegment and not self.users and len(part) <= SHORT:
            return self._merge_short(part)
        together, out, start = self.together, [], 0
        for k in range(1, len(part) + 1):
            if k == len(part) or (part[k - 1:k + 1] not in together and not self.users):
                out += self._merge_symbols(part[start:k])
                start = k
        return out

    def _merge_short(self, text: str) -> list[int]:
        """The same for a few symbols without user-defined or unused pieces: ranks in a list."""
        rank, into, none = self.rank.get, self.into, len(self.piece)
        sym = [self.char.get(c, -1) for c in text]
        known = len(self.piece)
        if -1 in sym or max(sym) >= known:             # characters without a piece
            own = {-1 - k: c for k, c in enumerate(text) if self.char.get(c, known) >= known}
            sym = [self.char.get(c, -1 - k) for k, c in enumerate(text)]
        else:
            own = {}
        ranks = [rank(a << 32 | b, none) if a >= 0 and b >= 0 else none for a, b in zip(sym, sym[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            whole = into[sym[i] << 32 | sym[i + 1]]
            sym[i:i + 2] = [whole]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(whole << 32 | sym[i + 1], none) if sym[i + 1] >= 0 else none
            if i:
                ranks[i - 1] = rank(sym[i - 1] << 32 | whole, none) if sym[i - 1] >= 0 else none
        if not own:
            return sym
        chars = {i: c for c, i in self.char.items() if i >= known} | own
        out: list[int] = []
        for s in sym:
            if s in chars:
                self._emit(chars[s], {}, out)
            else:
                out.append(s)
        return out

    def _symbols(self, text: str) -> tuple[list[str], list[bool]]:
        if self.users is None:
            return list(text), [False] * len(text)
        out, frozen, at = [], [], 0
        for user in self.users.finditer(text):
            out += text[at:user.start()]
            frozen += [False] * (user.start() - at)
            out.append(user.group())
            frozen.append(True)
            at = user.end()
        out += text[at:]
        frozen += [False] * (len(text) - at)
        return out, frozen

    def _merge_symbols(self, text: str) -> list[int]:
        merge, score = self.merge, self.score
        sym, frozen = self._symbols(text)
        n = len(sym)
        undo: dict[str, tuple[str, str]] = {}
        heap = []

        def offer(i: int, j: int) -> None:
            if frozen[i] or frozen[j]:
                return
            whole = sym[i] + sym[j]
            found = merge.get(whole)
            if found is not None:
                heappush(heap, (-score[found], i, j, whole))
                if self.resegment and self.kind[found] == UNUSED:
                    undo[whole] = (sym[i], sym[j])

        for i in range(n - 1):
            offer(i, i + 1)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, j, whole = heappop(heap)
            if not sym[i] or not sym[j] or after[i] != j or len(sym[i]) + len(sym[j]) != len(whole):
                continue
            sym[i], sym[j] = whole, ""
            right, left = after[j], before[i]
            after[i] = right
            if right < n:
                before[right] = i
                offer(i, right)
            if left >= 0:
                offer(left, i)
        out: list[int] = []
        for s in sym:
            if s:
                self._emit(s, undo, out)
        return out

    def _emit(self, s: str, undo: dict[str, tuple[str, str]], out: list[int]) -> None:
        found = self.merge.get(s)
        if found is None:
            if self.fallback:
                out += [self.bytes_[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        elif self.kind[found] == UNUSED and s in undo:
            for half in undo[s]:
                self._emit(half, undo, out)
        else:
            out.append(found)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): piece k covers the source bytes bounds[k] to bounds[k+1]."""
        if self.normaliser.simple:
            norm, note = self.normaliser.escaped(text)
        else:
            raw, note = self.normaliser.normalise(text)
            norm = raw.decode("utf-8", "replace")
        parts = self.cut.findall(norm) if self.cut else [norm] if norm else []
        self.learn(set(parts))
        return self._joined(norm, note, parts)

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``encode`` for many texts: parts new to the cache merge side by side."""
        if not (self.vector and self.cut and self.normaliser.simple):
            return [self.encode(t) for t in texts]
        cut = []
        for text in texts:
            norm, note = self.normaliser.escaped(text)
            cut.append((norm, note, self.cut.findall(norm)))
        self.learn(set().union(*(parts for _, _, parts in cut)))
        return [self._joined(*c) for c in cut]

    def _joined(self, norm: str, note: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), "<i4")
        sizes = self.size[ids]
        if not self.fallback and self.unknown in ids:
            ids, sizes = self._unknown_runs(norm, ids.tolist(), sizes)
        places = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=places[1:])
        return ids, note[places]

    def _unknown_runs(self, norm: str, ids: list[int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring unknown pieces as one, with the bytes under them."""
        raw, at, out, size = norm.encode(), 0, [], []
        for i, s in zip(ids, sizes.tolist()):
            if i == self.unknown:
                s = 1
                while at + s < len(raw) and raw[at + s] & 0xC0 == 0x80:
                    s += 1
                if out and out[-1] == i:
                    size[-1] += s
                    at += s
                    continue
            out.append(i)
            size.append(s)
            at += s
        return np.array(out, "<i4"), np.array(size, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; broken byte sequences give a replacement mark a byte."""
        own, said = self.normaliser, self.said
        start = 0
        while start < len(ids) and not said[ids[start]]:
            start += 1
        raw = list(map(said.__getitem__, ids))
        if start < len(ids) and self.kind[ids[start]] not in (BYTE, UNKNOWN) and (own.dummy or own.squeeze):
            raw[start] = raw[start].lstrip(b" ") if own.squeeze else raw[start].removeprefix(b" ")
        if self.controls.isdisjoint(ids[:-1]):
            return _text(b"".join(raw))
        out, run = [], []                 # a control piece ends a run of byte pieces
        for i, part in zip(ids, raw):
            if part or i not in self.controls:
                run.append(part)
            else:
                out.append(_text(b"".join(run)))
                run = []
        return "".join(out) + _text(b"".join(run))


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "\ufffd", raw.decode("utf-8", "surrogateescape"))


@lru_cache(maxsize=2)
def model(raw: bytes) -> Model:
    return Model(raw)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", end: bool = True) -> DataFrame:
    """key, ``ids`` (an end id last if ``end``), ``bounds`` (source bytes; one more than pieces,
    the end id has none), ``decoded``, a row for every row of ``docs``."""
    on_workers(docs.sparkSession)
    with open(path, "rb") as f:            # the driver reads the file, workers get its bytes
        raw = f.read()

    def run(batches):
        m = model(raw)
        last = np.array([m.end_id] if end else [], "<i4")
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids, bounds, said, n_ids, n_bounds = [], [], [], [0], [0]
                for own, spans in m.encode_all([text or b"" for text in part.column(1).to_pylist()]):
                    own = np.concatenate([own, last])
                    said.append(m.decode(own.tolist()))
                    ids.append(own)
                    bounds.append(spans.astype(np.int32))
                    n_ids.append(n_ids[-1] + len(own))
                    n_bounds.append(n_bounds[-1] + len(spans))
                lists = [pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(np.concatenate(v) if v else np.zeros(0, np.int32)))
                         for n, v in ((n_ids, ids), (n_bounds, bounds))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(said, pa.string())], [key, "ids", "bounds", "decoded"])

    d = docs.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").cast("binary").alias("text"))
    return spread(d, key).mapInArrow(run, f"`{key}` bigint, ids array<int>, bounds array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The query's columns, and a digest of the bounds in decimal, joined by one blank."""
    listed = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " ").cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), listed("ids").alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), listed("bounds").alias("bounds_sha256"))
