"""Byte-pair encoding in bounded working memory: pre-token cutting, merging and incremental decoding.

Everything here runs inside tasks on pieces of bounded size; the operators that spread the work are in
``token_transducer`` and ``token_store``. The tables are built once on the driver and broadcast.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

NO_RANK = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)
# fixed values: code points of Unicode white space, and the endings that the pre-token pattern takes after an apostrophe
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")
PIECE_CHARS = 1 << 20
WORD_BYTES = 96
HASH_BITS = 18


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def character_classes() -> np.ndarray:
    """Space, letter, number or other for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def sufficient_lookahead(merges: Sequence[tuple[bytes, bytes]]) -> int:
    """How many bytes after a token decide it, for any text.

    Text that follows can only change a token through a chain of merges that reaches back: each merge of the
    chain takes a left part whose right part begins with the left part of the merge before it, and comes later in
    the list. The longest such chain, counted in bytes of its left parts, bounds how far a change reaches.
    """
    reach: dict[bytes, int] = {}
    longest = 1
    for left, right in merges:
        before = max((reach.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
        total = len(left) + before
        if total > reach.get(left, 0):
            reach[left] = total
        longest = max(longest, total)
    return longest


class MergeTables:
    """A byte-level vocabulary as arrays: pair ranks in a probing table, token bytes, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            described = json.load(handle)
        model, to_byte = described["model"], printable_bytes()
        vocabulary = {word: i for word, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]

        def raw(word: str) -> bytes:
            return bytes(to_byte[c] for c in word)

        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for word, i in vocabulary.items():
            if word not in self.special:
                self.token_bytes[i] = raw(word)
        for word, i in self.special.items():
            self.token_bytes[i] = word.encode()
        self.byte_id = np.zeros(256, np.int32)
        for word, b in to_byte.items():
            self.byte_id[b] = vocabulary[word]
        self.merged = np.fromiter((vocabulary[a + b] for a, b in pairs), np.int32, len(pairs))
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.classes = character_classes()
        self._fill([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs])

    def _fill(self, keys: list[int]) -> None:
        slots = 1 << HASH_BITS
        self.keys = np.full(slots, -1, np.int64)
        self.ranks = np.full(slots, NO_RANK, np.int32)
        for rank, (key, slot) in enumerate(zip(keys, self._slots(np.array(keys, np.int64)).tolist(), strict=True)):
            while self.keys[slot] != -1:
                slot = (slot + 1) & (slots - 1)
            self.keys[slot], self.ranks[slot] = key, rank

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, or NO_RANK."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        found, out = self.keys[slots], self.ranks[slots]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = NO_RANK
        mask = (1 << HASH_BITS) - 1
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def word_starts(points: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for code points of texts that start at ``begins``."""
    count = len(points)
    kind = classes[points]
    run = np.ones(count, bool)
    run[1:] = kind[1:] != kind[:-1]
    first = np.zeros(count, bool)
    first[begins[begins < count]] = True
    run |= first
    start = run.copy()
    # a run of white space before other text leaves its last character to that text
    after = np.flatnonzero(run & ~first & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # an apostrophe alone takes some endings
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[mark + 1 < count]
    mark = mark[run[mark] & run[mark + 1] & ~first[mark + 1]]
    one = mark[np.isin(points[mark + 1], [ord(c) for c in SHORT_ENDINGS])]
    two = mark[mark + 2 < count]
    two = two[~first[two + 2]]
    pairs = (points[two + 1].astype(np.int64) << 32) | points[two + 2]
    two = two[np.isin(pairs, [(ord(a) << 32) | ord(b) for a, b in LONG_ENDINGS])]
    for ends, length in ((one, 2), (two, 3)):
        start[ends + 1] = False
        start[ends[ends + length < count] + length] = True
    return start


def merge_words(symbols: np.ndarray, starts: np.ndarray, tables: MergeTables) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many words and the number of tokens of each; words start at ``starts`` in ``symbols``.

    Every round merges the best pair of every unfinished word, wherever it stands in the word.
    """
    words = len(starts)
    lengths = np.diff(np.append(starts, len(symbols)))
    word = np.repeat(np.arange(words, dtype=np.int32), lengths)
    rank = np.full(len(symbols), NO_RANK, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = tables.pair_ranks(symbols[inner], symbols[inner + 1])
    done_word, done_symbol = [], []
    while len(symbols):
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.append(begins, len(symbols)))
        each = np.repeat(best, sizes)
        over = each == NO_RANK
        if over.any():
            done_word.append(word[over])
            done_symbol.append(symbols[over])
            left = ~over
            symbols, word, rank, each = symbols[left], word[left], rank[left], each[left]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == each)
        # equal neighbours: of a chain of overlapping pairs every second one merges
        chain = np.append(True, np.diff(hit) != 1)
        place = np.arange(len(hit))
        hit = hit[(place - place[chain][np.cumsum(chain) - 1]) % 2 == 0]
        symbols[hit] = tables.merged[rank[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        place = (np.cumsum(keep) - 1)[hit]
        symbols, word, rank = symbols[keep], word[keep], rank[keep]
        touched = np.concatenate([place, place[place > 0] - 1])
        rank[touched] = NO_RANK
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched] = tables.pair_ranks(symbols[touched], symbols[touched + 1])
    all_words, all_symbols = np.concatenate(done_word), np.concatenate(done_symbol)
    order = np.argsort(all_words, kind="stable")
    return all_symbols[order], np.bincount(all_words, minlength=words)


class Transducer:
    """Encodes one pre-token of any length byte by byte: tokens leave once enough bytes follow them.

    Holds at most ``window`` bytes; ``window`` exceeds the lookahead by at least one longest token.
    """

    def __init__(self, tables: MergeTables):
        self.tables = tables
        longest = max(map(len, tables.token_bytes))
        self.window = 4 * (tables.lookahead + longest)
        self.buffer = b""

    def _tokens(self) -> np.ndarray:
        symbols = self.tables.byte_id[np.frombuffer(self.buffer, np.uint8)]
        return merge_words(symbols, np.zeros(1, np.int64), self.tables)[0]

    def feed(self, data: bytes) -> Iterator[np.ndarray]:
        for at in range(0, len(data), self.window):
            self.buffer += data[at : at + self.window]
            if len(self.buffer) < self.window:
                continue
            ids = self._tokens()
            ends = np.cumsum([len(self.tables.token_bytes[i]) for i in ids.tolist()])
            stable = int(np.searchsorted(ends, len(self.buffer) - self.tables.lookahead, side="right"))
            if stable:
                yield ids[:stable]
                self.buffer = self.buffer[int(ends[stable - 1]) :]

    def close(self) -> np.ndarray:
        ids = self._tokens() if self.buffer else np.zeros(0, np.int32)
        self.buffer = b""
        return ids


def distinct_words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one representative per different word, and for every word the number of its representative."""
    lengths = np.diff(np.append(starts, len(raw)))
    offset = np.arange(len(raw)) - np.repeat(starts, lengths)
    powers = np.ones(WORD_BYTES + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(WORD_BYTES, 0x9E3779B97F4A7C15, np.uint64))
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(offset, WORD_BYTES)]
    code = np.add.reduceat(mixed, starts)
    code ^= code >> np.uint64(29)
    _, chosen, number = np.unique(code, return_index=True, return_inverse=True)
    # words that only share their code get representatives of their own
    twin = starts[chosen][number]
    same = lengths == lengths[chosen][number]
    at = np.repeat(np.where(same, twin, starts), lengths) + offset
    same &= np.logical_and.reduceat(raw[at] == raw, starts)
    odd = np.flatnonzero(~same)
    number = number.copy()
    number[odd] = len(chosen) + np.arange(len(odd))
    return np.concatenate([chosen, odd]), number


def _pieces(text: str, special: dict[str, int]) -> Iterator[str | int]:
    """A text cut at special strings, each of which is one id."""
    if not any(s in text for s in special):
        yield text
        return
    # the longest of several that begin at the same place
    names = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
    end = 0
    for found in names.finditer(text):
        if found.start() > end:
            yield text[end : found.start()]
        yield special[found[0]]
        end = found.end()
    if end < len(text):
        yield text[end:]


def cut_words(parts: Sequence[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all parts, the byte at which each pre-token starts, and the number of pre-tokens of each part."""
    joined = "".join(parts)
    raw = np.frombuffer(joined.encode(), np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    start = np.flatnonzero(word_starts(points, begins, classes)) if len(points) else np.zeros(0, np.int64)
    width = np.ones(len(points), np.int64) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.cumsum(width) - width
    bounds = np.append(begins, len(points))
    counts = np.diff(np.searchsorted(start, bounds))
    return raw, place[start] if len(points) else start, counts


def encode_parts(parts: Sequence[str], tables: MergeTables, encode_distinct=None) -> list[np.ndarray]:
    """Token ids of each part; parts together are of bounded size.

    ``encode_distinct`` may replace the merging of the different words (bytes, one list of ids each).
    """
    raw, starts, counts = cut_words(parts, tables.classes)
    if not len(starts):
        return [np.zeros(0, np.int32) for _ in parts]
    chosen, number = distinct_words(raw, starts)
    lengths = np.diff(np.append(starts, len(raw)))
    if encode_distinct is None:
        ids, sizes = _merge_chosen(raw, starts[chosen], lengths[chosen], tables)
    else:
        coded = encode_distinct([raw[s : s + n].tobytes() for s, n in zip(starts[chosen].tolist(), lengths[chosen].tolist(), strict=True)])
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter((i for one in coded for i in one), np.int32, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    word_sizes = sizes[number]
    ends = np.cumsum(word_sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - word_sizes, word_sizes) + np.repeat(first[number], word_sizes)
    out = ids[at]
    per_part = np.append(0, ends)[np.append(0, np.cumsum(counts))]
    return [out[a:b] for a, b in zip(per_part[:-1].tolist(), per_part[1:].tolist(), strict=True)]


def _merge_chosen(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tables: MergeTables) -> tuple[np.ndarray, np.ndarray]:
    short = lengths <= WORD_BYTES
    begin = np.cumsum(lengths[short]) - lengths[short]
    at = np.arange(int(lengths[short].sum())) - np.repeat(begin, lengths[short]) + np.repeat(starts[short], lengths[short])
    ids, sizes = (
        merge_words(tables.byte_id[raw[at]], begin, tables) if len(at) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    )
    if short.all():
        return ids, sizes
    pieces, all_sizes = np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [], np.zeros(len(starts), np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
    for i, piece in zip(np.flatnonzero(short).tolist(), pieces, strict=True):
        out[i] = piece
    for i in np.flatnonzero(~short).tolist():
        machine = Transducer(tables)
        out[i] = np.concatenate([*machine.feed(raw[starts[i] : starts[i] + lengths[i]].tobytes()), machine.close()])
    all_sizes[:] = [len(p) for p in out]
    return np.concatenate(out), all_sizes


def encode_texts(texts: Iterable[str | None], tables: MergeTables, encode_distinct=None) -> Iterator[np.ndarray]:
    """Token ids of each text in order; null counts as empty. Works on about PIECE_CHARS characters at a time."""
    waiting: list[list[str | int]] = []
    size = 0

    def run() -> Iterator[np.ndarray]:
        plain = [p for pieces in waiting for p in pieces if isinstance(p, str)]
        coded = iter(encode_parts(plain, tables, encode_distinct))
        for pieces in waiting:
            own = [next(coded) if isinstance(p, str) else np.array([p], np.int32) for p in pieces]
            yield own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0, np.int32)

    for text in texts:
        waiting.append(list(_pieces(text or "", tables.special)))
        size += len(text or "")
        if size >= PIECE_CHARS:
            yield from run()
            waiting, size = [], 0
    yield from run()


class TextMachine:
    """Turns ids into text piece by piece; an unfinished character waits for its next bytes."""

    def __init__(self, tables: MergeTables):
        self.tables = tables
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        table = self.tables.token_bytes
        return self.decoder.decode(b"".join([table[i] for i in ids.tolist()]))

    def close(self) -> str:
        return self.decoder.decode(b"", True)
