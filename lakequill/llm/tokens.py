"""Encoding whole texts with a public tokenizer."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
END = 2
#: Marks that are neither letters, numbers nor blanks.
_MARKS = ".,!?;:*%&$#|)"
#: Longer runs of marks stay with their words.
_MARKS_IN_A_ROW = 8
_BLANKS = re.compile(r"\s\s")
_RARE_BLANKS = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"


def _blanks_meet(raw: bytes) -> bool:
    """Whether two blanks stand side by side; the pattern is only tried where a text has rarer blanks."""
    if b"  " in raw or b"\n\n" in raw or b"\n " in raw or b" \n" in raw:
        return True
    if len(raw.translate(None, _RARE_BLANKS)) < len(raw) or any(lead in raw for lead in (b"\xc2", b"\xe1", b"\xe2", b"\xe3")):
        return _BLANKS.search(raw.decode("utf-8", "replace")) is not None
    return False


def _among(signs: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(signs)] = True
    return found


_IS_MARK = _among(_MARKS.encode())
_IS_ALNUM = _among(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: The lowest bytes of a number, by how many.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype="<u8")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Table:
    """Places of words of up to 24 bytes, which are their own keys: three numbers, compared whole. Place 0 is no word's."""

    SIZE = 24
    _FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype="<u8")

    def __init__(self, room: int) -> None:
        self.keys = np.zeros((room, 3), dtype="<u8")
        bits = int(room).bit_length() + 1
        self.slots, self.shift = np.zeros(1 << bits, dtype=np.int32), np.uint64(64 - bits)

    def clear(self) -> None:
        self.slots[:] = 0

    def grow(self, room: int, places: np.ndarray) -> None:
        """Room for more places; those given have keys."""
        old = self.keys[places]
        self.__init__(room)
        self.put(old, places)

    @classmethod
    def keys_of(cls, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of stretches of up to 24 bytes, of which only the first may be NUL; as many bytes follow the last one."""
        view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        keys = np.zeros((len(starts), 3), dtype="<u8")
        keys[:, 0] = view[starts] & _LOW[np.minimum(sizes, 8)]
        longer = np.flatnonzero(sizes > 8)
        for k in (1, 2):
            keys[longer, k] = view[starts[longer] + 8 * k] & _LOW[np.minimum(sizes[longer] - 8 * k, 8)]
            longer = longer[sizes[longer] > 16]
        return keys

    def hashes(self, keys: np.ndarray) -> np.ndarray:
        a, b, c, d = self._FACTORS
        h = keys[:, 0] * a + keys[:, 1] * b + keys[:, 2] * c
        h ^= h >> np.uint64(32)
        h *= d
        return h

    def _differ(self, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        d = np.take(self.keys, places, axis=0)
        d ^= keys
        return (d[:, 0] | d[:, 1] | d[:, 2]) != 0

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places, 0 where there is none."""
        at = (hashes >> self.shift).astype(np.int64)
        places = self.slots[at]
        open_ = np.flatnonzero((places > 0) & self._differ(places, keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            places[open_] = now = self.slots[at[open_]]
            open_ = open_[(now > 0) & self._differ(now, keys[open_])]
        return places

    def put(self, keys: np.ndarray, places: np.ndarray) -> None:
        """New keys, each once."""
        self.keys[places] = keys
        at = (self.hashes(keys) >> self.shift).astype(np.int64)
        while len(places):
            free = self.slots[at] == 0
            self.slots[at[free]] = places[free]
            # of those that meet in a slot one stays
            left = self.slots[at] != places
            at, places = (at[left] + 1) & (len(self.slots) - 1), places[left]

    @staticmethod
    def distinct(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key comes first, and the number of each among these."""
        _, first, each = np.unique(hashes, return_index=True, return_inverse=True)
        if (keys[first][each] != keys).any():
            _, first, each = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        return first, each.ravel()


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    A byte-level BPE tokenizer never lets a token reach over a blank between two words, which goes to the second. Words
    with the blank before them are thus encoded once, by the tokenizers library, and looked up from then on; a text with
    two blanks in a row, in which such cuts could change tokens, is encoded as a whole. Marks between a letter or number
    and a blank are tokens of their own, so they are looked up apart from their word; a text in which such marks turn out
    to follow another sign is encoded as a whole. The memory of words is bounded; it is a table of numbers, in which all
    words of many texts are looked up at once.
    """

    def __init__(self, path: str, most: int = 1_500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.calls = most, 0
        named = self.tokenizer.get_vocab()
        top = max(named.values())
        self.begins = {sign: np.zeros(top + 1, dtype=bool) for sign in " \n"}
        for sign, shown in ((" ", "Ġ"), ("\n", "Ċ")):
            self.begins[sign][[i for t, i in named.items() if t.startswith(shown)]] = True
        self.line = named.get("Ċ", -1)
        room = most + most // 4 + 1024
        self.table = _Table(room)
        self.starts, self.sizes, self.loose = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int32), np.zeros(room, dtype=bool)
        self.known = np.zeros(4 * room, dtype="<u2" if top <= 0xFFFF else "<u4")
        self._forget()

    def _forget(self) -> None:
        #: Places given away, and ids held.
        self.held, self.n_ids = 1, 0
        self.table.clear()
        #: Places of longer words.
        self.long: dict[bytes, int] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        ids = self._ids(texts)
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int64)

    def _together(self, words: list[str], blank: str) -> tuple[np.ndarray, np.ndarray]:
        """As _each(), of words that begin with the blank and have no other, encoded as one text: its token begins a word."""
        got = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.append(np.flatnonzero(self.begins[blank][got]), len(got))
        return (got, np.diff(cuts)) if len(cuts) == len(words) + 1 and cuts[0] == 0 else self._each(words)

    def _learn(self, words: list[bytes], places: np.ndarray) -> None:
        """Encodes new words. The first of a text, after NUL, have the ids that follow a line's."""
        kinds: dict[int, list[int]] = {0: [], 10: [], 32: [], -1: []}
        for i, w in enumerate(words):
            kinds[w[0] if len(w) > 1 and w[0] in b"\0\n " else -1].append(i)
        for kind in (0, 10, 32):
            blank = " " if kind == 32 else "\n"
            for k in range(0, len(kinds[kind]), 4096):
                some = kinds[kind][k : k + 4096]
                text = b"".join([words[i] for i in some]).decode("utf-8", "replace")
                text = text.replace("\0", "\n") if kind == 0 else text
                named = text.split(blank)[1:]
                if named != text.split():  # rarer blanks
                    fine = [w.split() == [w] for w in named]
                    kinds[-1] += [i for i, f in zip(some, fine, strict=True) if not f]
                    some, named = [i for i, f in zip(some, fine, strict=True) if f], [w for w, f in zip(named, fine, strict=True) if f]
                if not some:
                    continue
                ids, sizes = self._together([blank + w for w in named], blank)
                if kind == 0:
                    first = np.cumsum(sizes) - sizes
                    if (ids[first] == self.line).all():
                        ids, sizes = np.delete(ids, first), sizes - 1
                    else:
                        ids, sizes = self._each(named)
                self._hold(places[some], ids, sizes)
        if kinds[-1]:
            texts = [words[i].removeprefix(b"\0").decode("utf-8", "replace") for i in kinds[-1]]
            self._hold(places[kinds[-1]], *self._each(texts))

    def _hold(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.n_ids + len(ids) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros(len(self.known) + len(ids), dtype=self.known.dtype)])
        self.known[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[places] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[places] = sizes
        self.n_ids += len(ids)

    def _places(self, n: int) -> np.ndarray:
        """New places."""
        first, self.held = self.held, self.held + n
        if self.held > len(self.starts):
            room = 2 * self.held
            at = np.setdiff1d(np.arange(1, first), np.fromiter(self.long.values(), dtype=np.int64, count=len(self.long)))
            self.table.grow(room, at)
            for name in ("starts", "sizes", "loose"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(room - len(old), dtype=old.dtype)]))
        return np.arange(first, self.held)

    @staticmethod
    def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin and end, each with the blank or NUL before it, and which are marks cut off from the word before."""
        low = np.flatnonzero(data <= 32)
        sign = data[low]
        starts = low[(sign == 32) | (sign == 10) | (sign == 0)]
        ends = np.append(starts[1:], len(data))
        at = np.flatnonzero(_IS_MARK[data[ends - 1]])
        cuts = ends[at] - 1
        more = np.arange(len(at))
        for _ in range(_MARKS_IN_A_ROW):
            more = more[_IS_MARK[data[cuts[more] - 1]]]
            cuts[more] -= 1
        before = data[cuts - 1]
        fine = _IS_ALNUM[before] | (before >= 128)
        at, cuts = at[fine], cuts[fine]
        marks = np.zeros(len(starts) + len(at), dtype=bool)
        marks[at + 1 + np.arange(len(at))] = True
        begin, end = np.empty(len(marks), dtype=np.int64), np.empty(len(marks), dtype=np.int64)
        begin[marks], end[marks] = cuts, ends[at]
        ends[at] = cuts
        begin[~marks], end[~marks] = starts, ends
        return begin, end, marks

    def _words(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words of a text; new words are encoded."""
        sizes = ends - starts
        long = np.flatnonzero(sizes > _Table.SIZE)
        short = np.flatnonzero(sizes <= _Table.SIZE) if len(long) else slice(None)
        keys = _Table.keys_of(text + bytes(_Table.SIZE + 8), starts[short], sizes[short])
        hashes = self.table.hashes(keys)
        found = self.table.find(keys, hashes).astype(np.int64)
        out = np.empty(len(starts), dtype=np.int64)
        missing = np.flatnonzero(found == 0)
        if len(missing):
            first, each = _Table.distinct(keys[missing], hashes[missing])
            new = self._places(len(first))
            found[missing] = new[each]
            first = missing[first]
            self.table.put(keys[first], new)
            self._new(text, starts[short][first], ends[short][first], new)
        out[short] = found
        if len(long):
            words = [text[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            fresh = {w: i for w, i in zip(words, long.tolist(), strict=True) if w not in self.long}
            if fresh:
                new = self._places(len(fresh))
                self.long.update(zip(fresh, new.tolist(), strict=True))
                first = np.array(list(fresh.values()))
                self._new(text, starts[first], ends[first], new)
            out[long] = [self.long[w] for w in words]
        return out

    def _new(self, text: bytes, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> None:
        words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        last = np.frombuffer(text, dtype=np.uint8)[ends - 1]
        loose = ~_IS_ALNUM[last]
        for i in np.flatnonzero(last >= 128).tolist():
            loose[i] = not words[i].decode("utf-8", "replace")[-1].isalnum()
        self.loose[places] = loose
        self._learn(words, places)

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Null has no ids."""
        out = [np.zeros(0, dtype="<u4")] * len(texts)
        if self.held > self.most or self.n_ids > 4 * self.most:
            self._forget()
        whole, cut, some = [], [], []
        for i, raw in enumerate(texts):
            if not raw:
                continue
            # NUL marks where texts begin
            if b"\0" in raw or _blanks_meet(raw):
                whole.append(i)
            else:
                cut.append(i)
                some += b"\0", raw
        if cut:
            text = b"".join(some)
            data = np.frombuffer(text, dtype=np.uint8)
            starts, ends, marks = self._cut(data)
            words = self._words(text, starts, ends)
            first = np.flatnonzero(data[starts] == 0)
            begin, size = self.starts[words], self.sizes[words]
            after = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            ids = self.known[np.repeat(begin - after[:-1], size) + np.arange(after[-1])].astype("<u4")
            bounds = [*after[first].tolist(), len(ids)]
            for i, a, b in zip(cut, bounds[:-1], bounds[1:], strict=True):
                out[i] = ids[a:b]
            wrong = np.flatnonzero(marks[1:] & self.loose[words[:-1]]) + 1
            whole += [cut[k] for k in np.unique(np.searchsorted(first, wrong, side="right") - 1)]
        for i, ids in zip(whole, self._ids([texts[i].decode("utf-8", "replace") for i in whole]), strict=True):
            out[i] = np.frombuffer(ids, dtype="<u4")
        return out

    def batches(self, texts: list[bytes | None], most: int = 4 << 20):
        """Ids of texts, about so many bytes of them at a time."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t or b"") + 16
            if size >= most:
                yield from self(some)
                some, size = [], 0
                self.calls += 1
                # what encoding leaves behind would pile up
                if self.calls % 1 == 0:
                    common.trim()
        yield from self(some)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


common.REMEMBERED["encoder"] = encoder.cache_clear


def ids_of(column: pa.Array, path: str):
    yield from encoder(path).batches(common.raw(column))
