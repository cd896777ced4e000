"""Token ids of whole texts, with the ids of repeated units remembered.

A unit is a stretch between places that no pre-token crosses: white space, or before a blank with a word after
it; the end of a run of letters. The ids of a text are then those of its units one after another, so a worker has the library encode each
distinct unit once. Which places are safe depends on the tokenizer file; the texts of a file of unknown kind, and
texts with the string of an added token, go to the library as a whole. Units of a batch are matched by 64-bit
hash and length.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from strideframe.llm.text import SPACE, Words, flat, gather, span_hashes

#: White space beyond ASCII; a text with any goes to the library if blanks belong to the word after them.
_WIDE = re.compile("[\x85\xa0  -     　]")
_WIDE_FIRST = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Marks that compose with the letter before them: changing case and composing don't commute then.
_MARK = re.compile("[\u0300-\u036f]")
_MARK_FIRST = np.isin(np.arange(256), [0xCC, 0xCD])
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_LATIN = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
_PLAIN = (np.arange(256) < 0x80) & ~_LETTER & ~SPACE
#: Units that a worker remembers (about 200 bytes each); when there are more, it starts anew, with these in reserve.
MEMORY = 500_000


def _after_letters(data: np.ndarray) -> np.ndarray:
    """Places before an ASCII sign or digit with an ASCII or Latin-1 letter before it: a run of letters, and so a pre-token, ends there."""
    letter = _LETTER[data]
    letter[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
    return np.flatnonzero(letter[:-1] & _PLAIN[data[1:]]) + 1


class Codec:
    memory = MEMORY

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.kind = ""
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]:
            self.kind = "blank_first"
        elif any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") and not re.search(r"(?<!\[\^)\\s| |\.", x["pattern"].get("Regex", " ")) for x in pre.get("pretokenizers", ())):
            self.kind = "words"
        self.added = [x["content"].encode() for x in spec["added_tokens"]]
        size = self.library.get_vocab_size()
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Data, starts and ends of units, first unit of each text."""
        if self.kind == "words":
            w = Words(column, SPACE, lower=True)  # such files lower-case
            if not len(w.start):
                return w.data, w.start, w.end, w.first
            inside = np.zeros(len(w.data) + 1, bool)
            inside[w.start] = True
            inside[_after_letters(w.data)] = True
            start = np.flatnonzero(inside)
            end = np.append(start[1:], len(w.data))
            last = np.searchsorted(start, w.end) - 1  # the unit that a word ends with
            end[last] = w.end
            return w.data, start, end, np.searchsorted(start, flat(column)[1])
        data, offsets = flat(column)
        if not len(data):
            return data, offsets[:0], offsets[:0], np.zeros_like(offsets)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-2] = (data[1:-1] == 0x20) & ~SPACE[data[2:]]
        cut[offsets] = True  # a blank before the end of a text starts a unit here, but it is the end's own
        late = offsets[1:] - 1
        late = late[(late > 0) & (late > offsets[:-1])]
        cut[late] &= np.isin(late, offsets)
        cut[_after_letters(data)] = True
        start = np.flatnonzero(cut[:-1])
        return data, start, np.append(start[1:], len(data)) if len(start) else start, np.searchsorted(start, offsets)

    def _whole(self, column: pa.Array) -> np.ndarray:
        """Which texts only the library may cut."""
        data, offsets = flat(column)
        if not self.kind:
            return np.ones(len(column), bool)
        raw = data.tobytes()
        out = np.zeros(len(column), bool)
        marks = any(a in raw for a in self.added)
        first, odd = (_WIDE_FIRST, _WIDE) if self.kind == "blank_first" else (_MARK_FIRST, _MARK)
        rare = first[data].any()
        if marks or rare:
            for i, t in enumerate(column.to_pylist()):
                out[i] = bool(rare and odd.search(t)) or (marks and any(a in t.encode() for a in self.added))
        return out

    def _ids_of_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets by distinct unit, and the distinct unit of each unit."""
        keys = span_hashes(data, start, end) + (end - start).astype(np.uint64)
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        raw, memo = data.tobytes(), self.memo
        units = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        held = list(map(memo.get, units))
        if None in held:
            fresh = [u for u, x in zip(units, held) if x is None]
            if len(memo) + len(fresh) > self.memory:
                self.older, self.memo = memo, {}
                memo, fresh = self.memo, units
            if self.older:
                older = self.older
                memo.update((u, older[u]) for u in fresh if u in older)
                fresh = [u for u in fresh if u not in memo]
            for k in range(0, len(fresh), 20_000):
                part = fresh[k : k + 20_000]
                for unit, e in zip(part, self.library.encode_batch_fast([u.decode() for u in part], add_special_tokens=False)):
                    memo[unit] = np.array(e.ids, self.width).tobytes()
            held = list(map(memo.__getitem__, units))
        offsets = np.zeros(len(held) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) // self.width.itemsize, out=offsets[1:])
        return np.frombuffer(b"".join(held), self.width), offsets, back

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and the offsets of the texts; `column` holds strings without nulls."""
        whole = self._whole(column)
        if not whole.any():
            data, start, end, first = self._units(column)
            ids, by_unit, of = self._ids_of_units(data, start, end)
            ids, ends = gather(ids, by_unit, of)
            return ids, ends[first]
        parts, texts = [np.zeros(0, self.width)], column.to_pylist()
        for i, t in enumerate(texts):
            own = np.array(self.library.encode(t, add_special_tokens=False).ids, self.width) if whole[i] else self.encode(pa.array([t], pa.string()))[0]
            parts.append(own)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        whole = self._whole(column)
        if whole.any():
            return np.diff(self.encode(column)[1])
        data, start, end, first = self._units(column)
        _, by_unit, of = self._ids_of_units(data, start, end)
        sums = np.zeros(len(of) + 1, np.int64)
        np.cumsum(np.diff(by_unit)[of], out=sums[1:])
        return np.diff(sums[first])

    @cached_property
    def token_table(self) -> tuple[bytes, ...]:
        """UTF-8 of each id's token with a blank after it; ids without a token have none."""
        tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        return tuple(b"" if t is None else t.encode() + b" " for t in tokens)

    @cached_property
    def joins(self) -> bool:
        """Whether the library decodes by joining tokens with a blank, as it does without a decoder."""
        return json.loads(self.library.to_str())["decoder"] is None and not any(b"\0" in t for t in self.token_table)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of each list of ids, special tokens included."""
        if not self.joins:
            return [self.library.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(offsets[:-1], offsets[1:])]
        return joined(self.token_table, ids, offsets)


def joined(table: tuple[bytes, ...], ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each list of ids their entries, each of which ends with a blank, without the last blank."""
    cells, lengths, wide = _cells(table)
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(lengths[ids], out=ends[1:])
    raw, at = cells[ids].tobytes().translate(None, b"\0"), ends[offsets]
    out = [raw[a : b - 1] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    for i in np.unique(np.searchsorted(offsets, np.flatnonzero(wide[ids]), "right") - 1).tolist():
        out[i] = b"".join([table[k] for k in ids[offsets[i] : offsets[i + 1]]])[:-1]
    return out


@lru_cache(4)
def _cells(table: tuple[bytes, ...], most: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries up to `most` bytes in cells of equal width, filled up with zero bytes; their lengths; which entries are longer."""
    wide = np.array([len(x) > most for x in table])
    cells = np.array([b"" if w else x for x, w in zip(table, wide)], np.bytes_)
    return cells, np.array([0 if w else len(x) for x, w in zip(table, wide)], np.int64), wide


@lru_cache(2)
def decimal_table(n: int) -> tuple[bytes, ...]:
    return tuple(b"%d " % i for i in range(n))


def decimals(ids: np.ndarray, offsets: np.ndarray, size: int) -> list[bytes]:
    """Each list of ids in decimal, joined by blanks."""
    return joined(decimal_table(size), ids, offsets)


@lru_cache(4)
def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    return Codec(path)
