"""Alignment of two tokenizers over the same texts: groups of tokens between shared ends, and how often ids meet.

Both tokenizations of a batch are complete before anything is aligned. Their shared ends before a token that starts
with a space, checked on the bytes, cut the texts into windows; a window is known by its two id tuples, and a worker
aligns each distinct one once. Counts of id pairs are summed by distinct window, then by batch, then over all texts.
They come back to each batch by pair, and each text adds up its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches
from strideframe.llm.text import flat, gather, gathered, mix, span_hashes
from strideframe.llm.tokens import Codec
from strideframe.session import cut_lineage

#: Bytes of text aligned at a time (at least one text); windows, and stretches of each tokenizer, that a worker remembers.
BYTES, MEMORY = 2 << 20, 100_000
#: A pair of ids is one number: that of the first tokenizer times this, and that of the second.
SHIFT = 1 << 32
STAGE = (
    "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "windows binary, codes array<long>, counts array<long>, slots binary, ends binary"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


class ByteTokens(Codec):
    """A byte-level tokenizer; strings of special tokens inside a text are plain text."""

    memory = MEMORY

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.added = []

    @property
    def pieces(self) -> list[bytes]:
        """Bytes of each id: the characters that stand for bytes are the printable ones of Latin-1, the others follow from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        return [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]


class PieceTokens(Codec):
    """A sentencepiece model, which puts a space before the text itself; texts come with that space.

    No piece goes on from another character to a space, so the stretches from a space after another character to the
    next one are encoded each on its own, the distinct ones once.
    """

    memory = MEMORY

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library, self.memo, self.older = self, {}, {}
        self.width, size = np.dtype("<u4"), self.model.get_piece_size()
        self.apart = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(size))

    def _whole(self, column: pa.Array) -> np.ndarray:
        return np.zeros(len(column), bool)

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = flat(column)
        cut = np.zeros(len(data) + 1, bool)
        if self.apart:
            cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        return data, start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(start, offsets)

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        # The model takes an empty text as nothing, but a blank at the end of a text is a piece.
        blank = [self.model.piece_to_id("▁")]
        return [SimpleNamespace(ids=x or blank) for x in self.model.encode([t[1:] for t in texts], num_threads=1)]

    @property
    def pieces(self) -> list[bytes]:
        of = self.model
        return [bytes([int(of.id_to_piece(i)[3:5], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace("▁", " ").encode() for i in range(of.get_piece_size())]


class Side:
    """Ids of one tokenizer over a batch: token bytes by id, and the offsets of the texts in the ids."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.length = np.diff(self.at)

    def text(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.at, ids)[0]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.sides = Side(self.a.pieces), Side(self.b.pieces)
        #: Ids in decimal, in cells filled up with zero bytes.
        names = np.array([b"%d" % i for i in range(max(len(side.length) for side in self.sides))], np.bytes_)
        self.digits = names.view(np.uint8).reshape(len(names), -1)
        self.memo: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}

    def windows(self, keys: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """Of each window, known by its ids on both sides: its groups as text, and its linked pairs of ids, a 64-bit number for each link."""
        (a, a_at), (b, b_at) = (self._one_after_another([k[i] for k in keys]) for i in (0, 1))
        a_end, b_end = (np.cumsum(side.length[ids]) for side, ids in zip(self.sides, (a, b)))
        shared, either = _marks(a_end, b_end)
        # Tokens by group, the first side's before the second's; a sign after each says what follows.
        turn = np.concatenate([2 * np.searchsorted(shared, a_end), 2 * np.searchsorted(shared, b_end) + 1])
        order = np.argsort(turn, kind="stable")
        turn = turn[order]
        sign = np.where(np.diff(turn, append=turn[-1] + 1) == 0, ord(","), np.where(turn % 2, ord(";"), ord("|"))).astype(np.uint8)
        cells = np.column_stack([self.digits[np.concatenate([a, b])[order]], sign])
        ends = np.concatenate([[0], np.cumsum((cells != 0).sum(1))])[a_at + b_at].tolist()
        text = cells.tobytes().translate(None, b"\0")
        codes = a[np.searchsorted(a_end, either)].astype(np.int64) * SHIFT + b[np.searchsorted(b_end, either)]
        links, pairs = (8 * np.searchsorted(either, np.concatenate([[0], a_end])[a_at], "right")).tolist(), codes.tobytes()
        return [(text[i : j - 1], pairs[k:m]) for i, j, k, m in zip(ends, ends[1:], links, links[1:])]

    @staticmethod
    def _one_after_another(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint32), np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Bytes (a space and the text) of the texts that both sides give back, and by side their ids and the offsets of all texts in them."""
        spaced = pa.array([" " + t if t else "" for t in texts.to_pylist()], pa.string())
        data, at = flat(spaced)
        sizes = np.diff(at)
        both = [self.a.encode(spaced), self.b.encode(spaced)]
        both = [(ids.astype(np.uint32), ends) for ids, ends in both]
        ok = sizes > 0
        for side, (ids, ends) in zip(self.sides, both):
            sums = np.concatenate([[0], np.cumsum(side.length[ids])])
            ok &= np.diff(sums[ends]) == sizes
        for side, (ids, ends) in zip(self.sides, both):
            differs = side.text(ids[np.repeat(ok, np.diff(ends))]) != data[np.repeat(ok, sizes)]
            ok[np.unique(np.repeat(np.arange(len(sizes)), np.where(ok, sizes, 0))[differs])] = False
        kept = [(ids[np.repeat(ok, np.diff(ends))], np.concatenate([[0], np.cumsum(np.where(ok, np.diff(ends), 0))])) for ids, ends in both]
        return data[np.repeat(ok, sizes)], kept

    def align(self, texts: pa.Array) -> dict:
        """What the stage table holds of the texts, as columns of the texts and of the batch."""
        data, ((a, a_at), (b, b_at)) = self.tokens(texts)
        a_end, b_end = (np.cumsum(side.length[ids]) for side, ids in zip(self.sides, (a, b)))
        shared, either = _marks(a_end, b_end)
        # A window ends where both sides have an end and the next tokens start with a space, or where the text ends.
        text_ends = np.concatenate([[0], a_end])[a_at]
        after = np.append(data, 0)[shared] == 0x20 if len(shared) else np.zeros(0, bool)
        cuts = shared[after | np.isin(shared, text_ends)]
        a_cut, b_cut = (np.concatenate([[0], np.searchsorted(e, cuts, "right")]) for e in (a_end, b_end))
        key = mix(span_hashes(a.view(np.uint8), 4 * a_cut[:-1], 4 * a_cut[1:])) + span_hashes(b.view(np.uint8), 4 * b_cut[:-1], 4 * b_cut[1:])
        _, at, of = np.unique(key, return_index=True, return_inverse=True)
        if any(not np.array_equal(gather(ids, cut, at[of])[0], ids) for ids, cut in ((a, a_cut), (b, b_cut))):
            at, of = self.distinct(a, a_cut, b, b_cut)
        held = self.remembered(self.keys(a, a_cut, b, b_cut, at))
        lengths = np.array([len(x[1]) // 8 for x in held], np.int64)
        codes, slots = np.unique(np.frombuffer(b"".join([x[1] for x in held]), np.int64), return_inverse=True)
        found = np.repeat(np.bincount(of, minlength=len(held)), lengths)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, slots, found)
        first = np.searchsorted(cuts, text_ends, "right")
        names, spots = [x[0] for x in held], of.tolist()
        groups = [b";".join([names[w] for w in spots[i:j]]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
        total = lambda ends: np.diff(np.searchsorted(ends, text_ends, "right"))
        return {
            "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": total(shared), "n_links": total(either), "groups": groups,
            "windows": [of[i:j].astype(np.uint32) for i, j in zip(first[:-1], first[1:])],
            "codes": codes, "counts": counts, "slots": slots.astype(np.uint32), "ends": np.cumsum(lengths).astype(np.uint32),
        }

    @staticmethod
    def keys(a, a_cut, b, b_cut, at) -> list[tuple[bytes, bytes]]:
        raw_a, raw_b = a.tobytes(), b.tobytes()
        return [(raw_a[4 * i : 4 * j], raw_b[4 * k : 4 * m]) for i, j, k, m in zip(a_cut[at].tolist(), a_cut[at + 1].tolist(), b_cut[at].tolist(), b_cut[at + 1].tolist())]

    def distinct(self, a, a_cut, b, b_cut) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence of each distinct window, and the distinct window of each, by the id tuples themselves: for batches in which two hashes met."""
        seen: dict[tuple[bytes, bytes], int] = {}
        at, of = [], []
        for i, k in enumerate(self.keys(a, a_cut, b, b_cut, np.arange(len(a_cut) - 1))):
            of.append(seen.setdefault(k, len(seen)))
            if len(at) < len(seen):
                at.append(i)
        return np.array(at, np.int64), np.array(of, np.int64)

    def remembered(self, keys: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        memo = self.memo
        fresh = [k for k in keys if k not in memo]
        if len(memo) + len(fresh) > MEMORY:
            memo = self.memo = {k: memo[k] for k in keys if k in memo}
        if fresh:
            memo.update(zip(fresh, self.windows(fresh)))
        return list(map(memo.__getitem__, keys))


def _marks(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends that both sides have, and ends of either."""
    at = np.zeros((2, 1 + int(max(a_end[-1:].sum(), b_end[-1:].sum()))), bool)
    at[0, a_end] = True
    at[1, b_end] = True
    return np.flatnonzero(at[0] & at[1]), np.flatnonzero(at[0] | at[1])


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stage table, written once: a row for each text with its windows, and one for each batch with its id pairs, their counts, and the pairs of each window."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, close, task = aligner(a_path, b_path), zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId()
        for number, b in enumerate(gathered(batches, BYTES)):
            x, n = of.align(b.column("text")), b.num_rows
            none = [None] * n
            yield pa.RecordBatch.from_arrays([
                pa.array([(task << 32) + number] * (n + 1), pa.int64()),
                pa.array([*b.column("doc_id").to_pylist(), None], pa.int64()),
                *(pa.array([*x[k].tolist(), None], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")),
                pa.array([*(hashlib.sha256(g).hexdigest() if g else "" for g in x["groups"]), None], pa.string()),
                pa.array([*(g.decode() for g in x["groups"]), None] if with_groups else [*none, None], pa.string()),
                pa.array([*(close(w.tobytes()) for w in x["windows"]), None], pa.binary()),
                *(pa.array([*none, x[k].tolist()], pa.list_(pa.int64())) for k in ("codes", "counts")),
                *(pa.array([*none, close(x[k].tobytes())], pa.binary()) for k in ("slots", "ends")),
            ], names=[c.split()[0] for c in STAGE.split(", ")])

    return cut_lineage(in_batches(rows, align, STAGE))


def pair_counts(stage: DataFrame) -> DataFrame:
    """code, a, b, n (links of the pair in all texts), best (n is the highest of its b)."""
    found = stage.where("codes is not null").select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    total = found.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("n"))
    split = total.select("code", F.expr(f"code div {SHIFT}").alias("a"), F.expr(f"code % {SHIFT}").alias("b"), "n")
    # At most one row for each id of the first tokenizer stands beside another of the same b.
    return split.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with `with_groups` the groups themselves.

    `a_path` is a byte-level tokenizers file, `b_path` a sentencepiece model. Texts that are null or empty, or that a
    tokenizer does not give back (as the second does with U+2581), have no tokens: zeros and an empty digest. Repeated
    rows count as often as they stand, tied counts are all the best, an empty table gives no rows; further columns,
    whatever their names, are left out. A text is aligned whole in one task, which holds its ids some ten times over,
    so a text of 100 MB needs about 3 GB there.
    """
    stage = aligned(docs, a_path, b_path, with_groups, id_col, text_col)
    pairs = stage.where("codes is not null").select(F.col("batch").alias("of"), F.posexplode("codes").alias("slot", "code"))
    values = pairs.join(pair_counts(stage).select("code", "n", "best"), "code").select("of", "slot", "n", "best")

    def add_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        rows = rows.to_pylist()
        own = next(r for r in rows if r["codes"] is not None)
        slots, ends = (np.frombuffer(open_(own[k]), np.uint32) for k in ("slots", "ends"))
        sums = {}
        for name in ("n", "best"):
            value = np.zeros(len(own["codes"]), np.int64)
            value[found.column("slot").to_numpy()] = found.column(name).cast(pa.int64()).to_numpy()
            sums[name] = np.diff(np.concatenate([[0], np.cumsum(value[slots])])[np.concatenate([[0], ends])])
        texts = [r for r in rows if r["codes"] is None]
        windows = [np.frombuffer(open_(r["windows"]), np.uint32) for r in texts]
        plain = {k: [r[k] for r in texts] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")}
        plain |= {"n_best": [int(sums["best"][w].sum()) for w in windows], "count_sum": [int(sums["n"][w].sum()) for w in windows]}
        kinds = {"groups_sha256": pa.string(), "groups": pa.string()}
        return pa.Table.from_batches([batch(**{k: pa.array(plain[k], kinds.get(k, pa.int64())) for k in (c.split()[0] for c in RESULT.split(", "))})])

    out = stage.groupBy("batch").cogroup(values.groupBy("of")).applyInArrow(add_up, RESULT)
    return out if with_groups else out.drop("groups")
