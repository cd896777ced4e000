"""Byte-pair encoding with the ids of shared stretches reused, and decoding.

Texts are cut where a rolling hash of the last bytes says so, so equal stretches of different documents give equal
chunks. A chunk found more than once is encoded once, by the first document that has it, and its ids go to the
others; all else is encoded where it stands. Keys find chunks and a digest of the bytes confirms them. Only texts with
a shared chunk travel; a bitmap of bounded size, which may name some others as well, tells them at the scan. A chunk's first and last word may be cut, so only the ids between its
first and last white space are kept, and each join is encoded anew from the whole word before it to the whole
word after it: if these words' ids are not those that are held, the stretch grows, at last to the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, beside, in_batches, keyed
from strideframe.llm.text import _OF_BYTE, flat, pieces, runs, span_hashes
from strideframe.llm.tokens import codec, decimals
from strideframe.session import cut_lineage

#: Bytes that a cut depends on; a cut comes every 2 ** CUT_BITS bytes on average; chunks of fewer than LEAST bytes are not worth their row.
WINDOW, CUT_BITS, LEAST = 32, 8, 64
#: Bits of the bitmap of texts, kept in words of 64: 8 MB at most, whatever the table. When most are set, more texts travel.
BITS = 1 << 25
_GAPS = b" \t\n\r\x0b\x0c"
CHUNK = "start int, end int, key long"


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each chunk, and its text. Cuts stand between characters and depend on bytes of their text alone."""
    hit = np.flatnonzero((runs(_OF_BYTE[data], WINDOW) & np.uint64((1 << CUT_BITS) - 1)) == 0) + WINDOW
    of = np.searchsorted(offsets, hit - 1, "right") - 1
    hit, end = hit[hit - WINDOW >= offsets[of]], offsets[of + 1][hit - WINDOW >= offsets[of]]
    for _ in range(3):
        inside = hit < end
        hit, end = hit[inside], end[inside]
        hit = hit + ((data[hit] & 0xC0) == 0x80)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], hit[hit < end]]))
    return start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(offsets, start, "right") - 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        data, offsets = flat(b.column("text"))
        start, end, of = chunk_bounds(data, offsets)
        keep = np.flatnonzero(end - start >= LEAST)
        key, of, at = span_hashes(data, start, end)[keep].view(np.int64), of[keep], offsets[of[keep]]
        yield batch(doc_id=b.column("doc_id").take(pa.array(of)), h=b.column("h").take(pa.array(of)), start=pa.array((start[keep] - at).astype(np.int32)), end=pa.array((end[keep] - at).astype(np.int32)), key=key)


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _core(chunk: bytes) -> tuple[int, int]:
    """First gap, and the place after the last one; (-1, -1) without a gap."""
    gaps = [(chunk.find(g), chunk.rfind(g)) for g in (_GAPS[i : i + 1] for i in range(len(_GAPS)))]
    found = [(a, z) for a, z in gaps if a >= 0]
    return (min(a for a, _ in found), max(z for _, z in found) + 1) if found else (-1, -1)


def _words_before(raw: bytes, low: int, at: int, n: int) -> int:
    """Start of the n-th word before `at`, not before `low`."""
    got = raw[low:at].rsplit(None, n)
    return at if not got else low if len(got) <= n else low + raw[low:at].rfind(got[1], len(got[0]))


def _words_after(raw: bytes, at: int, high: int, n: int) -> int:
    got = raw[at:high].split(None, n)
    return at if not got else high if len(got) <= n else high - len(got[n])


def assemble(c, texts: list[bytes], held: list[dict[tuple[int, int], np.ndarray]]) -> list[np.ndarray]:
    """Ids of each text; `held`: the kept ids of some of its chunks by (start, end)."""
    def encode(parts: list[bytes]) -> list[np.ndarray]:
        ids, at = c.encode(pa.array([p.decode() for p in parts], pa.string()))
        return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]

    out: list[np.ndarray | None] = [None] * len(texts)
    todo = {i: 1 for i in range(len(texts))}  # text -> words taken in on each side of a join
    while todo:
        ask, plans = [], []
        for i, n in todo.items():
            raw, cores = texts[i], []
            for (s, e), ids in sorted(held[i].items()):
                a, z = _core(raw[s:e])
                if a >= 0 and len(ids):
                    cores.append((s + a, s + z, ids))
            if not cores or n > 64:
                plans.append((i, None))
                ask.append(raw)
                continue
            joins = []
            for k in range(len(cores) + 1):
                low, high = (cores[k - 1][1] if k else 0), (cores[k][0] if k < len(cores) else len(raw))
                a = _words_before(raw, cores[k - 1][0], low, n) if k else 0
                b = _words_after(raw, high, cores[k][1], n) if k < len(cores) else len(raw)
                joins.append((a, b))
                ask += [raw[a:b], raw[a:low], raw[high:b]]
            plans.append((i, [x[2] for x in cores]))
        got = iter(encode(ask))
        for i, cores in plans:
            if cores is None:
                out[i] = next(got)
                del todo[i]
                continue
            parts, agreed = [], True
            for k in range(len(cores) + 1):
                whole, left, right = next(got), next(got), next(got)
                agreed &= len(whole) >= len(left) + len(right) and np.array_equal(whole[: len(left)], left) and np.array_equal(whole[len(whole) - len(right) :], right)
                agreed &= not k or np.array_equal(cores[k - 1][len(cores[k - 1]) - len(left) :], left)
                agreed &= k == len(cores) or np.array_equal(cores[k][: len(right)], right)
                parts.append(whole[len(left) : len(whole) - len(right)])
                if k < len(cores):
                    parts.append(cores[k])
            if agreed:
                out[i] = np.concatenate(parts)
                del todo[i]
            else:
                todo[i] *= 2
    return out


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_tokens, ids (binary, little-endian integers of the codec's width) of every row; null texts are empty.

    An empty text has no ids. Equal rows are encoded from the same chunks and all returned. Files of a kind whose
    words don't stand for themselves, and texts with the string of an added token, are encoded as a whole. A text of any
    length is cut into chunks, but held whole by its task; an empty table gives no rows; further columns are left out.
    """
    rows = keyed(docs, id_col, text_col)
    found = cut_lineage(in_batches(rows, _chunks, f"doc_id long, h long, {CHUNK}"))
    place = F.struct("doc_id", "h", "start", "end")
    shared = cut_lineage(found.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("owner")).where("n > 1").drop("n"))
    spots = cut_lineage(found.join(shared.select("key"), "key"))
    own = shared.select("owner.*", "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end", "key")).alias("parts"))
    slot = F.pmod(F.xxhash64("doc_id", "h"), F.lit(BITS))
    words = spots.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    told = rows.withColumn("slot", slot).withColumn("word", F.expr("slot div 64")).join(F.broadcast(words), "word", "left")
    named = F.expr("coalesce(shiftright(bits, cast(slot % 64 as int)) & 1, 0) = 1")
    travel, stay = (told.where(c).select("doc_id", "h", "text") for c in (named, ~named))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, close = codec(tokenizer), zstandard.ZstdCompressor(level=3).compress
        for b in pieces(batches):
            keys, digests, cores = [], [], []
            for text, parts in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("parts").to_pylist()):
                for p in parts:
                    chunk = text[p["start"] : p["end"]]
                    a, z = _core(chunk)
                    keys.append(p["key"])
                    digests.append(_digest(chunk))
                    cores.append(chunk[a:z].decode() if a >= 0 else "")
            ids, at = c.encode(pa.array(cores, pa.string()))
            raw, at = ids.tobytes(), at * c.width.itemsize
            yield batch(key=pa.array(keys, pa.int64()), digest=pa.array(digests, pa.binary()), ids=pa.array([close(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()))

    cores = in_batches(beside(travel, own, "inner"), first, "key long, digest binary, ids binary").dropDuplicates(["key"])
    parts = spots.join(cores, "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end", "digest", "ids")).alias("parts"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, open_ = codec(tokenizer), zstandard.ZstdDecompressor().decompress
        size = c.width.itemsize
        for b in pieces(batches):
            parts = b.column("parts")
            alone = parts.is_null().to_numpy(zero_copy_only=False) | (c.kind != "words") | c._whole(b.column("text"))
            ids: list[bytes] = [b""] * len(alone)
            own = np.flatnonzero(alone)
            flat_ids, at = c.encode(b.column("text").take(pa.array(own)))
            raw = flat_ids.tobytes()
            for i, s, e in zip(own.tolist(), (at[:-1] * size).tolist(), (at[1:] * size).tolist()):
                ids[i] = raw[s:e]
            joined = np.flatnonzero(~alone)
            pick = pa.array(joined)
            texts, held = b.column("text").take(pick).cast(pa.binary()).to_pylist(), []
            for text, ps in zip(texts, parts.take(pick).to_pylist()):
                held.append({(p["start"], p["end"]): np.frombuffer(open_(p["ids"]), c.width) for p in ps if _digest(text[p["start"] : p["end"]]) == p["digest"]})
            for i, x in zip(joined.tolist(), assemble(c, texts, held)):
                ids[i] = x.tobytes()
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), n_tokens=pa.array([len(x) // size for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in pieces(batches):
            ids, at = c.encode(b.column("text"))
            raw, ends = ids.tobytes(), (at * c.width.itemsize).tolist()
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), n_tokens=pa.array(np.diff(at), pa.int64()), ids=pa.array([raw[i:j] for i, j in zip(ends, ends[1:])], pa.binary()))

    result = "doc_id long, h long, n_tokens long, ids binary"
    return in_batches(beside(travel, parts), rest, result).unionByName(in_batches(stay, alone, result))


def decode(encoded: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text; with `digests`, sha-256 of the decimal ids and of the decoded text instead of the text."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for big in batches:
            for at in range(0, big.num_rows, 200):
                b = big.slice(at, 200)
                raw = b.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(raw), c.width)
                offsets = np.concatenate([[0], np.cumsum([len(x) // c.width.itemsize for x in raw])])
                texts = c.decode(ids, offsets)
                if not digests:
                    yield batch(doc_id=b.column("doc_id"), n_tokens=b.column("n_tokens"), ids=b.column("ids"), text=pa.array(texts, pa.binary()).cast(pa.string()))
                    continue
                said = decimals(ids, offsets, 1 << 8 * c.width.itemsize if c.width.itemsize == 2 else c.library.get_vocab_size())
                yield batch(doc_id=b.column("doc_id"), n_tokens=b.column("n_tokens"), ids=b.column("ids"), ids_sha256=[hashlib.sha256(x).hexdigest() for x in said], decoded_sha256=[hashlib.sha256(x).hexdigest() for x in texts])

    return in_batches(encoded, read, "doc_id long, n_tokens long, ids binary, " + ("ids_sha256 string, decoded_sha256 string" if digests else "text string"))
