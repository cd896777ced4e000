"""Removal of repeated passages by suffix groups that share a prefix.

Of each window of `length` words the run of `prefix` words with the least hash is its anchor; equal windows have
equal anchors at the same place. 1. Anchors found once in the corpus are dropped with their windows, and the bytes of
the stretches of the others are summed. 2. The stretch of a document that holds the windows of one anchor goes to the
group of its prefix: the anchor, or all words of a window where the stretches of an anchor have too many bytes, so
that a group fits into memory at any size of the corpus. Stretches that are equal within a batch go there once. 3. A group orders its suffixes by prefix doubling; a class of equal
suffixes at depth `length` is an internal node of the suffix tree that deep. All of the node's leaves but the
first are repeats. 4. A document's repeats give the spans to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import NO_ID, batch, beside, in_batches, keyed, whole_groups
from strideframe.llm.text import SPACE, Words, inner, mix, pieces, runs, span_cover
from strideframe.session import cut_lineage

#: Bytes of stretches that a group may get. The prefix of a group that would get more is the whole window.
GROUP_BYTES = 32 << 20


def _anchors(w: Words, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of `prefix` words; the windows (by first word), and the anchor of each."""
    h = runs(w.hashes(), prefix)
    starts = np.flatnonzero(inner(w.first, length))
    if not len(starts):
        return h, starts, starts
    span = length - prefix + 1
    n = len(h) - span + 1
    part, done = h, 1
    while done < span:
        step = min(done, span - done)
        part = np.minimum(part[: len(part) - step], part[step:])
        done += step
    least = part[:n]
    at = np.zeros(n, np.int64)
    for k in range(span - 1, -1, -1):
        at[h[k : k + n] == least] = k
    return h, starts, (np.arange(n) + at)[starts]


def repeated_windows(words: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, place and class of each window of `length` words; equal classes: equal words. By prefix doubling."""
    ids: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in words], np.int64)
    rank = np.fromiter((ids.setdefault(x, len(ids)) for stretch in words for x in stretch), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(rank))  # words up to the stretch's end
    done, held, whole = 1, rank, None
    reach = 0
    while True:
        if length & done:
            if whole is None:
                whole, reach = held, done
            else:
                whole, reach = _paired(whole, held, reach), reach + done
        if done * 2 > length:
            break
        held, done = _paired(held, held, done), done * 2
    full = np.flatnonzero(left >= length)
    return of[full], (full - (np.cumsum(sizes) - sizes)[of[full]]), whole[full]


def _paired(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the pairs (a[i], b[i + step]); beyond the end nothing follows."""
    after = np.zeros(len(a), np.int64)
    after[: max(0, len(b) - step)] = b[step:] + 1
    return np.unique(a * (int(b.max(initial=0)) + 2) + after, return_inverse=True)[1].astype(np.int64)


def _marked(lists: pa.ListArray, w: Words) -> np.ndarray:
    """Words of a batch that the lists name by their place in the text."""
    out = np.zeros(len(w.start), bool)
    ends = lists.offsets.to_numpy().astype(np.int64)
    out[lists.values.to_numpy()[ends[0] : ends[-1]] + np.repeat(w.first[:-1], np.diff(ends))] = True
    return out


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def find_repeats(docs: DataFrame, length: int = 20, prefix: int = 10) -> DataFrame:
    """doc_id, h, repeats: the first words (packed int32) of all windows of a document that also start earlier.

    `docs` has the columns of `keyed`. Earlier is a smaller doc_id (null first), then a smaller h, then an earlier
    word. Equal rows are one document.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=4 << 20):
            w = Words(b.column("text"), SPACE)
            h, starts, at = _anchors(w, length, prefix)
            edge = np.flatnonzero(np.diff(at, prepend=-1) != 0)
            anchor, last = at[edge], np.append(edge, len(at))[1:] - 1
            key = h[anchor]
            size = w.end[starts[last] + length - 1] - w.start[starts[edge]]
            order = np.argsort(key, kind="stable")
            first = np.ones(len(key), bool)
            first[order[1:]] = key[order[1:]] != key[order[:-1]]
            many = np.zeros(len(key), bool)
            same = np.flatnonzero(~first[order])
            many[order[same]] = many[order[same - 1]] = True
            # The first find of a batch has the bytes of all stretches of its anchor, below 0 if there are others.
            _, back = np.unique(key, return_inverse=True)
            total = np.bincount(back, size, len(key))[back].astype(np.int64) if len(key) else size
            total = np.where(many & ~first, 0, np.where(many, -total, total))
            of = np.searchsorted(w.first, anchor, "right") - 1
            # Further finds of a batch are sure to repeat; they travel by place, so that none gathers them.
            sure = many & ~first
            by = pa.array(of)
            yield batch(to=np.where(sure, mix(anchor.astype(np.uint64)), key).view(np.int64), a=key.view(np.int64), size=pa.array(total, pa.int64()), doc_id=b.column("doc_id").take(by), h=b.column("h").take(by), place=pa.array((anchor - w.first[of]).astype(np.int32)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        a, size = t.column("a").to_numpy(), t.column("size").to_numpy()
        asked = np.flatnonzero(size)
        _, back, count = np.unique(a[asked], return_inverse=True, return_counts=True)
        n, total = np.zeros((2, len(a)), np.int64)
        n[asked] = count[back]
        total[asked] = np.bincount(back, np.abs(size[asked])).astype(np.int64)[back] if len(asked) else 0
        keep = np.flatnonzero((size <= 0) | (n > 1))
        t = t.take(pa.array(keep)).select(["doc_id", "h", "place", "a"]).append_column("crowded", pa.array(total[keep] > GROUP_BYTES))
        yield from t.combine_chunks().to_batches(max_chunksize=100_000)

    spread = in_batches(docs, ask, "to long, a long, size long, doc_id long, h long, place int").repartition("to")
    found = cut_lineage(in_batches(spread, answer, "doc_id long, h long, place int, a long, crowded boolean"))
    # All stretches of a crowded anchor are split, also those that needn't have asked.
    crowded = found.where("crowded").select("a", F.lit(True).alias("split")).distinct()
    by_doc = found.join(crowded, "a", "left").groupBy("doc_id", "h").agg(F.collect_list("place").alias("places"), F.collect_list(F.when(F.col("split"), F.col("place"))).alias("split"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=4 << 20):
            w = Words(b.column("text"), SPACE)
            h, starts, anchor = _anchors(w, length, prefix)
            wanted, split = _marked(b.column("places"), w), _marked(b.column("split"), w)
            own = wanted[anchor]
            starts, anchor = starts[own], anchor[own]
            edge = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
            of = np.searchsorted(w.first, starts, "right") - 1
            ids = [(NO_ID if i is None else i, x) for i, x in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist())]
            rows, at = {"to": [], "doc_id": [], "h": [], "place": [], "text": []}, {}
            marks: dict[tuple[int, int], list[int]] = {}
            whole = runs(w.hashes(), length) if split.any() else h

            def add(first: int, last: int, doc: int, to: int) -> None:
                """The windows first..last of a document; of equal stretches the earliest stays."""
                text, me = w.span(first, last + length), (*ids[doc], first - int(w.first[doc]))
                other = at.get(text)
                if other is None or me < other[0]:
                    at[text] = (me, to, last - first + 1)
                    me = other[0] if other else None
                if me is not None and me != at[text][0]:
                    marks.setdefault(me[:2], []).extend(range(me[2], me[2] + last - first + 1))

            for x, y in zip(edge.tolist(), np.append(edge[1:], len(starts)).tolist()):
                doc, first, last = int(of[x]), int(starts[x]), int(starts[y - 1])
                if split[anchor[x]]:
                    for k in range(first, last + 1):
                        add(k, k, doc, int(whole[k]))
                else:
                    add(first, last, doc, int(h[anchor[x]]))
            for text, (me, to, _) in at.items():
                for k, v in zip(rows, (to, *me, text)):
                    rows[k].append(v)
            for (i, x), places in marks.items():
                for k, v in zip(rows, (x, i, x, -1, _packed(np.array(places)))):
                    rows[k].append(v)
            yield batch(to=np.array([v & (1 << 64) - 1 for v in rows["to"]], np.uint64).view(np.int64), doc_id=pa.array(rows["doc_id"], pa.int64()), h=pa.array(rows["h"], pa.int64()), place=pa.array(rows["place"], pa.int32()), text=pa.array(rows["text"], pa.binary()))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "to"):
            place = t.column("place").to_numpy()
            ids, hs = t.column("doc_id").to_numpy(), t.column("h").to_numpy()
            texts = t.column("text").to_pylist()
            own = np.flatnonzero(place >= 0)
            of, at, cls = repeated_windows([texts[i].split() for i in own.tolist()], length)
            row = own[of]
            start = place[row] + at
            order = np.lexsort((start, hs[row], ids[row], cls))
            cls, row, start = cls[order], row[order], start[order]
            head = np.flatnonzero(np.diff(cls, prepend=-1) != 0)
            first = np.repeat(head, np.diff(np.append(head, len(cls))))
            later = (start != start[first]) | (hs[row] != hs[row[first]]) | (ids[row] != ids[row[first]])
            row, start = row[later], start[later]
            order = np.lexsort((hs[row], ids[row]))
            row, start = row[order], start[order]
            edge = np.flatnonzero((np.diff(ids[row], prepend=0) != 0) | (np.diff(hs[row], prepend=0) != 0) | (np.arange(len(row)) == 0))
            kept = np.flatnonzero(place < 0)
            who = np.concatenate([row[edge], kept])
            packed = [_packed(x) for x in np.split(start, edge[1:])][: len(edge)] + [texts[i] for i in kept.tolist()]
            yield batch(doc_id=ids[who], h=hs[who], repeats=pa.array(packed, pa.binary()))

    to_group = in_batches(beside(docs, by_doc, "inner"), stretches, "to long, doc_id long, h long, place int, text binary")
    marked = in_batches(to_group.repartition("to").sortWithinPartitions("to"), nodes, "doc_id long, h long, repeats binary")
    marked = marked.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    return marked.groupBy("doc_id", "h").agg(F.collect_list("repeats").alias("repeats"))


def remove_repeats(docs: DataFrame, length: int = 20, prefix: int = 10, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_words, n_removed, kept_sha256 (of the kept words joined by a blank) of every row; the kept text as well on demand.

    Words are runs of characters other than ASCII white space. Null and empty texts have no words. A word is removed
    if any window over it also starts earlier; windows are those of the input. Repeated rows are all returned.
    A text of any length is taken whole, in a batch of its own in one task; an empty table gives no rows; further columns, whatever their
    names, are left out.
    """
    rows = keyed(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, gone, digests, kept = [], [], [], []
            for text, lists in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("repeats").to_pylist()):
                words = text.split()
                n.append(len(words))
                if lists:
                    hit = span_cover(np.frombuffer(b"".join(lists), "<i4").astype(np.int64), length, len(words))
                    words = list(compress(words, (~hit).tolist()))
                gone.append(n[-1] - len(words))
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            out = {"doc_id": b.column("doc_id"), "h": b.column("h"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield batch(**out, **({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}))

    schema = "doc_id long, h long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return in_batches(beside(rows, find_repeats(rows, length, prefix)), cut, schema)
