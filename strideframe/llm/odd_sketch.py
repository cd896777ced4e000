"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

1. Texts with equal shingle sets form a class; its least document stands for it. 2. Classes that agree in a band of
MinHash samples share a bucket. An odd sketch (parity bitmap) folds the samples into SKETCH bits; the number of
differing bits of two sketches tells high similarities apart precisely, and buckets link what can be similar
enough. A bucket reports only a spanning forest of these links. 3. The components of the links are compared on
their full shingle sets, and again only a spanning forest is reported; its components are the groups.

Large buckets and components are dealt into blocks of at most BLOCK members, and each pair of blocks is one
task's work, so all pairs are looked at, none is written out, and memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.components import components
from strideframe.llm.frames import batch, beside, in_batches, keyed, packed, whole_groups
from strideframe.llm.text import SPACE, Words, mix, pieces, runs
from strideframe.session import cut_lineage

#: Samples, samples of a band (a pair at 0.8 misses all 32 bands with a chance of 5e-8), bits of a sketch.
SAMPLES, BAND, SKETCH = 128, 4, 1024
#: Differing bits up to which two classes may be similar: the mean at 0.8 is 49, its deviation under 10.
FAR = 110
BLOCK = 4096
_MULTIPLY = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of n lower-case words, ascending in each text, and offsets.

    A text of fewer words has its whole sequence as one shingle, one without words has none.
    """
    w = Words(column, SPACE, lower=True)
    h, of = w.hashes(), w.of()
    grams = runs(h, n)
    at = np.flatnonzero(of[: len(grams)] == of[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    values, of = [grams[at]], [of[at]]
    for size in range(1, n):
        short = np.flatnonzero(w.counts == size)
        if len(short):
            rows = h[w.first[short][:, None] + np.arange(size)]
            values.append(mix((rows * (np.arange(size, dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum(1, dtype=np.uint64) + np.uint64(size)))
            of.append(short)
    values, of = np.concatenate(values), np.concatenate(of)
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])])[: len(of)]
    return values[new], np.searchsorted(of[new], np.arange(len(column) + 1))


def samples(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples of each set that isn't empty."""
    start = offsets[:-1][np.diff(offsets) > 0]
    x = (mix(values) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), SAMPLES), np.uint32)
    for k in range(SAMPLES if len(start) else 0):
        out[:, k] = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], start)
    return out


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """SKETCH bits for each row: each sample turns over one bit, chosen by its number and value."""
    bit = (mix(sampled.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH)).astype(np.int64)
    turned = np.bincount((bit + np.arange(len(bit))[:, None] * SKETCH).ravel(), minlength=len(bit) * SKETCH) & 1
    return np.packbits(turned.astype(np.uint8).reshape(len(bit), SKETCH), axis=1)


def similarity(differing: np.ndarray | int) -> np.ndarray:
    """Estimated similarity of two sets whose sketches differ in so many bits."""
    return 1 + SKETCH / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / SKETCH, 1e-9))


def linked_by_sketch(sketches: np.ndarray, far: int) -> np.ndarray:
    """Least member of each one's component, where links are pairs that differ in at most `far` bits."""
    bits = np.ascontiguousarray(sketches).view(np.uint64)
    label, left = np.full(len(bits), -1, np.int64), np.arange(len(bits))
    for i in range(len(bits)):
        if label[i] >= 0:
            continue
        label[i] = i
        front, left = [i], left[left != i]
        while front and len(left):
            near = np.bitwise_count(bits[left] ^ bits[front.pop()]).sum(1) <= far
            front += left[near].tolist()
            label[left[near]] = i
            left = left[~near]
    return label


def linked_by_sets(values: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """Least member of each one's component, where links are pairs with 100 * intersection >= percent * union."""
    n, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    order = np.lexsort((of, values))
    term = np.cumsum(np.concatenate([[0], values[order][1:] != values[order][:-1]]))[: len(order)]
    owner, at = of[order], np.searchsorted(term, np.arange((term[-1] + 1 if len(term) else 0) + 1))
    by_set = np.empty(len(values), np.int64)
    by_set[order] = term
    label = np.full(n, -1, np.int64)
    left = n
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i], front, left = i, [i], left - 1
        while front and left:
            j = front.pop()
            own = by_set[offsets[j] : offsets[j + 1]]
            own = own[at[own + 1] - at[own] > 1]
            if not len(own):
                continue
            lengths = at[own + 1] - at[own]
            ends = np.cumsum(lengths)
            both = np.bincount(owner[np.repeat(at[own] - (ends - lengths), lengths) + np.arange(ends[-1])], minlength=n)
            hit = np.flatnonzero((100 * both >= percent * (size[j] + size - both)) & (label < 0) & (both > 0))
            label[hit] = i
            front += hit.tolist()
            left -= len(hit)
    return label


def _in_blocks(members: DataFrame, key: list[str]) -> DataFrame:
    """Members (with `node`) of keys that have two or more, each in all tasks (long `g`) where its block meets another."""
    sizes = members.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in key], F.expr(f"cast(ceil(_n / {BLOCK}) as int)").alias("_blocks"))
    joined = members.join(sizes, [F.col(k) == F.col(f"_{k}") for k in key]).drop(*[f"_{k}" for k in key])
    own = joined.withColumn("_b", F.expr("cast(pmod(xxhash64(node), _blocks) as int)"))
    met = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.withColumn("g", F.xxhash64(*key, F.least("_b", "_o"), F.greatest("_b", "_o"))).drop("_blocks", "_b", "_o")


def _edges(batches: Iterator[pa.RecordBatch], label) -> Iterator[pa.RecordBatch]:
    """Star edges of each group's components; `label` gives a table's least members. Nodes come as doc_id and h."""
    for t in whole_groups(batches, "g"):
        cut = np.flatnonzero(np.diff(t.column("g").to_numpy(), prepend=0) != 0)
        if not len(cut) or cut[0] != 0:
            cut = np.append([0], cut)
        ids, hs = t.column("doc_id").combine_chunks(), t.column("h").combine_chunks()
        a, b = [], []
        for s, e in zip(cut.tolist(), np.append(cut[1:], t.num_rows).tolist()):
            if e - s > 1:
                to = label(t.slice(s, e - s)) + s
                own = np.flatnonzero(to != np.arange(s, e)) + s
                a.append(to[own - s])
                b.append(own)
        a, b = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b))
        yield batch(u_id=ids.take(a), u_h=hs.take(a), v_id=ids.take(b), v_h=hs.take(b))


_EDGE = "u_id long, u_h long, v_id long, v_h long"


def _as_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.struct(F.col("u_id").alias("doc_id"), F.col("u_h").alias("h")).alias("u"), F.struct(F.col("v_id").alias("doc_id"), F.col("v_h").alias("h")).alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept (doc_id = component_id), component_h of every row.

    Documents are linked when 100 * intersection >= percent * union of their sets of `shingle` words; the band and
    sketch settings are those for 80 percent or more. component_id is the least id reachable, a missing id before all
    others; component_h is the h of its least document, so that the two name one document of the group. Null and empty
    texts have no set and are linked with nothing. Repeated rows share a result.
    A text of any length gives its whole set, in one task; an empty table gives no rows; further columns are left out.
    """
    if percent < 80:
        raise ValueError("bands and sketches are set for similarities of 80 percent or more")
    rows = keyed(docs, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            values, offsets = shingle_sets(b.column("text"), shingle)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            sampled = samples(values, offsets)
            whole = sampled.astype(np.uint64).reshape(len(full), -1, BAND)
            band = np.full(whole.shape[:2], 0, np.uint64) + np.arange(1, whole.shape[1] + 1, dtype=np.uint64)
            for k in range(BAND):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + whole[:, :, k])
            sums = [np.zeros(b.num_rows, np.uint64) for _ in range(2)]
            for k in range(2):
                sums[k][full] = np.add.reduceat(mix(values ^ np.uint64(k * 0x5851F42D4C957F2D)), offsets[:-1][full]) if len(full) else 0
            place = np.cumsum(n > 0) - 1
            pick = pa.array(np.where(n > 0, place, 0), mask=n == 0)
            per = whole.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * per), pa.array(band.ravel().view(np.int64)))
            bits = pa.array([x.tobytes() for x in odd_sketches(sampled)], pa.binary())
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), n=pa.array(n, pa.int64()), s1=sums[0].view(np.int64), s2=sums[1].view(np.int64), bands=lists.take(pick), sketch=bits.take(pick))

    signed = cut_lineage(in_batches(rows, sign, "doc_id long, h long, n long, s1 long, s2 long, bands array<long>, sketch binary"))
    classes = cut_lineage(
        signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "h", "bands", "sketch")).alias("r"))
        .select("n", "s1", "s2", F.struct("r.doc_id", "r.h").alias("node"), F.col("r.bands").alias("bands"), F.col("r.sketch").alias("sketch")))

    # 2. Coarse components: spanning forests of the buckets.
    buckets = _in_blocks(classes.select("node", F.explode("bands").alias("band")), ["band"]).select("g", F.col("node").alias("_node"))
    sketched = buckets.join(classes.select("node", "sketch"), F.col("node") == F.col("_node")).select("g", "node.doc_id", "node.h", "sketch")
    sketched = sketched.repartition("g").sortWithinPartitions("g", "doc_id", "h")

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _edges(batches, lambda t: linked_by_sketch(np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1), FAR))

    coarse = components(_as_nodes(in_batches(sketched, by_sketch, _EDGE)))

    # 3. Exact links within them.
    members = _in_blocks(coarse, ["component"]).select("node.doc_id", "node.h", "g").groupBy("doc_id", "h").agg(F.collect_list("g").alias("gs"))
    texts = beside(packed(rows), members.hint("shuffle_hash"), "inner").select("doc_id", "h", "zip", F.explode("gs").alias("g"))
    texts = texts.repartition("g").sortWithinPartitions("g", "doc_id", "h")

    def by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def label(t: pa.Table) -> np.ndarray:
            sets = [shingle_sets(b.column("text"), shingle) for b in pieces(t.to_batches())]
            return linked_by_sets(np.concatenate([v for v, _ in sets]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in sets]))]), percent)

        return _edges(batches, label)

    groups = components(_as_nodes(in_batches(texts, by_sets, _EDGE)))
    named = classes.select("n", "s1", "s2", F.col("node").alias("_node")).join(groups, F.col("_node") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "_node").alias("c"))
    joined = signed.select("doc_id", "h", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("c.doc_id"))
    return joined.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.when(F.col("c").isNull(), F.col("h")).otherwise(F.col("c.h")).alias("component_h"))
