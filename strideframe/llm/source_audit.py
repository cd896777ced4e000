"""How far the sources of a language diverge in their words, summed exactly over bitmaps of terms by count.

A bitmap has the terms that a group (a source of a language) holds exactly so many times, stored in words of 64 terms;
all zero words are left out. Two groups' joint cells follow from AND and popcount, a word at a time; terms that a
group lacks are the complement. A cell's count times its exact value is summed, so no pair of groups is ever joined
term by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches
from strideframe.llm.text import Words, gathered
from strideframe.session import cut_lineage

#: All ASCII but letters.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Shares are whole numbers of this unit. Documents that a kept term stands in, at least; ranks of part `term`.
UNIT, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
#: Bytes of text counted at a time. Words of 64 terms in the group of a task; cells of a task's matrix at a time.
BYTES, BLOCK, CELLS = 8 << 20, 64, 1 << 20
TERMS = "lang string, source string, term string, n long, docs long"
BITMAPS = "block long, lang string, word long, source string, n long, bits long"


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with it); a group without terms has one row with a null term."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, BYTES):
            lang, source = (b.column(k).cast(pa.string()).dictionary_encode() for k in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            w = Words(b.column("text"), NOT_LETTER, lower=True)
            _, first, term = np.unique(w.hashes(), return_index=True, return_inverse=True)
            # Occurrences by (group, term), then by text.
            of = w.of()
            key = group[of] * max(1, len(first)) + term
            order = np.argsort(key, kind="stable")
            key, of = key[order], of[order]
            new = np.diff(key, prepend=-1) != 0
            at = np.flatnonzero(new)
            texts = np.add.reduceat((new | (np.diff(of, prepend=-1) != 0)).astype(np.int64), at) if len(at) else at
            raw, seen = w.data.tobytes(), np.unique(group)
            names = pa.array([raw[i:j].decode() for i, j in zip(w.start[first].tolist(), w.end[first].tolist())], pa.string())
            of_group, of_term = np.divmod(key[at], max(1, len(first)))
            langs, sources = (pa.array(x) for x in np.divmod(np.concatenate([of_group, seen]), len(source.dictionary)))
            yield batch(
                lang=lang.dictionary.take(langs), source=source.dictionary.take(sources), term=pa.concat_arrays([names.take(pa.array(of_term)), pa.nulls(len(seen), pa.string())]),
                n=pa.array(np.concatenate([np.diff(at, append=len(key)), 0 * seen]), pa.int64()), docs=pa.array(np.concatenate([texts, 0 * seen]), pa.int64()),
            )

    return in_batches(rows, count, TERMS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """The exact share of a term: one and the whole part of UNIT * (n + 1) / (total + terms)."""
    return F.expr(f"1 + ({UNIT}BD * ({n} + 1)) div ({total} + {terms})").cast("long")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def bitmaps(kept: DataFrame) -> DataFrame:
    """block, lang, word, source, n, bits: the bitmaps of (lang, source, n) over the terms of `kept`, in words of 64 terms.

    Terms are ordered by their total within a partition, so words of rare terms have few counts. In a row with a null
    source, `bits` has all terms of the word.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, lang = TaskContext.get().partitionId(), -1, None
        rows: dict[tuple[str | None, int], int] = {}

        def word() -> pa.RecordBatch:
            number, keys = place // 64, list(rows)
            return batch(
                block=pa.array([(task << 40) + number // BLOCK] * len(rows), pa.int64()), lang=pa.array([lang] * len(rows), pa.string()), word=pa.array([number] * len(rows), pa.int64()),
                source=pa.array([k[0] for k in keys], pa.string()), n=pa.array([k[1] for k in keys], pa.int64()), bits=pa.array(np.array(list(rows.values()), np.uint64).view(np.int64), pa.int64()),
            )

        for b in batches:
            for now, per in zip(b.column("lang").to_pylist(), b.column("per").to_pylist()):
                if rows and (now != lang or place % 64 == 63):
                    yield word()
                    rows = {}
                if now != lang:  # a word, and a block, has terms of one language
                    place = (place // (64 * BLOCK) + 1) * 64 * BLOCK - 1
                lang, place = now, place + 1
                bit = 1 << (place % 64)
                for key in ((None, 0), *((x["source"], x["n"]) for x in per)):
                    rows[key] = rows.get(key, 0) | bit
        if rows:
            yield word()

    return in_batches(kept.select("lang", "total", "term", "per").sortWithinPartitions("lang", F.desc("total"), "term").select("lang", "per"), build, BITMAPS)


def _word_sums(bits: np.ndarray, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the pair values of one word: by group of rows (from `starts` on) and group of columns."""
    out, step = [], max(1, CELLS // len(bits))
    for i in range(0, len(bits), step):
        part = slice(i, i + step)
        cells = np.bitwise_count(bits[part, None] & bits[None, :]).astype(np.int64)
        gap = p[part, None] - p[None, :]
        cells *= gap * gap // p[None, :]
        out.append(np.add.reduceat(cells, starts, axis=1))
    return np.add.reduceat(np.concatenate(out), starts, axis=0)


def pair_values(levels: DataFrame) -> DataFrame:
    """lang, source, item, value of the ordered pairs of sources, summed by block.

    `levels` has block, lang, word, source, p, bits, with a row for the terms that a source lacks (its complement). A block has
    BLOCK words, so a task holds 64 * BLOCK rows for each source of the language at most.
    """
    def add_up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("word", "ascending"), ("source", "ascending")])
        names = rows.column("source").combine_chunks().dictionary_encode()
        names, source = names.dictionary, names.indices.to_numpy()
        word, p, bits = (rows.column(k).to_numpy() for k in ("word", "p", "bits"))
        bits, sums = bits.view(np.uint64), np.zeros((len(names), len(names)), np.int64)
        cuts = np.append(np.flatnonzero(np.diff(word, prepend=word[0] - 1)), len(word)).tolist()
        for i, j in zip(cuts, cuts[1:]):
            starts = np.flatnonzero(np.diff(source[i:j], prepend=-1))
            own = source[i:j][starts]
            sums[np.ix_(own, own)] += _word_sums(bits[i:j], p[i:j], starts)
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        lang = pa.array([rows.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.Table.from_batches([batch(lang=lang, source=names.take(pa.array(a)), item=names.take(pa.array(b)), value=pa.array(sums[a, b], pa.int64()))])

    sums = levels.groupBy("lang", "block").applyInArrow(add_up, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank for every group (lang, source) of the rows.

    Part `pair` has each other source of the language with the divergence of the group from it, summed over all kept terms;
    part `term` the kept terms that the group has oftener than its language, to `ranks` ranks. A term is kept in a language
    where at least `least_docs` of its rows have it. Ranks order by value, highest first, ties by the item's bytes.
    Null texts, languages and sources are read as empty; repeated rows count as often as they stand; a group without terms
    has pairs; a language of one source has none; an empty table gives no rows. Texts of any length are read in one pass,
    a batch at a time, and further columns, whatever their names, are left out. Values are exact: a sum of squares of
    shares is below 2^63 up to some hundred million kept terms of a language.
    """
    counts = cut_lineage(term_counts(docs, lang_col, source_col, text_col))
    grouped = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("per"))
    # A term's list has one entry for each source that has it.
    kept = cut_lineage(grouped.where(F.col("docs") >= least_docs).drop("docs"))
    by_source = kept.select("lang", "term", "total", F.explode("per").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    own = by_source.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("terms"))
    # A row for each group: small, but joined by key all the same.
    groups = cut_lineage(
        counts.where("term is null").select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
        .na.fill(0, ["group_total", "lang_total", "terms"])
    )

    maps = cut_lineage(bitmaps(kept))
    held = maps.where("source is not null")
    words = maps.where("source is null").select("block", "lang", "word", F.col("bits").alias("every")).join(groups.select("lang", "source"), "lang")
    lacking = words.join(
        held.groupBy("block", "lang", "word", "source").agg(F.bit_or("bits").alias("any")), ["block", "lang", "word", "source"], "left"
    ).select("block", "lang", "word", "source", F.lit(0).cast("long").alias("n"), F.expr("every & ~coalesce(any, 0)").alias("bits")).where("bits <> 0")
    levels = held.unionByName(lacking).join(groups, ["lang", "source"]).select("block", "lang", "word", "source", share("n", "group_total", "terms").alias("p"), "bits")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(pair_values(levels), ["lang", "source", "item"], "left")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(best))

    shares = by_source.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "group_total", "terms").alias("p"), share("total", "lang_total", "terms").alias("q"))
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", divergence("p", "q").alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)
    return pair.unionByName(term)
