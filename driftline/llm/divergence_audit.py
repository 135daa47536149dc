"""Source divergence audit: how far the word counts of the sources of a language lie from each other, and the words that set one apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import bounded, durable, shared_folder
from .tokens import slices

#: Documents of its language that a term needs, and terms reported for each group.
MIN_DOCS, TOP_TERMS = 10, 10
#: Terms of a block of a matrix product on average, and sources of one at most on average.
TERM_BLOCK, SOURCE_BLOCK = 8192, 64
#: Indicator columns of a single product, at most (a term has no more columns than a cell has sources).
COLUMNS = 1024
#: Text that is worked on at once, in bytes.
TEXT_BYTES = 4 << 20
SHARE = 1_000_000_000

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()

_COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts behind one another, and the text of each; a null text has none. Terms are runs of letters A to Z, lower-cased, and of other than ASCII characters."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer((data[offsets[0] : offsets[-1]].to_pybytes() if data else b"").translate(_LETTERS), np.uint8)
    offsets -= offsets[0]
    letter = raw != 32
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] = letter[heads]  # no term reaches over the end of a text
    at = np.flatnonzero(first)
    starts = np.concatenate([np.cumsum(letter, dtype=np.int32)[at] - 1, [np.count_nonzero(letter)]]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(raw[letter])])
    return terms, np.searchsorted(offsets, at, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of some text at once; a row without a term stands for each group seen."""
    for batch in batches:
        for part in slices(batch, 2, TEXT_BYTES):
            langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            terms, text = terms_of(part.column(2))
            terms = terms.dictionary_encode()
            n = max(1, len(terms.dictionary))
            own, times = np.unique(text * n + terms.indices.to_numpy(), return_counts=True)
            keys, at = np.unique(group[own // n] * n + own % n, return_inverse=True)
            seen, docs = np.unique(group, return_counts=True)
            of = np.concatenate([keys // n, seen])
            names = [d.dictionary.take(pa.array(i)) for d, i in ((langs, of // len(sources.dictionary)), (sources, of % len(sources.dictionary)))]
            word = pa.array(np.concatenate([keys % n, np.zeros(len(seen), np.int64)]), mask=np.arange(len(of)) >= len(keys))
            total = np.concatenate([np.bincount(at, times, len(keys)).astype(np.int64), np.zeros(len(seen), np.int64)])
            yield pa.RecordBatch.from_arrays([*names, terms.dictionary.take(word), pa.array(total), pa.array(np.concatenate([np.bincount(at, minlength=len(keys)), docs]))], schema=_COUNTS_ARROW)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, c, head): occurrences in the group and in the language of every term that ``min_docs`` documents of the language hold.

    ``head`` marks one row of each term of a language. Each group has a row more, without a term. Documents are read
    once; tasks count them before anything is shuffled, so that a hot group comes as one row per term and task.
    """
    empty = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counts = docs.select(*empty).mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = counts.withColumns({"c": F.sum("n").over(term), "_docs": F.sum("docs").over(term), "head": F.col("source") == F.min("source").over(term)})
    return whole.where(F.col("term").isNull() | (F.col("_docs") >= min_docs)).drop("docs", "_docs")


def _share(count: str | Column, total: str, terms: str) -> Column:
    """1 + the floor of SHARE * (count + 2) / (total + 2 * terms), exact for any count."""
    count, wide = F.col(count) if isinstance(count, str) else count, "decimal(20,0)"
    return F.call_function("div", (count + 2).cast(wide) * F.lit(SHARE), F.greatest(F.col(total) + 2 * F.col(terms), F.lit(1)).cast(wide)) + 1


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_value(term: np.ndarray, group: np.ndarray, level: np.ndarray, p: np.ndarray, p0: np.ndarray, groups: int) -> np.ndarray:
    """What terms that two groups both have add to each pair of groups, over what a term that neither has adds.

    Arrays have one entry for each term and group with a count (``level``) over 0; ``p`` and ``p0`` are the group's prices of
    that level and of level 0. Each (group, level) is an indicator column over terms. The columns of some
    terms times their transpose count the terms with each level in one and each level in another group, which are
    then priced: J(a, b) * (f(a, b) - f(a, 0) - f(0, b) + f(0, 0)). Terms go from frequent to rare, as many at once as
    have ``COLUMNS`` columns, so that rare terms share theirs. Whole numbers throughout: counts stay under 2^24.
    """
    out = np.zeros((groups, groups), np.int64)
    if not len(term):
        return out
    total = np.bincount(term, level)
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    order = np.argsort(rank[term], kind="stable")
    row, group, level, p, p0 = rank[term][order], group[order].astype(np.int64), level[order], p[order], p0[order]
    key = group * (int(level.max()) + 1) + level
    todo = [(0, len(total))]
    while todo:
        low, high = todo.pop()
        own = slice(*np.searchsorted(row, [low, high]))
        columns, first, at = np.unique(key[own], return_index=True, return_inverse=True)
        if len(columns) > COLUMNS and high - low > 1:
            middle = (low + high) // 2
            todo += [(low, middle), (middle, high)]
            continue
        indicator = np.zeros((high - low, len(columns)), np.float32)
        indicator[row[own] - low, at] = 1
        joint = np.triu(indicator.T @ indicator, 1)  # a term has one level in a group: pairs within a group are 0
        a, b = np.nonzero(joint)
        g, q, q0 = (x[own][first] for x in (group, p, p0))
        value = _prices(q[a], q[b]) - _prices(q[a], q0[b]) - _prices(q0[a], q[b]) + _prices(q0[a], q0[b])
        np.add.at(out, (g[a], g[b]), joint[a, b].astype(np.int64) * value)
    return out


_CELL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _cell(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
    """The pairs of one block of terms and one or two blocks of sources."""
    first, second = (x.as_py() for x in key[2:])
    term, source = (pa.chunked_array(cell[c]).combine_chunks().dictionary_encode() for c in ("term", "source"))
    names = source.dictionary
    order = pc.sort_indices(names).to_numpy()
    code = np.empty(len(names), np.int64)
    code[order] = np.arange(len(names))
    group = code[source.indices.to_numpy()]
    value = joint_value(term.indices.to_numpy().astype(np.int64), group, *[cell[c].to_numpy() for c in ("n", "p", "p0")], len(names))
    block = np.zeros(len(names), np.int64)
    block[group] = cell["block"].to_numpy()
    g, h = np.nonzero(value)
    if first != second:
        across = block[g] != block[h]
        g, h = g[across], h[across]
    pick = lambda x: names.take(pa.array(order[x]))
    return pa.table([pa.repeat(key[0], len(g)), pick(g), pick(h), pa.array(value[g, h])], schema=_CELL)


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's divergence from the others of its language, and its ``top_terms`` most telling terms.

    Null texts, languages and sources are ''. Copies count as often as they come. A group without kept terms has value 0
    to others without; one source alone has no pair. An empty table gives no row; other columns are not read. Counts
    take at most 4.6e9 kept terms of a language, beyond which sums overflow with an error.

    A group's price of a term depends only on how often it has it. So pairs of groups need the number of terms with each
    two counts, not the terms: matrix products over blocks of terms and of sources give these for counts over 0;
    the number of terms of each count in one group gives the rest.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "audit")
    term_counts(docs, lang_col, source_col, text_col, min_docs).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = durable(rows.groupBy("lang", "source").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.count_if(F.col("term").isNotNull() & F.col("head")).alias("_heads")))
    langs = sums.groupBy("lang").agg(F.sum("_heads").alias("terms"), F.sum("total").alias("lang_total"), F.count("*").alias("_sources"))
    size = F.call_function("div", F.col("terms") + (TERM_BLOCK - 1), F.lit(TERM_BLOCK)), F.call_function("div", F.col("_sources") + (source_block - 1), F.lit(source_block))
    groups = sums.drop("_heads").join(langs, "lang").withColumns({"p0": _share(F.lit(0), "total", "terms"), "_blocks": size[0], "_parts": size[1]})
    groups = durable(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("_parts"))))
    priced = rows.where("term IS NOT NULL").join(bounded(groups), ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))

    telling = priced.withColumn("q", _share("c", "lang_total", "terms")).where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _price(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = telling.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("first"), F.greatest(j, F.col("block")).alias("second")))
    cells = priced.select("lang", "source", "term", "n", "p", "p0", "block", F.pmod(F.xxhash64("term"), F.col("_blocks")).alias("terms_block"), F.explode(pair).alias("_pair"))
    cells = cells.select("*", "_pair.*").drop("_pair")
    joint = cells.groupBy("lang", "terms_block", "first", "second").applyInArrow(_cell, "lang string, source string, item string, value long")

    other = bounded(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    ordered = ["lang", "source", "item", "value"]
    levels = priced.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")).join(other, "lang").where("source <> item")
    single = levels.select("lang", "source", "item", (F.col("m") * (_price(F.col("p"), F.col("q0")) - _price(F.col("p0"), F.col("q0")))).alias("value"))
    neither = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * _price(F.col("p0"), F.col("q0"))).alias("value"))
    once = joint.unionByName(single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value").select(*ordered)).unionByName(neither)
    value = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = value.withColumn("rank", F.row_number().over(best))
    return pairs.withColumn("part", F.lit("pair")).unionByName(top.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
