"""Source divergence audit by chunk factorization: which sources of a language use other terms than the rest of it, and which terms.

One pass over the texts counts, by white-space chunk and block of documents, which documents hold the chunk and how often: one row with a
packed list. Every globally distinct chunk is taken apart into terms once; the documents of a term's chunks, added up, are the most that can
hold it, so terms (and chunks) that cannot reach the least number leave here, most of a corpus' distinct chunks among them. The terms are
joined back to the lists, so that a frequent chunk is a row a block and not a row a document; the lists of a term's chunks are merged
block by block, where documents that hold it in several chunks count once. Chunks with more than one of HOT rows are few by counting; they
meet their terms by broadcast, not by a shuffle. What is left is told by a bit table of fixed size, which lets some others pass; the joins
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceatlas.llm.common import BROADCAST_ROWS, buckets_for, give_back, materialize, number_rows, small_batches

#: A term: letters A-Z and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task counts at once (one longer text: as many as it has).
BLOCK_BYTES = 32 << 20
#: A term's lists from two to the power of so many tasks are merged by one task.
BUCKET_BITS = 4
#: Bytes of lists that are merged at once (those of one term and block: as many as they have).
MERGE_BYTES = 4 << 20
#: Words of 64 bits in a row of the bit table, and its rows: 8 MB in all.
BIT_WORDS, BIT_ROWS = 64, 1 << 14
#: Chunks with at least one of so many rows of the documents' side are hot: never more than so many chunks.
HOT = 1000
#: Sources of a tile: two tiles and one term are compared at once.
TILE = 128
#: Terms that a task compares at once.
TERM_ROWS = 1024

def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """bit_row, words: a bit for the hash of each key; never more than BIT_ROWS rows of BIT_WORDS words, however many keys there are."""
    h = F.xxhash64(key)
    bits = keys.select(_bit_row(h).alias("bit_row"), _bit_word(h).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h)).alias("bit"))
    words = bits.groupBy("bit_row", "word").agg(F.bit_or("bit").alias("bits")).groupBy("bit_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BIT_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return materialize(words.select("bit_row", every.alias("words")), "bit-table")


def _bit_row(h: Column) -> Column:
    return (F.shiftrightunsigned(h, 12) % BIT_ROWS).cast("int")


def _bit_word(h: Column) -> Column:
    return (F.shiftrightunsigned(h, 6) % BIT_WORDS).cast("int")


def _bit(h: Column) -> Column:
    return (h.bitwiseAND(F.lit(63).cast("long"))).cast("int")


def may_hold(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows of df whose key may be in the bit table: all that are in it, and few others."""
    h = F.xxhash64(key)
    set_ = F.call_function("shiftrightunsigned", F.element_at("words", _bit_word(h) + 1), _bit(h)).bitwiseAND(F.lit(1).cast("long")) == 1
    return df.withColumn("bit_row", _bit_row(h)).join(F.broadcast(bits), "bit_row").where(set_).drop("bit_row", "words")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches in blocks of about so many bytes of text."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column("text").nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
            give_back()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    give_back()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _chunks(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks, number of a document and of a chunk for each place where one is)."""
    found = pc.ascii_split_whitespace(_one(texts.cast(pa.large_string())))
    coded = found.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    if len(code):
        filled = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))[code]
        doc, code = doc[filled], code[filled]
    return coded.dictionary, doc, code


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, seven bits each, the last of a value below 128; number of bytes of each value)."""
    width = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        width += values >> bits > 0
    ends = np.cumsum(width)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)
    more = at < np.repeat(width, width) - 1
    return (((np.repeat(values, width) >> (7 * at)) & 127) | (more << 7)).astype(np.uint8), width


def _values(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of _varints, place of the last byte of each)."""
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    at = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * at), starts) if len(ends) else np.zeros(0, np.int64), ends


def _within(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of the values that begin anew at each of the starts; no stretch is empty."""
    sums = np.cumsum(values)
    return sums - np.repeat(sums[starts] - values[starts], sizes)


_PACKED = "chunk string, block long, d long, held binary"


def _count_task(size: int):
    """(chunk, block, d, held): the documents of a block that hold the chunk, their number and a packed list of them with their occurrences.

    Documents are numbered in the block by group. An entry of the list is two numbers: steps from the last document's place, and steps from its
    group times 8 plus occurrences less one; more than eight occurrences are several entries of the same place.
    """
    schema = pa.schema([("chunk", pa.string()), ("block", pa.int64()), ("d", pa.int64()), ("held", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for t in _blocks(batches, size):
            words, doc, code = _chunks(t.column("text"))
            group = _one(t.column("g")).to_numpy()
            order = np.argsort(group, kind="stable")
            place = np.empty(len(group), np.int64)
            place[order] = np.arange(len(group))
            wide = max(1, len(group))
            pair, n = np.unique(code * wide + place[doc], return_counts=True)
            parts = (n + 7) // 8
            pair, last = np.repeat(pair, parts), np.cumsum(parts) - 1
            times = np.full(len(pair), 8)
            times[last] = n - 8 * (parts - 1)
            code, at = pair // wide, pair % wide
            g = group[order][at]
            fresh = np.append(True, code[1:] != code[:-1])[: len(code)]
            both = np.empty(2 * len(code), np.int64)
            both[0::2] = np.where(fresh, at, np.diff(at, prepend=0))
            both[1::2] = np.where(fresh, g, np.diff(g, prepend=0)) * 8 + times - 1
            raw, width = _varints(both)
            starts = np.flatnonzero(fresh)
            cuts = np.append(0, np.cumsum(width))[2 * np.append(starts, len(code))]
            d = np.add.reduceat(np.append(1, (np.diff(pair) > 0).astype(np.int64))[: len(pair)], starts) if len(starts) else starts
            held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
            columns = [words.take(pa.array(code[starts])).cast(pa.string()), pa.array(np.full(len(starts), block), pa.int64()), pa.array(d, pa.int64())]
            for z in range(0, len(starts), 16384):
                yield pa.RecordBatch.from_arrays([*(c.slice(z, 16384) for c in columns), held.slice(z, 16384).cast(pa.binary())], schema=schema)
            block += 1

    return run


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, g, n, d) from rows (term, times, block, held) sorted by term and block: a document counts once, whatever chunks of it hold the term.

    Sums of a term over several blocks may come in parts."""
    schema = pa.schema([("term", pa.string()), ("g", pa.int64()), ("n", pa.int64()), ("d", pa.int64())])

    def merged(t: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = _one(t.column("held").cast(pa.large_binary()))
        bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        values, ends = _values(np.frombuffer(held.buffers()[2], np.uint8)[bounds[0] : bounds[-1]])
        upto = np.searchsorted(ends, bounds - bounds[0], "left") // 2  # entries before each row
        starts, sizes = upto[:-1], np.diff(upto)
        row = np.repeat(np.arange(len(held)), sizes)
        place, g = _within(values[0::2], starts, sizes), _within(values[1::2] >> 3, starts, sizes)
        n = ((values[1::2] & 7) + 1) * t.column("times").to_numpy()[row]
        run_of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(held))))[row]
        block = t.column("block").to_numpy()[row]
        order = np.lexsort((place, block, g, run_of))
        run_of, g, block, place, n = run_of[order], g[order], block[order], place[order], n[order]
        other = (np.diff(run_of) != 0) | (np.diff(g) != 0)
        first = np.flatnonzero(np.append(True, other))
        d = np.append(True, other | (np.diff(block) != 0) | (np.diff(place) != 0)).astype(np.int64)
        terms = t.column("term").combine_chunks().take(pa.array(cut)).take(pa.array(run_of[first]))
        columns = [pa.array(g[first]), pa.array(np.add.reduceat(n, first)), pa.array(np.add.reduceat(d, first))]
        yield from pa.Table.from_arrays([terms, *columns], schema=schema).to_batches(65536)

    def whole(t: pa.Table) -> tuple[np.ndarray, int]:
        """(first row of each term, first row of the last term's last block)."""
        term, block = _one(t.column("term")), t.column("block").to_numpy()
        other = np.asarray(pc.not_equal(term[1:], term[:-1]))
        last = np.flatnonzero(np.append(True, other | (np.diff(block) != 0)))[-1]
        return np.append(0, 1 + np.flatnonzero(other)), int(last)

    waits, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        waits.append(b)
        size += b.nbytes
        if size < MERGE_BYTES:
            continue
        t = pa.Table.from_batches(waits)
        cut, last = whole(t)
        if last:  # the last block's lists may go on in the next batch
            yield from merged(t.slice(0, last).combine_chunks(), cut[cut < last])
            waits = t.slice(last).combine_chunks().to_batches()
            give_back()
        size = sum(w.nbytes for w in waits)
        if not last:
            size = 0  # one term and block: wait for as much again
    if waits:
        t = pa.Table.from_batches(waits).combine_chunks()
        yield from merged(t, whole(t)[0])
    give_back()


def grouped(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, text of docs; nulls are empty strings."""
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def term_counts(texts: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n: occurrences) and (lang, term, documents: rows that hold the term), of rows of grouped(); tables in the shared folder.

    Terms that fewer than least rows of any language hold may be absent."""
    pairs = texts.select("lang", "source").distinct().select(F.lit(0).alias("all"), "lang", "source", F.struct("lang", "source").alias("pair"))
    pairs = materialize(pairs, "groups")
    count = pairs.count()
    groups = materialize(number_rows(pairs, ["all"], "pair", buckets_for(count), "g").select("lang", "source", "g"), "group-numbers")
    near = F.broadcast(groups) if count <= BROADCAST_ROWS else groups
    numbered = small_batches(texts).join(near, ["lang", "source"]).select("g", "text")
    rows = materialize(numbered.mapInArrow(_count_task(BLOCK_BYTES), _PACKED), "chunk-documents")

    chunks = materialize(rows.groupBy("chunk").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("blocks")), "chunks")
    found = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    most = chunks.select("d", F.explode(F.array_distinct(found)).alias("term")).groupBy("term").agg(F.sum("d").alias("most"))
    able = materialize(most.where(F.col("most") >= least).select("term"), "able-terms")
    each = may_hold(chunks.select("chunk", "blocks", F.explode(found).alias("term")), "term", bit_table(able, "term"))
    each = each.groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("times"), F.first("blocks").alias("blocks"))
    terms = materialize(each.join(able, "term").select("chunk", "term", "times", "blocks"), "chunk-terms")

    left = may_hold(rows, "chunk", bit_table(terms, "chunk")).select("chunk", "block", "held")
    columns = ["term", "times", "block", "held"]
    hot = materialize(terms.where(F.col("blocks") * HOT > rows.count()).drop("blocks"), "hot-terms")  # of fewer than HOT chunks
    if hot.count() <= BROADCAST_ROWS:
        met = left.join(F.broadcast(hot), "chunk", "left")
        cold = met.where("term IS NULL").select("chunk", "block", "held").join(terms, "chunk").select(*columns)
        met = met.where("term IS NOT NULL").select(*columns).unionByName(cold)
    else:
        met = left.join(terms, "chunk").select(*columns)
    met = met.repartition("term", F.shiftright("block", 32 + BUCKET_BITS)).sortWithinPartitions("term", "block")
    merged = met.mapInArrow(_merge_task, "term string, g long, n long, d long").groupBy("g", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = materialize(merged.join(near, "g").select("lang", "source", "term", "n", "d"), "term-occurrences")
    documents = counts.groupBy("lang", "term").agg(F.sum("d").alias("documents"))
    return counts.select("lang", "source", "term", "n"), materialize(documents, "term-documents")


def _share(count: str, total: str, terms: str, prior: int, scale: int) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * terms)), exact; null where the language keeps no term."""
    whole = f"cast({scale} as decimal(12,0)) * cast({count} + {prior} as decimal(19,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({whole}) div ({total} + {prior} * {terms}) END")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _compare_task(tile: int, most: int):
    """Sums of gaps over the terms of a batch, for each two sources of two tiles; absent terms stand at the source's p of no occurrence."""
    names = ("lang", "no", "other", "gaps", "seen")

    def dense(base: np.ndarray, lists: pa.Array) -> np.ndarray:
        out = np.repeat(base[None, :], len(lists), 0)
        flat = pc.list_flatten(lists)
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        out[row, flat.field("at").to_numpy()] = flat.field("p").to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.StructArray.from_arrays([b.column(c) for c in ("lang", "a", "b")], ["lang", "a", "b"]).to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            out: list[list] = [[] for _ in names]
            for z, end in zip(cuts, cuts[1:], strict=False):
                if z == end:
                    continue
                x0, y0 = (np.array(b.column(c)[z].as_py(), np.int64) for c in ("x0", "y0"))
                sums = np.zeros((len(x0), len(y0)), np.int64)
                for at in range(z, end, most):
                    part = b.slice(at, min(most, end - at))
                    x, y = dense(x0, part.column("xs")), dense(y0, part.column("ys"))
                    for i in range(len(x0)):
                        d, s = x[:, i : i + 1] - y, x[:, i : i + 1] + y
                        sums[i] += (d * d // s).sum(0)
                i, j = (m.ravel() for m in np.indices(sums.shape))
                key = keys[z]
                for column, v in zip(out, ([key["lang"]] * len(i), i + key["a"] * tile, j + key["b"] * tile, sums.ravel(), np.full(len(i), end - z)), strict=True):
                    column.extend(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if n == "lang" else pa.int64()) for n, v in zip(names, out, strict=True)})

    return run


def source_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: summed gaps between each two sources of a language over all its kept terms.

    counts: lang, term, no, p of what occurs; groups: lang, source, no (from 0 in the language), terms, p0. Terms go in tiles of sources, so a
    row holds at most TILE of them; terms that neither tile holds are counted, not listed.
    """
    at = {"tile": F.floor(F.col("no") / TILE), "at": (F.col("no") % TILE).cast("int")}
    tiles = counts.withColumns(at).groupBy("lang", "term", "tile").agg(F.collect_list(F.struct("at", "p")).alias("xs"))
    bases = groups.where("p0 IS NOT NULL").withColumns(at).groupBy("lang", "tile").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "p0"))), lambda s: s.p0).alias("x0"))
    last = groups.groupBy("lang").agg(F.floor(F.max("no") / TILE).alias("last"))
    tiles = tiles.join(last, "lang")
    left = tiles.select("lang", "term", F.col("tile").alias("a"), F.explode(F.sequence("tile", "last")).alias("b"), "xs")
    right = tiles.select("lang", "term", F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("a"), F.col("tile").alias("b"), F.col("xs").alias("ys"))
    met = left.join(right, ["lang", "term", "a", "b"], "full").join(bases.withColumnRenamed("tile", "a"), ["lang", "a"])
    met = met.join(bases.select("lang", F.col("tile").alias("b"), F.col("x0").alias("y0")), ["lang", "b"])
    rows = met.select("lang", "a", "b", "xs", "ys", "x0", "y0").sortWithinPartitions("lang", "a", "b")
    parts = rows.mapInArrow(_compare_task(TILE, TERM_ROWS), "lang string, no long, other long, gaps long, seen long")
    sums = parts.groupBy("lang", "no", "other").agg(F.sum("gaps").alias("gaps"), F.sum("seen").alias("seen"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").where("no < other").join(sums, ["lang", "no", "other"], "left")
    unseen = (F.col("terms") - F.coalesce("seen", F.lit(0))) * _gap("p0", "q0")
    value = F.coalesce(F.coalesce("gaps", F.lit(0)) + unseen, F.lit(0)).cast("long")
    ways = F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return pairs.select("lang", value.alias("value"), F.explode(ways).alias("w")).select("lang", "w.source", "w.item", "value")


def divergence(docs: DataFrame, least_documents: int = 10, top: int = 10, prior: int = 2, scale: int = 1_000_000_000, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language; part `term`: the terms that the source has most above its language.

    A language keeps the terms that least_documents of its rows hold. With p = 1 + floor(scale * (count + prior) / (N + prior * V)), a gap is
    floor((p - q)^2 / (p + q)); all integers. Null text, lang and source are ''. Repeated rows are documents of their own. A source without
    text has its pairs; a language without kept terms has value 0 in all pairs and no terms; a single source has no pairs; an empty table no
    rows. Ties go by the item's UTF-8 bytes. Texts of any length are counted whole; other columns, whatever their names, are not read.
    """
    texts = grouped(docs, text_col, lang_col, source_col)
    occurrences, documents = term_counts(texts, least_documents)
    kept = documents.where(F.col("documents") >= least_documents).select("lang", "term")
    counts = materialize(occurrences.join(kept, ["lang", "term"]), "term-counts")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms"])
    no = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    whole = F.sum("total").over(Window.partitionBy("lang"))
    groups = materialize(every.select("lang", "source", "total", "terms", no.alias("no"), whole.alias("lang_total"), _share("0", "total", "terms", prior, scale).alias("p0")), "term-groups")

    lang_n = F.sum("n").over(Window.partitionBy("lang", "term"))
    rated = counts.withColumn("lang_n", lang_n).join(groups, ["lang", "source"])
    rated = rated.withColumns({"p": _share("n", "total", "terms", prior, scale), "q": _share("lang_n", "lang_total", "terms", prior, scale)})
    rated = materialize(rated.select("lang", "source", "term", "no", "p", "q"), "term-shares")
    by_term = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    by_pair = source_pairs(rated.select("lang", "term", "no", "p"), groups.select("lang", "source", "no", "terms", "p0")).withColumn("part", F.lit("pair"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")
    first = by_term.withColumn("rank", rank).where(F.col("rank") <= top)
    return by_pair.withColumn("rank", rank).select("lang", "source", "part", "item", "value", "rank").unionByName(first)
