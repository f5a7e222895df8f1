"""Jaccard join of word n-gram sets by T-occurrence search.

1. Each text becomes its set of distinct n-gram hashes. The hash space is cut into parts, as many as
   the largest difference a linked pair of this size may have, plus one and some to spare. A linked
   pair then has an equal part that is not empty in both, so one hash per part blocks the join
   without losing a link. N-grams known to be common are left
   out of the parts: that can only shrink differences, so the argument holds for any such list, and
   shared passages do not tie unrelated texts together. Texts with so many empty parts that it could
   fail also get parts under other hash functions, at last of all their n-grams; those that fail
   under all of them meet under one more key.
2. Texts that share a part, directly or over others, form a cell. Every cell is searched in one
   task, or, beyond ``CELL`` n-grams, block by block: inverted lists over the full sets, for each
   text the short lists are merged, the long ones are probed by binary search (or merged where that
   is cheaper), and pairs with enough common n-grams are links. The overlap is exact.
3. Links of a task are reduced to a spanning forest; components of all forests give the classes.

Equal sets count as one node until the end, so copies are never paired. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.components import components, local_roots, settle
from duskwatch.llm.rows import unit_hash
from duskwatch.llm.tokens import BYTE_CODE, U64, Words, distinct, list_column, mix, slices

CELL = 1_000_000
#: Bytes of text whose sets are built together; a longer text stands alone.
SLICE = 1 << 18
#: Signatures that one task looks through for keys that share one.
SIGS_PER_TASK = 1_000_000
#: Rows of (key, group) up to which the sets to search are picked by a broadcast join.
BROADCAST_ROWS = 1_000_000
#: Hash functions tried before texts meet under one key; the first leave common n-grams out.
LEVELS, RARE_LEVELS = 5, 3
#: Rows whose n-grams are counted to find common ones: this share, and at least this many if there are.
COMMON_SHARE, COMMON_ROWS = 0.05, 10_000
COMMON_GRAMS = 1_000_000


@lru_cache
def _classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest set size, largest difference, number of parts) of each size class."""
    upper = [1]
    while upper[-1] < 1 << 40:
        upper.append(max(upper[-1] + 1, upper[-1] * 100 // percent))
    size = np.array(upper, np.int64)
    apart = 2 * size * (100 - percent) // (100 + percent)
    return size, apart, apart + 2 + apart // 10


def _least(percent: int) -> int:
    """Smallest set that can link with a different one: those of the class below the first whose sets may differ have signatures too."""
    size, apart, _ = _classes(percent)
    if not apart.any():
        return int(size[-1]) + 1
    below = int(np.argmax(apart > 0)) - 2
    return int(size[below]) + 1 if below >= 0 else 1


def _parts(value: np.ndarray, offsets: np.ndarray, kind: np.ndarray, level: int, percent: int):
    """Per non-empty part: document and signature; per document: whether empty parts could hide a link. ``value`` is sorted by document."""
    _, apart, parts = _classes(percent)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    m = parts[kind]
    part = ((value >> U64(32)) * m[doc].astype(U64)) >> U64(32)
    new = np.ones(len(value), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return doc[:0], value[:0], np.ones(len(n), bool)
    inner = np.add.reduceat(mix(value * BYTE_CODE[3]), at)
    label = mix(part[at] * BYTE_CODE[5] + kind[doc[at]].astype(U64) * BYTE_CODE[6] + U64(level))
    filled = np.bincount(doc[at], minlength=len(n))
    return doc[at], mix(inner + label), m - filled >= m - apart[kind]


def _signatures(value: np.ndarray, offsets: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) rows for the size class of each set and the one above it. ``common``: sorted n-grams that the first levels leave out."""
    size, apart, _ = _classes(percent)
    n = np.diff(offsets)
    own = np.searchsorted(size, n)
    docs, out = [], []
    for up in (0, 1):
        left = np.flatnonzero((n > 0) & (apart[own + up] > 0))
        for level in range(LEVELS + 1):
            if not len(left):
                break
            kind = own[left] + up
            if level == LEVELS:
                docs.append(left)
                out.append(mix(kind.astype(U64) * BYTE_CODE[8] + BYTE_CODE[level]))
                break
            span = n[left]
            pick = np.repeat(offsets[left] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            v, o = value[pick], np.concatenate([[0], np.cumsum(span)])
            if level < RARE_LEVELS and common is not None and len(common):
                rare = common[np.minimum(np.searchsorted(common, v), len(common) - 1)] != v
                o = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(left)), span)[rare], minlength=len(left)))])
                v = v[rare]
            if level:
                v, o = distinct(np.repeat(np.arange(len(left)), np.diff(o)), mix(v + BYTE_CODE[level]), len(left))
            d, s, unsafe = _parts(v, o, kind, level, percent)
            docs.append(left[d])
            out.append(s)
            left = left[unsafe]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(docs), np.concatenate(out)


def _sets(column: pa.Array, size: int):
    w = Words(column)
    doc, _, h = w.windows(w.hashes(), size, whole_if_short=True)
    value, offsets = distinct(doc, h, w.rows)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value * BYTE_CODE[2]))])
    n = np.diff(offsets)
    return value, offsets, n, mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(U64) * BYTE_CODE[4]).view(np.int64)


def _sign(size: int, percent: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = common.value
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text, SLICE):
                value, offsets, n, key = _sets(text.slice(low, high - low), size)
                doc, sig = _signatures(value, offsets, percent, listed)
                order = np.argsort(doc, kind="stable")
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low), batch.column("text_hash").slice(low, high - low),
                        pa.array(n.astype(np.int64)), pa.array(key, mask=n == 0), list_column(sig[order], cut),
                    ],
                    ["doc_id", "text_hash", "n", "key", "sigs"],
                )

    return run


def _common_grams(text: DataFrame, size: int) -> np.ndarray:
    """N-grams that at least two different sets of a sample hold, the most frequent ``COMMON_GRAMS``.

    Which ones are found changes the work, never the result.
    """
    total = text.count()
    some = text.where(unit_hash("text_hash") < max(COMMON_SHARE, COMMON_ROWS / max(total, 1)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("")
            for low, high in slices(column, SLICE):
                value, _, n, key = _sets(column.slice(low, high - low), size)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.repeat(key, n))], ["gram", "key"])

    seen = some.select("text").mapInArrow(grams, "gram long, key long").groupBy("gram").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    often = settle(seen.where("a <> b").select("gram", "n"))
    floor, held = 1 << 62, 0
    for power, n in often.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*")).orderBy(F.desc("power")).collect():
        if held + n > COMMON_GRAMS:
            break
        floor, held = 1 << power, held + n
    return np.sort(often.where(F.col("n") >= floor).select("gram").toArrow().column("gram").to_numpy().view(U64))


def _full_sets(size: int, least: int):
    """(key, grams) once per task and distinct set of at least ``least`` n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text, SLICE):
                value, offsets, n, key = _sets(text.slice(low, high - low), size)
                rows = [i for i in np.flatnonzero(n >= least) if (k := int(key[i])) not in seen and not seen.add(k)]
                span = n[rows]
                pick = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum()) if rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rows]), list_column(value[pick], np.concatenate([[0], np.cumsum(span)]))], ["key", "grams"]
                )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (sig, key): a forest of the keys that share a signature, and the ends of each batch for the seams."""
    last = None
    lefts, rights, held = [], [], 0
    shape = ["kind", "a", "b"]

    def forest():
        if not lefts:
            return [], []
        node, root = local_roots(np.concatenate(lefts), np.concatenate(rights))
        own = node != root
        return [node[own]], [root[own]]

    for batch in batches:
        sig, key = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(sig):
            continue
        ends = np.array([(sig[0], key[0]), (sig[-1], key[-1])], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(2, np.int32)), pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], shape)
        if last is not None:
            sig, key = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], key])
        same = (sig[1:] == sig[:-1]) & (key[1:] != key[:-1])
        lefts.append(key[:-1][same])
        rights.append(key[1:][same])
        held += int(same.sum())
        last = (sig[-1], key[-1])
        if held > 4_000_000:
            lefts, rights = forest()
            held = sum(map(len, lefts)) // 2
    a, b = forest()
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a[0]), np.int32)), pa.array(a[0]), pa.array(b[0])], shape)


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def t_occurrence(gram: np.ndarray, offsets: np.ndarray, percent: int, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs whose sets reach ``percent`` Jaccard. With ``block``, only pairs of different blocks.

    DivideSkip: a partner must hold T of the n grams of the query. The n - T + 1 shortest lists are
    merged, every partner is in one of them; what they name is probed in the long lists by binary
    search, or, where the long lists are shorter than the probes, those are merged as well.
    """
    n = np.diff(offsets)
    rank = np.argsort(n, kind="stable")
    size = n[rank]
    flat = gram[_runs(offsets[:-1][rank], size)]
    _, token = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(rank)), size)
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    length = np.bincount(token)
    begin = np.cumsum(length) - length
    probe = token[order].astype(np.int64) * len(rank) + posting
    at = np.cumsum(size) - size
    shared = np.add.reduceat((length[token] > 1).astype(np.int64), at) if len(at) else at
    need = -(-2 * size * percent // (100 + percent))
    limit = np.searchsorted(size, size * 100 // percent, "right")
    side = block[rank] if block is not None else None
    left, right = [], []
    for q in np.flatnonzero((shared >= need) & (limit > np.arange(len(rank)) + 1)):
        mine = token[at[q] : at[q] + size[q]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        cut = size[q] - need[q] + 1
        short, long_ = mine[:cut], mine[cut:]
        found = posting[_runs(begin[short], length[short])]
        found = found[(found > q) & (found < limit[q])]
        if side is not None:
            found = found[side[found] != side[q]]
        if not len(found):
            continue
        partner, count = np.unique(found, return_counts=True)
        weight = int(length[long_].sum())
        if len(partner) * len(long_) * 4 < weight:
            want = (long_[:, None] * len(rank) + partner[None, :]).ravel()
            spot = np.minimum(np.searchsorted(probe, want), len(probe) - 1)
            count = count + (probe[spot] == want).reshape(len(long_), len(partner)).sum(0)
        elif len(long_):
            count = count + np.bincount(posting[_runs(begin[long_], length[long_])], minlength=len(rank))[partner]
        ok = 100 * count >= percent * (size[q] + size[partner] - count)
        left.append(np.full(int(ok.sum()), q))
        right.append(partner[ok])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return rank[np.concatenate(left)], rank[np.concatenate(right)]


def _search(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key = table.column("key").to_numpy()
        key, row = np.unique(key, return_index=True)
        table = table.take(pa.array(row))
        grams = table.column("grams").combine_chunks()
        offsets = grams.offsets.to_numpy().astype(np.int64)
        flat = grams.values.to_numpy()[offsets[0] : offsets[-1]]
        split = table.column("cross")[0].as_py()
        a, b = t_occurrence(flat, offsets - offsets[0], percent, table.column("block").to_numpy() if split else None)
        copies = table.column("copies").to_numpy().astype(np.float64)
        links = np.bincount(a, copies[b], len(key)) + np.bincount(b, copies[a], len(key))
        node, root = local_roots(a, b)
        return pa.table({"a": key[node], "b": key[root], "links": links[node].astype(np.int64)})

    return run


def ngram_jaccard_join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, n_links, keeper.

    Words are runs of other than white space, A-Z lower-cased; a text shorter than ``size`` words has
    its whole sequence as one n-gram; null and empty texts have none and link with nothing.
    ``n_links`` counts the rows linked with this one, copies included. ``component_id`` is the
    smallest doc_id of the class (a null id only if all are null); ``keeper`` marks the row with the
    smallest (doc_id, text hash); equal rows share the mark. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    common = spark.sparkContext.broadcast(_common_grams(text, size))
    signed = settle(
        text.mapInArrow(_sign(size, percent, common), "doc_id long, text_hash long, n long, key long, sigs array<long>")
    )
    rows = signed.select("doc_id", "text_hash", "n", "key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"))

    # keys that share many signatures meet in every task, so there are no more tasks than the signatures need
    tasks = max(1, (signed.agg(F.sum(F.size("sigs"))).first()[0] or 0) // SIGS_PER_TASK)
    met = settle(
        signed.select(F.explode("sigs").alias("sig"), "key").repartitionByRange("sig", "key").sortWithinPartitions("sig", "key")
        .coalesce(tasks).mapInArrow(_meet, "kind int, a long, b long")
    )
    common.destroy()
    ends = met.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("key")).distinct()
    seams = ends.join(ends.groupBy("sig").agg(F.min("key").alias("b")), "sig").where("key <> b").select(F.col("key").alias("a"), "b")
    cells = settle(components(met.where("kind = 0").select("a", "b").unionByName(seams)))

    placed = settle(_place(cells.join(classes.select("key", "n", "copies"), cells["node"] == classes["key"]).select("key", "component", "n", "copies")))
    full = text.select("text").mapInArrow(_full_sets(size, _least(percent)), "key long, grams array<long>")
    small = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    links = settle(
        full.join(F.broadcast(placed) if small else placed, "key").groupBy("grp")
        .applyInArrow(_search(percent), "a long, b long, links long")
    )
    linked = components(links.select("a", "b"))
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = linked.join(counted, "node", "left").join(classes, F.col("node") == classes["key"]).select("node", "component", "links", "first")
    known = settle(known)
    top = known.groupBy("component").agg(F.min("first").alias("top"))
    known = known.join(top, "component").select(F.col("node").alias("key"), "links", "top")
    full_class = classes.join(known, "key", "left").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "first").alias("top"))
    named = rows.where("key IS NOT NULL").join(full_class, "key").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("top.doc_id").alias("component_id"),
        (F.col("copies") - 1 + F.col("links")).alias("n_links"), (order == F.col("top")).alias("keeper"),
    )
    alone = rows.where("key IS NULL").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keeper"),
    )
    return named.unionByName(alone)


def _place(nodes: DataFrame) -> DataFrame:
    """(key, copies, grp, block, cross): small cells bundled up to ``CELL`` n-grams, large ones as pairs of blocks."""
    weight = nodes.groupBy("component").agg(F.sum("n").alias("w")).withColumn("blocks", F.ceil(F.col("w") / CELL))
    total = weight.where("blocks = 1").agg(F.sum("w")).first()[0] or 0
    bundles = int(2 * total // CELL) + 1
    both = nodes.join(weight, "component").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    one = both.where("blocks = 1").select("key", "copies", F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("grp"), "block", F.lit(False).alias("cross"))
    many = both.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    many = many.select("key", "copies", F.xxhash64("component", low, high).alias("grp"), "block", (low != high).alias("cross"))
    return one.unionByName(many)


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Rows of ``docs`` without those of a class but its keeper. Equal repeated rows count as one."""
    joined = settle(ngram_jaccard_join(docs, size, percent))
    repeated = joined.groupBy("doc_id", "text_hash").agg(F.count("*").alias("c"), F.bool_or("keeper").alias("keeper"))
    marks = repeated.where("NOT keeper OR c > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "keeper")
    marks = marks.withColumnRenamed("keeper", "_keeper")
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    hit = hashed.join(marks, hashed["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    single = hit.where("_hash IS NULL").select("_row.*")
    again = hit.where("_keeper").dropDuplicates(["_id", "_hash"]).select("_row.*")
    return single.unionByName(again)
