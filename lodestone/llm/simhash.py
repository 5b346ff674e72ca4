"""SimHash near-duplicates by a range join in a segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its 32 two-bit segments. The
Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints, so links at 3 or fewer bits lie within Manhattan distance 3,
and within 1 in at least one half of the vector. The grid has a cell for each
value of a half: a fingerprint is at home in two cells and also visits the
cells one step up, so each candidate pair meets in a cell. There the Manhattan
bound over the whole vector goes first and the exact Hamming test second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import lean, saved, small, tidy

MAX_BITS = 3
_EVEN = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)
#: Fingerprints at home in one cell that a task compares at once; fuller cells go in pairs of blocks.
CELL_MEMBERS = 4096
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text; 0 if it has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: -words])).tolist()
    hashes = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.array(hashes[at : at + _BLOCK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    return lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


@tidy
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes its fingerprint."""
    for batch in batches:
        bits = np.fromiter((fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def thermometer(fp: np.ndarray) -> np.ndarray:
    """The segment counts, two bits each: 0 as 00, 1 as 01, 2 as 11, so that Manhattan distance is popcount of xor."""
    low, high = fp & _EVEN, (fp >> _ONE) & _EVEN
    return (low | high) | ((low & high) << _ONE)


@tidy
def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Home cells and the cells one step up, for both halves."""
    names = ["cell", "visits", "fp"]
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        code = thermometer(fp)
        for half in (0, 1):
            own = (code >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            tag = np.uint64(half << 32)
            yield pa.RecordBatch.from_arrays([pa.array((own | tag).view(np.int64)), pa.array(np.zeros(len(fp), bool)), batch.column(0)], names)
            for segment in range(16):
                at = np.uint64(2 * segment)
                value = (own >> at) & np.uint64(3)
                can = value != 3
                up = own[can] | (np.where(value[can] == 0, np.uint64(1), np.uint64(2)) << at)
                yield pa.RecordBatch.from_arrays([pa.array((up | tag).view(np.int64)), pa.array(np.ones(len(up), bool)), pa.array(fp[can].view(np.int64))], names)


def spanning_links(home: np.ndarray, guests: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked among `home` and between `home` and `guests`: fewer than there are members."""
    every = np.concatenate((home, guests))
    code, label, out = thermometer(every), np.arange(len(every)), []
    for i in range(len(home)):
        near = np.bitwise_count(code[i + 1 :] ^ code[i]) <= MAX_BITS
        at = np.flatnonzero(near) + i + 1
        at = at[np.bitwise_count(every[at] ^ every[i]) <= MAX_BITS]
        at = at[label[at] != label[i]]
        if len(at):
            groups, first = np.unique(label[at], return_index=True)
            out += [(int(every[i].view(np.int64)), int(every[j].view(np.int64))) for j in at[first]]
            label[np.isin(label, groups)] = label[i]
    return out


@tidy
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and block pair, homes first: verified links of each. Holds one cell's (or pair's) fingerprints at a time."""
    held = None

    def flush(cell: np.ndarray, visits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(cell)]))
        use = (ends - starts > 1) & ~visits[starts]
        out: list[tuple[int, int]] = []
        for a, b in zip(starts[use].tolist(), ends[use].tolist(), strict=True):
            mid = a + int(np.searchsorted(visits[a:b], True))
            out += spanning_links(fp[a:mid], fp[mid:b])
        a, b = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        now = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "visits", "fp")]
        if len(now[0]):  # a block pair counts as a cell of its own
            pair = batch.column("x").to_numpy(zero_copy_only=False).astype(np.int64) << 20 | batch.column("y").to_numpy(zero_copy_only=False)
            now[0] = now[0] * 1_000_003 + pair * 0x9E3779B1
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(held[0]):
            continue
        last = int(np.flatnonzero(held[0] != held[0][-1]).max(initial=-1)) + 1
        if last:
            yield flush(held[0][:last], held[1][:last], held[2][:last].view(np.uint64))
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield flush(held[0], held[1], held[2].view(np.uint64))


def in_blocks(cells: DataFrame, crowded: DataFrame) -> DataFrame:
    """cells with x and y: the homes of a crowded cell (cell, blocks) go in pairs of blocks, its guests to each block."""
    split = cells.join(small(crowded), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    each = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low = F.when(F.col("visits"), F.col("other")).otherwise(F.least("own", "other"))
    high = F.when(F.col("visits"), F.col("other")).otherwise(F.greatest("own", "other"))
    return each.select("cell", low.alias("x"), high.alias("y"), "visits", "fp")


def classes(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """prints (saved: doc_id, fp and others) with component_id and root, the component itself.

    component_id is the smallest id of the component; null ids are passed over
    unless it has no other, so components may share one. `more` holds further
    links (a, b) between fingerprints.

    Equal fingerprints are collapsed before anything is compared, so groups of
    copies count once; a cell yields at most a spanning tree of its members,
    never all pairs, and components come from those trees. A crowded cell is
    dealt out in pairs of blocks, so that no task holds it whole.
    """
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = nodes.select("fp").repartition("fp").mapInArrow(_cells, "cell long, visits boolean, fp long")
    homes = cells.where("NOT visits").groupBy("cell").agg(F.ceil(F.count("*") / CELL_MEMBERS).cast("int").alias("blocks")).where("blocks > 1")
    dealt = in_blocks(cells, saved(homes, "crowded")).repartition(parts, "cell", "x", "y")
    links = dealt.sortWithinPartitions("cell", "x", "y", "visits", "fp").mapInArrow(_links, "a long, b long")
    links = links if more is None else links.unionByName(more)
    groups = saved(connected_components(links).withColumnsRenamed({"node": "fp", "component": "root"}), "groups")
    rooted = nodes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, prints: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), fingerprint (16 hex digits), component_id.

    Null, empty and wordless texts have fingerprint zero and are linked like
    any other. Repeated rows share their values. component_id is the smallest
    id reachable; null ids are passed over unless a component has no other.
    Empty tables give empty results; other columns are ignored.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words), "fingerprints") if prints is None else prints
    return classes(prints).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text_col: str) -> Column:
    """Tells texts apart; null is a text of its own."""
    return F.coalesce(F.unhex(F.sha2(F.col(text_col), 256)), F.lit(b""))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates. All columns stay.

    The row with the smallest id stays, null ids last; of several rows with
    that id the one whose text has the smallest SHA-256, and of rows that agree
    in both the first by its columns in JSON. Ids need not be unique: rows are
    told apart by id and text. Groups of null, empty and wordless texts keep one
    row too; an empty table stays empty.

    prints: doc_id, text_key and fp of each row, saved; more: as classes takes it.
    """
    if prints is None:
        named = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col))
        prints = saved(named.mapInArrow(_keyed, "doc_id long, text_key binary, fp long"), "fingerprints")
    found = saved(classes(prints, more).select("doc_id", "text_key", "root"), "classes")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    best = found.groupBy("root").agg(F.min(own).alias("best"))
    rows = found.groupBy("doc_id", "text_key", "root").agg(F.count("*").alias("times"))
    judged = saved(rows.join(best, "root").select("doc_id", "text_key", "times", own.eqNullSafe(F.col("best")).alias("stays")), "judged")
    mark = lambda df: df.select(F.col("doc_id").alias("__lodestone_id"), F.col("text_key").alias("__lodestone_text"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__lodestone_id")) & (text_key(text_col) == F.col("__lodestone_text"))
    kept = docs.join(small(mark(judged.where("NOT stays"))), same, "left_anti")
    twice = mark(judged.where("stays AND times > 1"))
    if twice.isEmpty():
        return kept
    twice = small(twice)
    row = F.struct(*docs.columns)
    again = docs.join(twice, same).groupBy("__lodestone_id", "__lodestone_text").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return kept.join(twice, same, "left_anti").unionByName(again)
