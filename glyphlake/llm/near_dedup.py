"""MinHash near-duplicates by SetSketch registers.

1. One pass over the texts gives each document's shingle set's size, digest and registers. Documents of equal sets form a
   class; from here on a class is one node with a number of its own, so copies never meet in pairs.
2. Bands of registers are hashed; nodes that share a band's hash meet in a bucket. Buckets of one are dropped before
   anything is gathered, with counts that are summed in each task first.
3. In a bucket, pairs are estimated from their registers by joint likelihood. First each node puts forward only its
   likeliest partners; these pairs are confirmed on full sets and give components. Then buckets that still hold several
   components are searched whole: nodes of different components that are likely pairs are dealt out again with their
   full sets, every such pair is confirmed where it is found, and only links that join components leave the task. So no
   link between components is lost, and no group, however large, gives out all its pairs.
4. Components of the links, and of the classes that share an id with texts of several; each document's least reachable id.

How many bands there are, of how many registers, and what counts as likely follow from the threshold (`setsketch.bands_for`).
Large buckets are dealt out as pairs of blocks of bounded size; the nodes of a bucket's largest component aren't paired
among themselves. Keys that many rows share (digests, buckets, ids, hubs) are joined by `common.split_join`."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import setsketch as sk
from glyphlake.llm.common import BROADCAST_BYTES, drop_saved, freeing, id_and_text, save, sliced, small, small_batches, split_join, unused
from glyphlake.llm.components import components

PERCENT = 75
#: The first round, which only has to join most of what belongs together, looks at this share of the bands, and partners.
FIRST, PARTNERS = 0.375, 2
#: Nodes, and bytes of their sets, of a block of a large bucket.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Blocks of a bucket's largest label are smaller by this factor: they go out once for each block of the other labels, mostly one.
MAIN = 4


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, registers) of every row; digest and registers are null for empty sets."""
    import xxhash  # noqa: F401  needed by the workers

    rows = id_and_text(docs, id_col, text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=SLICE_BYTES):
            sets = list(sk.shingle_sets([t.encode() for t in batch.column(1).to_pylist()]))
            registers = sk.sketches(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(registers, sets, strict=True)], pa.binary())], names=["id", "n", "digest", "registers"])

    return rows.mapInArrow(freeing(made), f"id {rows.schema[0].dataType.simpleString()}, n long, digest binary, registers binary")


#: Bytes of text whose shingles are worked out at once.
SLICE_BYTES = 1 << 18


def digest(shingles: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def bucket_members(nodes: DataFrame, bands: sk.Bands) -> tuple[DataFrame, DataFrame]:
    """(bucket, band, rep) for every bucket of at least two nodes, and (bucket, members), which is saved."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands.bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("registers", b * bands.rows + 1, F.lit(bands.rows))).alias("bucket"))))
    rows = nodes.select("rep", band.alias("x")).select("x.bucket", F.col("x.band").cast("short").alias("band"), "rep")
    shared = save(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "dup-shared")
    return split_join(rows, shared, "bucket", "members"), shared


def dealt(rows: DataFrame, nodes: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows (bucket, band, low, high, own, rep) with what nodes and more tables know of each rep, dealt out by block."""
    for table in (nodes, *more):
        rows = rows.join(table, "rep")
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "rep")


def first_blocks(members: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """Bucket members in blocks, dealt anew in every bucket, each block by itself."""
    sized = shared.select("bucket", F.col("members").alias("weight"), "members")
    rows = split_join(members, sized, "bucket", "weight")
    own = F.pmod(F.xxhash64("rep", "bucket"), F.ceil(F.col("members") / block)).cast("int")
    return rows.withColumn("own", own).select("bucket", "band", F.col("own").alias("low"), F.col("own").alias("high"), "own", "rep")


def cross_blocks(members: DataFrame, labelled: DataFrame, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that hold several labels, in all pairs of blocks but those inside a bucket's largest label; and
    the saved table of these buckets."""
    named = members.join(labelled.select("rep", "label", "n"), "rep")
    by_label = named.groupBy("bucket", "label").agg(F.count("*").alias("members"), F.sum(F.col("n") * 8).alias("bytes"))
    parts = lambda members, bytes_: F.ceil(F.greatest(members / block, bytes_ / block_bytes)).cast("int")
    total = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), F.max_by(F.struct("label", "members", "bytes"), "members").alias("most")).where("labels > 1")
    cut = parts(F.col("members") * MAIN, F.col("bytes")) > 1
    others = F.when(cut, parts(F.col("members") - F.col("most.members"), F.col("bytes") - F.col("most.bytes"))).otherwise(1)
    mains = F.when(cut, parts(F.col("most.members") * MAIN, F.col("most.bytes"))).otherwise(0)
    open_ = save(total.select("bucket", F.col("members").alias("weight"), F.col("most.label").alias("main"), others.alias("others"), mains.alias("mains")), "dup-open")
    rows = split_join(named, open_, "bucket", "weight")
    is_main = (F.col("label") == F.col("main")) & (F.col("mains") > 0)
    place = F.xxhash64("rep", F.lit(3))
    own = F.when(is_main, F.col("others") + F.pmod(place, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(place, F.greatest("others", F.lit(1)))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    return rows.select("bucket", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "label"), open_


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal (bucket, low, high), across batches."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            now = tuple(keys[a].tolist())
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def likely_pairs(registers: np.ndarray, n: np.ndarray, apart: np.ndarray, bands: sk.Bands, percent: int, chunk: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (i, j, estimate) with i < j, different values of `apart`, sizes that allow the similarity and a likely
    estimate."""
    banded = np.ascontiguousarray(registers[:, : bands.bands * bands.rows])
    least = bands.likely_bands * banded.shape[1]
    for start in range(0, len(registers), chunk):
        equal = np.stack([(banded[start:] == r).sum(1) for r in banded[start : start + chunk]])
        i, j = np.nonzero((equal >= least) & (apart[start : start + chunk, None] != apart[None, start:]))
        i, j = i[j > i] + start, j[j > i] + start
        fit = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        if len(i):
            estimate = sk.likeness(registers[i], registers[j], n[i], n[j])
            ok = estimate >= bands.likely
            yield i[ok], j[ok], estimate[ok]


def _registers(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def likeliest_pairs(rows: DataFrame, bands: sk.Bands, percent: int, partners: int) -> DataFrame:
    """(a, b) from dealt-out buckets: each node's likeliest partners."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _buckets(batches):
            rep = table.column("rep").to_numpy()
            if len(rep) < 2:
                continue
            found = list(likely_pairs(_registers(table), table.column("n").to_numpy(), rep, bands, percent))
            if not found:
                continue
            i, j, estimate = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(-estimate, kind="stable")
            i, j, taken, keep = i[order], j[order], np.zeros(len(rep), int), []
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                if taken[x] < partners or taken[y] < partners:
                    taken[x] += 1
                    taken[y] += 1
                    keep.append(k)
            a, b = rep[i[keep]], rep[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(freeing(made), "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    least, most = sorted((x, y), key=len)
    if not len(least) or 100 * len(least) < percent * len(most):
        return False
    common = int((most[np.minimum(most.searchsorted(least), len(most) - 1)] == least).sum())
    return 100 * common >= percent * (len(least) + len(most) - common)


def _cross_pairs(table: pa.Table, crosswise: bool, bands: sk.Bands, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (i, j, estimate): likely pairs of different labels, and, crosswise, of different blocks, that no earlier band
    brings together."""
    label, n, own, band = (table.column(c).to_numpy() for c in ("label", "n", "own", "band"))
    if len(label) < 2 or (label == label[0]).all():
        return
    registers, width = _registers(table), bands.bands * bands.rows
    for i, j, estimate in likely_pairs(registers, n, label, bands, percent):
        shared = (registers[i, :width] == registers[j, :width]).reshape(len(i), bands.bands, bands.rows).all(2)
        keep = shared.argmax(1) == band[i]
        if crosswise:
            keep &= own[i] != own[j]
        yield i[keep], j[keep], estimate[keep]


CROSS = "bucket long, band short, low int, high int, own int, rep long, label long"


def in_cross_pairs(rows: DataFrame, bands: sk.Bands, percent: int) -> DataFrame:
    """The rows, of those dealt out with their registers, that are in a likely pair of different labels: what has to be
    looked at with full sets. At most as many rows come out as go in, however many pairs there are."""
    names = [x.split()[0] for x in CROSS.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), table in _buckets(batches):
            taken = np.zeros(table.num_rows, bool)
            for i, j, _ in _cross_pairs(table, low != high, bands, percent):
                taken[i] = taken[j] = True
            if taken.any():
                yield from table.select(names).filter(pa.array(taken)).combine_chunks().to_batches()

    return rows.mapInArrow(freeing(made), CROSS)


def cross_links(rows: DataFrame, bands: sk.Bands, percent: int) -> DataFrame:
    """(a, b): of the links between nodes of different labels in dealt-out blocks those that join what is apart."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), table in _buckets(batches):
            rep, label, sets = table.column("rep").to_numpy(), table.column("label").to_numpy(), table.column("set")
            root = {x: x for x in label.tolist()}

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            joins = []
            for i, j, estimate in _cross_pairs(table, low != high, bands, percent):
                for k in np.argsort(-estimate, kind="stable").tolist():
                    x, y = find(int(label[i[k]])), find(int(label[j[k]]))
                    if x != y and linked(_set(sets, i[k]), _set(sets, j[k]), percent):
                        root[y] = x
                        joins.append(sorted((int(rep[i[k]]), int(rep[j[k]]))))
            if joins:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in joins], pa.int64()), pa.array([p[1] for p in joins], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(freeing(made), "a long, b long")


def _set(sets: pa.ChunkedArray, at) -> np.ndarray:
    return np.frombuffer(sets[int(at)].as_buffer(), np.uint64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [linked(_set(x, k), _set(y, k), percent) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    both = first.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(freeing(tested), "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rep, set) of the wanted (rep, id, digest): the sorted shingle hashes, worked out again from the texts of these ids;
    and the saved table of the ids."""
    key = unused("wanted", docs)
    ids = save(wanted.select(F.col("id").alias(key)).distinct(), "dup-ids")
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.join(small(ids, broadcast_bytes), rows[id_col] == F.col(key), "left_semi").select(text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, SLICE_BYTES):
            sets = [s for s in sk.shingle_sets([t.encode() for t in batch.column(0).to_pylist()]) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "set"])

    found = rows.mapInArrow(freeing(made), "digest binary, set binary").dropDuplicates(["digest"])
    return found.join(wanted.select("rep", "digest"), "digest").select("rep", "set"), ids


def same_ids(seen: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(a, b) for the nodes of ids that have several: each with the least of them. None if each id has one."""
    rows = seen.where("n > 0 and id is not null").select("id", "digest")
    several = save(rows.groupBy("id").agg(F.count("*").alias("weight"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id", "weight"), "dup-same")
    if several.isEmpty():
        drop_saved(several)
        return None
    of_id = split_join(rows, several, "id", "weight", "left_semi").distinct()
    of_id = split_join(of_id, nodes.select("rep", "digest", "rows"), "digest", "rows").select("id", "rep")
    least = of_id.groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("weight"))
    pairs = save(split_join(of_id, least, "id", "weight").where("a <> rep").select("a", F.col("rep").alias("b")), "dup-same-pairs")
    drop_saved(several)
    return pairs


def by_component(seen: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, n, component_id) of every row of `seen`, by the links `edges` (a, b) between classes and by ids that several
    classes share; and the saved tables it reads."""
    same = same_ids(seen, nodes)
    whole = components(edges if same is None else edges.union(same))
    reached = whole.select(F.col("id").alias("rep"), "component").union(whole.select(F.col("component").alias("rep"), "component").distinct())
    placed = save(reached.join(nodes.select("rep", "id", "digest", "rows"), "rep"), "dup-placed")
    least = save(placed.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("weight")), "dup-least")
    named = split_join(placed.select("component", "digest", "rows"), least, "component", "weight").select("digest", "rows", "component_id")
    alone = nodes.join(placed.select("rep"), "rep", "left_anti").select("digest", "rows", F.col("id").alias("component_id"))
    of_class = save(named.unionByName(alone), "dup-classes")
    out = split_join(seen.select("id", "n", "digest"), of_class, "digest", "rows", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "n", own.alias("component_id")), [whole, placed, least, of_class, *([] if same is None else [same])]


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows are linked if their shingle sets (five words, see `setsketch`) have a Jaccard similarity of at least percent %
    (1 to 100); component_id is the least id reachable over links, kept whether that is the row's own. Ids may be of any type
    that Spark can order. Null and empty texts have an empty set and are linked with nothing, as are rows whose id is null:
    their component is their own id. Very long texts are taken whole. Repeated rows keep their rows and are in one
    component, as are several texts under one id, each with all its links. Empty tables give an empty result; other
    columns are ignored."""
    small_batches(docs.sparkSession)
    bands = sk.bands_for(percent)
    seen = save(sketched(docs, id_col, text_col), "dup-sketches")
    classes = seen.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.count("*").alias("rows"))
    nodes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "dup-nodes")
    rows, shared = bucket_members(nodes, bands)
    members = save(rows, "dup-buckets")
    met = save(nodes.join(members.select("rep").distinct(), "rep", "left_semi"), "dup-met")
    rows, ids = full_sets(docs, met.select("rep", "id", "digest"), id_col, text_col, broadcast_bytes)
    sets = save(rows, "dup-sets")
    sketches = met.select("rep", "n", "registers")
    near = first_blocks(members.where(F.col("band") < math.ceil(FIRST * bands.bands)), shared, block)
    first = save(likeliest_pairs(dealt(near, sketches), bands, percent, PARTNERS).distinct(), "dup-pairs")
    links = save(confirmed(first, sets, percent), "dup-links")
    label = components(links)
    labelled = met.select("rep", "n").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("label"))
    rows, open_ = cross_blocks(members, labelled, block, block_bytes)
    crossing = save(in_cross_pairs(dealt(rows, sketches), bands, percent), "dup-crossing")
    more = save(cross_links(dealt(crossing, sketches, sets), bands, percent).distinct(), "dup-more")
    edges = label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)
    out, left = by_component(seen, nodes, edges)
    result = save(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept")), "dup-result")
    drop_saved(seen, nodes, shared, members, met, ids, sets, first, links, label, open_, crossing, more, *left)
    return result


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row of each component, all columns: of the rows under the component's id the one with the least text. Rows
    with an empty set or without an id are in no component and stay. Columns of `docs` may have any names, also one name twice."""
    key = unused("gone", docs, found)
    named = found.where(F.col(id_col).isNotNull())
    gone = named.where("not kept").select(F.col(id_col).alias(key)).distinct()
    out = docs.join(small(gone, broadcast_bytes), docs[id_col] == F.col(key), "left_anti")
    again = named.where("kept and n_shingles > 0").groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias("rows")).where("rows > 1").select(key)
    if again.isEmpty():
        return out
    again = small(again, broadcast_bytes)
    several = out.join(again, out[id_col] == F.col(key), "left_semi")
    placed = [f"c{i}" for i in range(len(docs.columns))]
    apart = several.select(F.col(id_col), F.col(text_col), "*").toDF("id", "text", *placed)
    least = apart.groupBy("id").agg(F.min_by(F.struct(*placed), F.struct("text")).alias("row")).select("row.*")
    return out.join(again, out[id_col] == F.col(key), "left_anti").union(least)
