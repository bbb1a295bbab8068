"""Jaccard join of documents on word shingles, by PartEnum signatures (see `partenum`).

1. Documents of equal sets form a class, one node from here on. A node has a parity bitmap: bit i says whether the set has an odd
   number of features that hash to i. Two bitmaps differ in at most as many bits as the sets in features, so what
   they rule out is no link.
2. Signatures travel packed, some megabytes a row, to the task of their range of values, and only those that several nodes
   share come back as rows. A task hands on one node for a signature that many of its own nodes have; the others
   are known to share it already. So no task gathers more of a signature than one node from each batch of texts.
3. Signatures that at most SMALL nodes share give pairs, each once however many signatures it shares, which bitmaps thin and
   full sets confirm. Those that more nodes share are buckets: in some of them each node puts forward the node whose bitmap is
   nearest, and these pairs are confirmed as well. The links give components.
4. Buckets that still hold several components are searched whole: up to CROWD nodes by their pairs of different
   components that short bitmaps allow, each once however many buckets it is in; larger ones in pairs of blocks of bounded size. Of the pairs that bitmaps allow
   there, those of a block with few are confirmed as pairs; of a block with many the nodes go out with their full sets, and
   only links that join components leave the task. So no link between components is lost, and no group gives out all its
   pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import partenum
from glyphlake.llm import setsketch as sk
from glyphlake.llm.common import BROADCAST_BYTES, drop_saved, freeing, id_and_text, save, sliced, split_join
from glyphlake.llm.components import components
from glyphlake.llm.near_dedup import BLOCK_BYTES, SLICE_BYTES, _buckets, _set, by_component, cross_blocks, dealt, digest, first_blocks, full_sets, linked

PERCENT = 80
#: Bits of a bitmap, at least and at most; between them two to four a feature.
FEWEST_BITS, MOST_BITS = 256, 1 << 16
#: Signatures that a task packs at once; bits of a signature beside those that say where it goes.
BATCH, SHORT = 1 << 21, 32
#: Nodes that may share a signature so that it gives pairs, at most (SMALL - 1) / 2 for each node.
SMALL = 8
#: Nodes of a bucket that is searched by its pairs, at most; pairs that a task holds to tell which it has put out already.
CROWD, HELD = 64, 1 << 20
#: The first look at buckets takes one of so many.
FIRST = 8
#: Pairs that a block may put forward for each of its nodes.
PAIRS = 2
#: Nodes of a block of a large bucket: bitmaps are light, and large blocks send each node out less often.
BLOCK = 4096
#: Bytes of bitmaps compared at once.
COMPARED = 16 << 20


def bitmap(features: np.ndarray) -> bytes:
    bits = min(max(FEWEST_BITS, 1 << (2 * len(features) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((features & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shortened(bits: bytes) -> bytes:
    """A bitmap folded to FEWEST_BITS bits, which rule out only what the whole bitmap does."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, FEWEST_BITS // 8), axis=0).tobytes()


def folded(bitmaps: Sequence[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all as short as the shortest: halves of a longer one are laid over each other."""
    width = min(map(len, bitmaps), default=0)
    out = np.empty((len(bitmaps), width), np.uint8)
    for i, b in enumerate(bitmaps):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def may_link(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with so many features together that differ in at least `apart` can be similar enough."""
    return apart * (100 + percent) <= sizes * (100 - percent)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, key, bits, short) of every row; what follows n is null for empty sets. key is the digest's first half,
    short the shortened bitmap."""
    import xxhash  # noqa: F401  needed by the workers

    rows = id_and_text(docs, id_col, text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=SLICE_BYTES):
            sets = list(sk.shingle_sets([t.encode() for t in batch.column(1).to_pylist()]))
            digests, bitmaps = [digest(s) for s in sets], [bitmap(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([key_of(d) for d in digests], pa.int64()), pa.array(bitmaps, pa.binary()), pa.array([b and shortened(b) for b in bitmaps], pa.binary())],
                names=["id", "n", "digest", "key", "bits", "short"],
            )

    return rows.mapInArrow(freeing(made), f"id {rows.schema[0].dataType.simpleString()}, n long, digest binary, key long, bits binary, short binary")


def key_of(found: bytes | None) -> int | None:
    return None if found is None else int.from_bytes(found[:8], "little", signed=True)


PACKED = "place long, whole boolean, signatures binary, nodes binary, counts binary, several binary"


def _short(signatures: np.ndarray) -> np.ndarray:
    """The last SHORT bits, in as few bytes as they take."""
    return np.ascontiguousarray(signatures.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SHORT // 8])


def _packed(found: list[tuple[int, np.ndarray]], places: int) -> Iterator[tuple]:
    """Rows of PACKED for the signatures of some nodes, whose keys differ."""
    keys = np.array([k for k, _ in found], np.int64)
    owner = np.repeat(np.arange(len(found)), [len(s) for _, s in found])
    signatures = np.concatenate([s for _, s in found]) >> np.uint64(64 - places - SHORT)
    order = np.argsort(signatures, kind="stable")
    ranked = signatures[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    group = np.cumsum(new) - 1
    several = np.bincount(group) > 1
    kept = np.zeros(len(order), bool)
    kept[order[new]] = True
    is_several = np.zeros(len(order), bool)
    is_several[order] = several[group]
    rest = order[~new]  # known to share theirs: these go out as they are
    if len(rest):
        yield int(signatures[rest[0]] >> np.uint64(SHORT)), True, signatures[rest].tobytes(), keys[owner[rest]].tobytes(), b"", b""
    at = (signatures[kept] >> np.uint64(SHORT)).astype(np.int64)
    by_place = np.argsort(at, kind="stable")
    at, own, short, flags = at[by_place], owner[kept][by_place], _short(signatures[kept])[by_place], is_several[kept][by_place]
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
        first = np.flatnonzero(np.append(True, own[a + 1 : b] != own[a : b - 1]))
        counts = np.diff(np.append(first, b - a)).astype(np.uint32)
        yield int(at[a]), False, short[a:b].tobytes(), keys[own[a:b][first]].tobytes(), counts.tobytes(), np.packbits(flags[a:b]).tobytes()


def packed_signatures(docs: DataFrame, id_col: str, text_col: str, percent: int, places: int) -> DataFrame:
    """Signatures of all texts, packed by their first `places` bits."""
    import xxhash  # noqa: F401  needed by the workers

    rows = id_and_text(docs, id_col, text_col).where(F.col(id_col).isNotNull()).select(text_col)
    names = [c.split()[0] for c in PACKED.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, found, size = partenum.Bands(percent), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for row in _packed(list(found.items()), places):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        for batch in sliced(batches, 0, SLICE_BYTES):
            for s in sk.shingle_sets([t.encode() for t in batch.column(0).to_pylist()]):
                if len(s) and (key := key_of(digest(s))) not in found:
                    found[key] = partenum.signatures(s, bands)
                    size += len(found[key])
            if size >= BATCH:
                yield from out()
                found, size = {}, 0
        if size:
            yield from out()

    return rows.mapInArrow(freeing(made), PACKED)


def _shared(low: np.ndarray, key: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, keys) of those that many nodes share, and (keys, keys) of pairs for the others."""
    order = np.lexsort((key, low))
    low, key, several = low[order], key[order], several[order]
    starts = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (key[1:] != key[:-1])))
    several = np.logical_or.reduceat(several, starts)
    low, key = low[starts], key[starts]
    first = np.append(True, low[1:] != low[:-1])
    group = np.cumsum(first) - 1
    members = np.bincount(group)
    crowd = (members > SMALL) | (np.bincount(group, weights=several) > 0)
    in_crowd = crowd[group]
    low, crowded, key, group = low[in_crowd], key[in_crowd], key[~in_crowd], group[~in_crowd]
    pairs = [np.flatnonzero(group[d:] == group[:-d]) for d in range(1, min(SMALL, len(group)))]
    one, other = (np.concatenate([key[p + k * d] for d, p in enumerate(pairs, 1)]) if pairs else key[:0] for k in (0, 1))
    return low, crowded, one, other


def meetings(packed: DataFrame) -> DataFrame:
    """(bucket, key, other): the nodes of every signature that many share; and, without a bucket, pairs of nodes that share a
    signature with few others, once for each."""
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(*columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        n = next(len(x) for x in columns if x is not None)
        for a in range(0, n, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.nulls(min(n - a, 1 << 16), pa.int64()) if x is None else pa.array(x[a : a + (1 << 16)].astype(np.int64)) for x in columns], names=["bucket", "key", "other"])

    def merged(place: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        low, key, one, other = _shared(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield from rows((np.uint64(place) << np.uint64(SHORT)) | low, key, None)
        yield from rows(None, one, other)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                place, whole, signatures, nodes, counts, several = (batch.column(k)[i] for k in range(6))
                signatures, nodes, counts = (memoryview(x.as_buffer()) for x in (signatures, nodes, counts))
                nodes = np.frombuffer(nodes, np.int64)
                if whole.as_py():
                    yield from rows(np.frombuffer(signatures, np.uint64), nodes, None)
                    continue
                if held and place.as_py() != at:
                    yield from merged(at, held)
                    held = []
                at = place.as_py()
                short = np.frombuffer(signatures, np.uint8).reshape(-1, SHORT // 8)
                low = np.zeros((len(short), 8), np.uint8)
                low[:, : SHORT // 8] = short
                flags = np.unpackbits(np.frombuffer(several.as_buffer(), np.uint8), count=len(short)).astype(bool)
                held.append((low.view(np.uint64).ravel(), np.repeat(nodes, np.frombuffer(counts, np.uint32)), flags))
        if held:
            yield from merged(at, held)

    return packed.repartition(tasks, "place").sortWithinPartitions("place").mapInArrow(freeing(made), "bucket long, key long, other long")


def allowed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs of keys whose bitmaps allow a link."""
    known = nodes.select("key", "rep", "n", "bits")
    own = pairs.join(known.toDF("key", "a", "n", "x"), "key").join(known.toDF("other", "b", "m", "y"), "other").where("a <> b").select("a", "b", "n", "m", "x", "y")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            apart = np.array([int(differ(*folded(p))) for p in pairs], np.int64)
            keep = may_link(apart, batch.column("n").to_numpy() + batch.column("m").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return own.mapInArrow(freeing(tested), "a long, b long")


def _blocks(words: np.ndarray) -> Iterator[slice]:
    """Rows of a matrix of bitmaps that are compared with all rows at once."""
    step = max(1, COMPARED // max(1, words.nbytes))
    for start in range(0, len(words), step):
        yield slice(start, start + step)


def nearest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) from dealt-out buckets: each node and the one nearest to it by bitmaps, if they allow a link."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _buckets(batches):
            rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
            if len(rep) < 2:
                continue
            words = folded(table.column("bits").to_pylist())
            for some in _blocks(words):
                apart, sizes = differ(words[some, None], words[None]), n[some, None] + n[None]
                far = np.where(may_link(apart, sizes, percent) & (rep[some, None] != rep[None]), apart / sizes, np.inf)
                best = far.argmin(1)
                ok = np.isfinite(far[np.arange(len(far)), best])
                yield pa.RecordBatch.from_arrays([pa.array(rep[some][ok]), pa.array(rep[best[ok]])], names=["a", "b"])

    return rows.mapInArrow(freeing(made), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs whose full sets have 100 * intersection >= percent * union; b may be one node for very many pairs. And the
    saved tables it reads."""
    heads = pairs.groupBy(F.col("b").alias("rep")).agg(F.count("*").alias("weight"))
    table = save(heads.join(sets, "rep").select(F.col("rep").alias("b"), "weight", F.col("set").alias("y")), "join-head-sets")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [linked(_set(x, k), _set(y, k), percent) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    return split_join(own, table, "b", "weight", total=pairs.count()).select("a", "b", "x", "y").mapInArrow(freeing(tested), "a long, b long"), [table]


def _cross_pairs(table: pa.Table, crosswise: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (i, j), i < j: pairs of different labels, and, crosswise, of different blocks, that bitmaps and sizes allow."""
    label, n, own = (table.column(c).to_numpy() for c in ("label", "n", "own"))
    if len(label) < 2 or (label == label[0]).all():
        return
    words = folded(table.column("bits").to_pylist())
    for some in _blocks(words):
        rest = slice(some.start, None)
        ok = label[some, None] != label[None, rest]
        if crosswise:
            ok &= own[some, None] != own[None, rest]
        ok &= may_link(differ(words[some, None], words[None, rest]), n[some, None] + n[None, rest], percent)
        i, j = np.nonzero(ok)
        keep = j > i
        yield i[keep] + some.start, j[keep] + some.start


def apart_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """(key, other) for nodes of different labels in groups (members: array of key, label, n, short) of at most CROWD, where
    short bitmaps allow a link; mostly once for each task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            found = np.unique(np.concatenate(held), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["key", "other"])

        for batch in batches:
            key, label, n, short = batch.column(0).flatten().flatten()
            key, label, n = key.to_numpy(), label.to_numpy(), n.to_numpy()
            words = np.frombuffer(b"".join(short.to_pylist()), np.uint64).reshape(-1, FEWEST_BITS // 64)
            group = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy())
            for d in range(1, min(CROWD, len(key))):
                at = np.flatnonzero((group[d:] == group[:-d]) & (label[d:] != label[:-d]))
                at = at[may_link(differ(words[at], words[at + d]), n[at] + n[at + d], percent)]
                held.append(np.sort(np.stack([key[at], key[at + d]], 1), 1))
            if sum(map(len, held)) >= HELD:
                held = [np.unique(np.concatenate(held), axis=0)]
                if len(held[0]) >= HELD // 2:
                    yield from out()
                    held = []
        if held:
            yield from out()

    return groups.mapInArrow(freeing(made), "key long, other long")


CROSS = "bucket long, low int, high int, own int, rep long, label long, n long, bits binary, other long"


def in_cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """What has to be looked at with full sets: pairs (rep, other) that bitmaps allow, where a block has few of them, and the
    dealt-out rows of those that are in one, where it has many; there `other` is null. At most PAIRS times as many rows come
    out as go in, however many pairs there are."""
    names = [x.split()[0] for x in CROSS.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "bits" else pa.int32() if n in ("low", "high", "own") else pa.int64()) for n in names])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), table in _buckets(batches):
            taken, pairs, few = np.zeros(table.num_rows, bool), [], PAIRS * table.num_rows
            for i, j in _cross_pairs(table, low != high, percent):
                taken[i] = taken[j] = True
                few -= len(i)
                if few >= 0:
                    pairs.append((i, j))
            if few >= 0 and pairs:
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                many = np.bincount(np.concatenate([i, j]), minlength=table.num_rows)
                i, j = np.where(many[i] > many[j], j, i), np.where(many[i] > many[j], i, j)
                rep = table.column("rep").to_numpy()
                given = {"rep": pa.array(rep[i]), "other": pa.array(rep[j])}
                yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(len(i), f.type)) for f in schema], schema=schema)
            elif taken.any():
                out = table.select(names[:-1]).filter(pa.array(taken)).append_column("other", pa.nulls(int(taken.sum()), pa.int64())).combine_chunks()
                yield from out.cast(schema).to_batches()

    return rows.mapInArrow(freeing(made), CROSS)


def cross_links(rows: DataFrame, percent: int) -> DataFrame:
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
            for i, j in _cross_pairs(table, low != high, percent):
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = find(int(label[p])), find(int(label[q]))
                    if x != y and linked(_set(sets, p), _set(sets, q), percent):
                        root[y] = x
                        joins.append(sorted((int(rep[p]), int(rep[q]))))
            if joins:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in joins], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(freeing(made), "a long, b long")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Rows are linked if their shingle sets (five words, see `setsketch`) have a Jaccard similarity of at least percent % (1 to
    100); component_id is the least id reachable over links. No link is lost: signatures and bitmaps rule out only what
    can't be one. Ids may be of any type that Spark can order. Null and empty texts have an empty set and are linked with
    nothing, as are rows whose id is null: their component is their own id. Very long texts are taken whole. Repeated rows keep
    their rows and are in one component, as are several texts under one id, each with all its links. Empty tables give an
    empty result; other columns are ignored."""
    seen = save(described(docs, id_col, text_col), "join-sets")
    classes = seen.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("key").alias("key"), F.first("bits").alias("bits"), F.first("short").alias("short"), F.count("*").alias("rows"))
    nodes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "join-nodes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = min(24, 1 + math.ceil(math.log2(max(tasks, 1))))
    met = save(meetings(packed_signatures(docs, id_col, text_col, percent, places)), "join-members")
    members = met.where("bucket is not null").select("bucket", "key")
    few = met.where("bucket is null").select(F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other")).distinct()
    sketches, band = nodes.select("rep", "n", "bits"), F.lit(0).cast("short").alias("band")
    some = save(members.where(F.pmod(F.xxhash64("bucket"), F.lit(FIRST)) == 0).join(nodes.select("key", "rep"), "key").select("bucket", band, "rep"), "join-some")
    shared = save(some.groupBy("bucket").agg(F.count("*").alias("members")), "join-shared")
    near = nearest_pairs(dealt(first_blocks(some, shared, block), sketches), percent)
    pairs = save(allowed(few, nodes, percent).union(near).distinct(), "join-pairs")
    reps = nodes.join(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct(), "rep", "left_semi")
    rows, ids = full_sets(docs, reps.select("rep", "id", "digest"), id_col, text_col, broadcast_bytes)
    sets = save(rows, "join-full")
    rows, left = confirmed(pairs, sets, percent)
    links = save(rows, "join-links")
    label = components(links)
    labelled = save(nodes.select("rep", "key", "n", "short").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "key", "n", "short", F.coalesce("component", "rep").alias("label")), "join-labels")
    named = members.join(labelled.select("key", "rep", "label", "n", "short"), "key")
    still = save(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).where("low <> high").select("bucket", "members"), "join-still")
    groups = named.join(still.where(F.col("members") <= CROWD), "bucket", "left_semi").groupBy("bucket").agg(F.collect_list(F.struct("key", "label", "n", "short")).alias("members"))
    across = allowed(apart_pairs(groups.select("members"), percent).distinct(), nodes, percent)
    apart = save(split_join(named, still.where(F.col("members") > CROWD), "bucket", "members").select("bucket", band, "rep").distinct(), "join-apart")
    rows, open_ = cross_blocks(apart, labelled, block, block_bytes)
    crossing = save(in_cross_pairs(dealt(rows, sketches), percent), "join-crossing")
    crowds = crossing.where("other is null").drop("other")
    chosen = save(crossing.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")).union(across).distinct(), "join-chosen")
    wanted = crowds.select("rep").union(chosen.select("a")).union(chosen.select("b")).distinct()
    rows, more_ids = full_sets(docs, nodes.join(wanted, "rep", "left_semi").select("rep", "id", "digest"), id_col, text_col, broadcast_bytes)
    more_sets = save(rows, "join-full")
    rows, more_left = confirmed(chosen, more_sets, percent)
    more = save(rows.union(cross_links(dealt(crowds, more_sets), percent)).distinct(), "join-more")
    edges = label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)
    out, last = by_component(seen, nodes, edges)
    result = save(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), "join-result")
    drop_saved(seen, nodes, met, some, shared, pairs, ids, sets, links, label, labelled, still, apart, open_, crossing, chosen, more_ids, more_sets, more, *left, *more_left, *last)
    return result
