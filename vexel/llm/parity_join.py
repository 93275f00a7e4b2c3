"""Exact n-gram Jaccard join through parity sketches.

A document is the set of its distinct n-word shingles. Its sketch is a bit vector in which every
shingle flips one bit, so the Hamming distance of two sketches is at most the symmetric
difference of the sets: a shared shingle flips the same bit in both. Documents of one size band
have sketches of ``s`` segments. Linked documents of the band differ in at most ``tau`` shingles,
so at most ``tau`` segments differ, and by the pigeonhole principle ``s - tau`` are equal. Segments
are wide (2^64 bits) and sparse and are kept folded: the XOR of a random code for each bit set.
Each document offers ``tau + 1`` of its segments, in one order common to all (those with most
rare shingles first, empty ones last), and linked documents meet in one of these. A document
with too many empty segments for that is sketched again with another seed, as often as it takes.

Copies of a set are one node throughout. Groups that meet in segments are named by their least
node and merged by that name, and are held against each other by narrow sketches, whose Hamming
distance rules false pairs out, in tiles of bounded size: no row is written for a pair that
the sketches refuse. Of the pairs that they allow, enough to connect what all of them connect
are verified on the whole sets; where sets refuse some of these, all pairs that sketches allow
across the components left are. So no link that matters is lost, and no group of near copies is
expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vexel.llm.components import components
from vexel.llm.scratch import Scratch, cleaning, written

WORDS, SIMILARITY = 5, (75, 100)
#: Documents sampled to learn which shingles are frequent. This orders segments and so affects cost only.
SAMPLE_DOCS = 20_000
#: A shingle of this many sampled documents is frequent; at most so many are sent to the tasks (8 bytes each).
FREQUENT_IN, MAX_FREQUENT = 3, 500_000
#: A segment that so many documents of one block share is met within the block, and by one of them beyond it.
HOT_IN_BLOCK = 64
#: Members of a group that are held against each other in one task.
TILE = 2048
#: Bytes of text whose offers are met in one bucket, about; their offers have as many.
BUCKET_BYTES = 8_000_000
#: Rounds in which buckets are shuffled and met, so that not all offers lie on disk twice.
BUCKET_ROUNDS = 2
#: 64-bit words of the narrow sketch of up to 512 shingles; it doubles with the size.
NARROW = 16
#: Keys joined by broadcast at most (about 40 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_BLOCK_BYTES = 8_000_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def band_edges(limit: int) -> list[int]:
    """Least sizes of the bands, up to beyond ``limit``: linked sizes lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, 4 * (edges[-1] - 1) // 3 + 1))
    return edges


def plan(n: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band in which sets of sizes ``n`` are sketched (their own, or ``up`` = 1: the next), its ``tau`` and ``s``.

    Band ``k`` compares its own sets with each other and with those of band ``k - 1``.
    """
    edges = np.asarray(band_edges(int(n.max(initial=1)) * 2))
    band = np.searchsorted(edges, n, side="right") - 1 + up
    tau = 2 * (edges[band + 1] - 1) // 7
    tau[(up == 1) & (4 * n // 3 < edges[band])] = 0  # no partner is that large
    return band, tau, tau + 1 + np.maximum(1, 3 * tau)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out * _M1 + h[k : k + n])
    return np.unique(out)


def node_of(hashes: np.ndarray) -> int:
    """Order-free 64-bit digest of a set of hashes."""
    total = mix(hashes ^ _M1).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.asarray([len(hashes)], dtype=np.uint64) * _M1).view(np.int64)[0])


def segments(tokens: np.ndarray, rare: np.ndarray, sizes: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray]:
    """Offered segments of a block of sets laid end to end: place of the set, and 64-bit signature."""
    band, tau, s = plan(sizes, up)
    todo = np.flatnonzero(tau > 0)
    starts = np.cumsum(sizes) - sizes
    owners, signatures, seed = [], [], 0
    while len(todo):
        each = sizes[todo]
        owner = np.repeat(np.arange(len(todo)), each)
        at = np.repeat(starts[todo] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        salt = mix((band[todo].astype(np.uint64) << np.uint64(8)) + np.uint64(seed + 1))
        h = mix(tokens[at] ^ salt[owner])
        parts = s[todo]
        first = np.cumsum(parts) - parts
        segment = ((h >> np.uint64(32)) * parts.astype(np.uint64)[owner]) >> np.uint64(32)
        cell = first[owner] + segment.astype(np.int64)
        word = np.zeros(parts.sum(), dtype=np.uint64)
        np.bitwise_xor.at(word, cell, mix(h + _M1))
        scarce = np.bincount(cell[rare[at]], minlength=len(word))
        holder = np.repeat(np.arange(len(todo)), parts)
        offered = np.flatnonzero(word)
        # By set, then segments with most rare shingles, then by place.
        offered = offered[np.lexsort((-scarce[offered], holder[offered]))]
        of = holder[offered]
        count = np.bincount(of, minlength=len(todo))
        rank = np.arange(len(offered)) - np.repeat(np.cumsum(count) - count, count)
        taken = rank <= tau[todo][of]
        offered, of = offered[taken], of[taken]
        place = (offered - first[of]).astype(np.uint64)
        owners.append(todo[of])
        signatures.append(mix(mix(word[offered] ^ salt[of]) + place * _M1))
        todo = todo[count <= tau[todo]]
        seed += 1
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(signatures)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        block = np.cumsum(length) // _BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def narrow(sets: list[np.ndarray]) -> list[bytes]:
    """Parity sketches of about two bits for each shingle, a power of two long.

    The halves of a sketch XORed are the sketch of half the length.
    """
    sizes = np.asarray([len(x) for x in sets], dtype=np.int64)
    words = NARROW << np.ceil(np.log2(np.maximum(sizes, 512) / 512)).astype(np.int64)
    first = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = mix((np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)) + _M3)
    flat = np.zeros(words.sum(), dtype=np.uint64)
    at = first[owner] + ((h >> np.uint64(6)) & (words[owner] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(flat, at, np.uint64(1) << (h & np.uint64(63)))
    return [x.astype("<u8").tobytes() for x in np.split(flat, first[1:])] if sets else []


def _offers(rows, bucket: np.ndarray, nodes: np.ndarray, signature: np.ndarray, hot: bool) -> pa.RecordBatch:
    """Offers by bucket: nodes, and the low 32 bits of the signature that each offers."""
    order = np.argsort(bucket, kind="stable")
    bucket, nodes, low = bucket[order], nodes[order].astype("<i8"), signature[order].astype("<u4")
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*starts[1:], len(bucket)]
    parts = lambda x: [x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return rows(len(starts), bucket=bucket[starts].astype(np.int32), hot=np.full(len(starts), hot), nodes=parts(nodes), signatures=parts(low))


def _sketch(df: DataFrame, words: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Per document ``(key, doc_id, node, n)``, with its ``narrow`` sketch where a task first meets the node; per
    bucket and block ``(bucket, hot, nodes, signatures)``; for members of a hot segment of a block ``(grp, node)``."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)
    schema = "key long, doc_id long, node long, n long, grp long, narrow binary, bucket int, hot boolean, nodes binary, signatures binary"
    longs, blobs = ("key", "doc_id", "node", "n", "grp"), ("nodes", "signatures")
    arrow = pa.schema([(c, pa.int64()) for c in longs] + [("narrow", pa.binary()), ("bucket", pa.int32()), ("hot", pa.bool_())] + [(c, pa.binary()) for c in blobs])

    def rows(rows_: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows_, f.type) for f in arrow], schema=arrow)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _blocks(batches):
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            nodes = [node_of(x) for x in sets]
            sizes = [len(x) for x in sets]
            new = [k for k, n in enumerate(nodes) if sizes[k] > 2 and n not in seen and not seen.add(n)]
            sketches: list[bytes | None] = [None] * len(sets)
            for k, sketch in zip(new, narrow([sets[k] for k in new]), strict=True):
                sketches[k] = sketch
            yield rows(len(sets), key=batch.column("key"), doc_id=batch.column("doc_id"), node=nodes, n=sizes, narrow=sketches)
            if not new:
                continue
            tokens = np.concatenate([sets[k] for k in new])
            ids = np.asarray([nodes[k] for k in new], dtype=np.int64)
            size = np.asarray([sizes[k] for k in new], dtype=np.int64)
            known = shared.value
            rare = np.ones(len(tokens), dtype=bool)
            if len(known):
                rare = known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] != tokens
            for up in (0, 1):
                owner, signature = segments(tokens, rare, size, up)
                bucket = ((signature >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                _, same, times = np.unique(signature, return_inverse=True, return_counts=True)
                crowded = times[same] > HOT_IN_BLOCK
                if crowded.any():
                    name = (bucket[crowded] << 32) | (signature[crowded] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    yield rows(len(name), grp=name, node=ids[owner[crowded]])
                    first = np.lexsort((ids[owner], same))
                    first = first[np.diff(same[first], prepend=-1) > 0]
                    one = np.zeros(len(owner), dtype=bool)
                    one[first] = True
                for hot in (False, True):
                    part = np.flatnonzero(crowded & one if hot else ~crowded) if crowded.any() else np.arange(0 if hot else len(owner))
                    if len(part):
                        yield _offers(rows, bucket[part], ids[owner[part]], signature[part], hot)

    return df.mapInArrow(task, schema)


def _meet(table: pa.Table) -> pa.Table:
    """Nodes that offer one signature in a bucket, ``(grp, node, hot)``: the group is named by its least node.

    Nodes are random numbers, so groups of nearly the same members mostly have the same least
    one and are merged by their name. Groups of hot segments are named by the segment, as members from within a block
    name them too.
    """
    out = pa.schema([("grp", pa.int64()), ("node", pa.int64()), ("hot", pa.bool_())])
    read = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in table.column(c).to_pylist()])
    nodes, signature = read("nodes", "<i8"), read("signatures", "<u4").astype(np.int64)
    hot = np.repeat(table.column("hot").to_numpy(), [len(x) // 4 for x in table.column("signatures").to_pylist()])
    order = np.lexsort((nodes, signature))
    nodes, signature, hot = nodes[order], signature[order], hot[order]
    heads = np.flatnonzero(np.diff(signature, prepend=-1))
    each = np.diff(heads, append=len(nodes))
    hot = np.repeat(np.logical_or.reduceat(hot, heads), each)
    least = np.repeat(nodes[heads], each)
    alone = np.repeat(nodes[heads] == nodes[heads + each - 1], each)  # a node that tasks have met in several places
    named = np.where(hot, (table.column("bucket")[0].as_py() << 32) | signature, least)
    keep = hot | ~alone
    found = pa.Table.from_arrays([pa.array(named[keep]), pa.array(nodes[keep]), pa.array(hot[keep])], schema=out)
    return found.group_by(["grp", "node", "hot"]).aggregate([]).select(out.names).cast(out)


def _frequent(df: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the shingles that many sampled documents share, and the bytes of all texts."""
    n = df.count()
    if not n:
        return np.zeros(0, dtype=np.uint64), 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    whole = Observation()
    texts = df.select("text").observe(whole, F.sum(F.octet_length("text")).alias("bytes"))
    sample = texts.sample(min(1.0, SAMPLE_DOCS / n), seed=7)
    counted = sample.mapInArrow(task, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT_IN)
    with cleaning(df.sparkSession):
        top = counted.orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64)), whole.get["bytes"] or 0


def _small(keys: DataFrame) -> DataFrame:
    """Marked for broadcast if few enough; otherwise joined by a shuffle, where AQE splits hot keys."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _sets(df: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(node, hashes)`` of the wanted ``(key, node)``; of rows that repeat a key, one a task at least."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _blocks(batches):
            nodes, hashes = [], []
            for text, node in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True):
                found = shingle_hashes(text, words) if node not in seen else None
                if found is not None and node_of(found) == node:
                    seen.add(node)
                    nodes.append(node)
                    hashes.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "hashes"])

    return df.join(_small(wanted), "key").select("text", "node").mapInArrow(task, "node long, hashes array<long>")


def _close(nodes: np.ndarray, n: np.ndarray, comp: np.ndarray, asks: np.ndarray, sketches: list[bytes], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile whose sizes and sketches allow a link, of different components and one asking at least.

    A link means a symmetric difference of at most a seventh of both sizes, which the Hamming
    distance of the sketches can't exceed. If not ``every`` such pair is wanted, only pairs are
    given that connect what all of them connect, for each document the closest ones.
    """
    order = np.argsort(n, kind="stable")
    nodes, n, asks = nodes[order], n[order], asks[order]
    comp = np.unique(comp[order], return_inverse=True)[1]
    length = np.asarray([len(sketches[k]) // 8 for k in order])
    found_a, found_b = [], []
    up_to = np.searchsorted(n, 4 * n // 3, side="right")
    at, size = 0, 0
    for i in range(len(n) - 1):
        if length[i] != size:  # sketches of this length, and those twice as long folded to it
            at, size = i, length[i]
            ends = np.searchsorted(length, [size, 2 * size], side="right")
            flat = np.frombuffer(b"".join(sketches[k] for k in order[at : ends[0]]), dtype="<u8").reshape(-1, size)
            twice = np.frombuffer(b"".join(sketches[k] for k in order[ends[0] : ends[1]]), dtype="<u8").reshape(-1, 2, size)
            flat = np.concatenate([flat, twice[:, 0] ^ twice[:, 1]])
        window = slice(i + 1, up_to[i])
        j = i + 1 + np.flatnonzero((comp[window] != comp[i]) & (asks[window] | asks[i]))
        if not len(j):
            continue
        flips = np.bitwise_count(flat[j - at] ^ flat[i - at]).sum(axis=1, dtype=np.int64)
        passed = 7 * flips <= n[i] + n[j]
        j, flips = j[passed], flips[passed]
        if len(j) and not every:
            j = j[np.argsort(flips, kind="stable")]
            j = j[np.sort(np.unique(comp[j], return_index=True)[1])]
            comp[np.isin(comp, comp[j])] = comp[i]
        found_a.append(np.full(len(j), i))
        found_b.append(j)
    if not found_a:
        return nodes[:0], nodes[:0]
    a, b = nodes[np.concatenate(found_a)], nodes[np.concatenate(found_b)]
    return np.minimum(a, b), np.maximum(a, b)


def _in_tiles(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of tiles; rows are sorted by tile, and a tile may reach over several batches."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tile = np.stack([table.column(c).to_numpy() for c in ("grp", "part", "slice")])
        cuts = np.flatnonzero((np.diff(tile) != 0).any(axis=0)) + 1
        node, n, comp, asks = (table.column(c).to_numpy() for c in ("node", "n", "comp", "asks"))
        sketches = table.column("narrow").to_pylist()
        found = []
        for x, y in zip([0, *cuts], [*cuts, len(node)], strict=True):
            if y - x > 1 and (comp[x:y] != comp[x]).any():
                found.append(_close(node[x:y], n[x:y], comp[x:y], asks[x:y], sketches[x:y], every))
        for side in np.array_split(np.arange(len(found)), max(1, len(found) // 1000)):
            if len(side):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found[k][e] for k in side])) for e in (0, 1)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("grp", "part", "slice")]
        same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in zip(("grp", "part", "slice"), last, strict=True)])
        begin = int(np.argmax(same))  # the last tile of the batch may go on in the next one
        first = held and [held[0].column(c)[0].as_py() for c in ("grp", "part", "slice")]
        if begin or (held and first != last):
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _candidates(met: DataFrame, near: DataFrame, star: bool = False, every: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` of groups ``(grp, node, comp)`` whose sketches allow a link; see :func:`_close`.

    A group of at most ``TILE`` members is one tile. A larger one is dealt over parts, and its
    members outside its largest component over slices; each part meets each slice. With ``star``,
    only members of larger groups are compared, and with the group's least node alone.
    """
    if star:
        sizes = met.groupBy("grp").agg(F.count("*").alias("all")).where(F.col("all") > TILE)
        sizes = sizes.withColumns({"largest": F.lit(None).cast("long"), "others": F.lit(1).cast("long")})
    else:
        each = met.groupBy("grp", "comp").count()
        sizes = each.groupBy("grp").agg(F.sum("count").alias("all"), F.max(F.struct("count", "comp")).alias("most")).where(F.col("all") > TILE)
        sizes = sizes.select("grp", "all", F.col("most.comp").alias("largest"), (F.col("all") - F.col("most.count")).alias("others"))
    sized = met.join(_small(sizes), "grp", "left")
    parts, slices = (F.ceil(F.col(c) / TILE).cast("int") for c in ("all", "others"))
    outside = F.col("node") == F.col("grp") if star else F.col("comp") != F.col("largest")
    big = sized.where("all is not null and others > 0")
    numbers = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    base = ("grp", "node", "comp")
    tiles = big.select(*base, F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), numbers(slices).alias("slice"), F.lit(False).alias("asks"))
    tiles = tiles.union(big.where(outside).select(*base, numbers(parts).alias("part"), F.pmod(F.xxhash64("node", F.lit(1)), slices).cast("int").alias("slice"), F.lit(True).alias("asks")))
    if not star:
        tiles = tiles.union(sized.where("all is null").select(*base, F.lit(0).alias("part"), F.lit(0).alias("slice"), F.lit(True).alias("asks")))
    rows = tiles.join(near, "node").repartition("grp", "part", "slice").sortWithinPartitions("grp", "part", "slice")
    rows = rows.select("grp", "part", "slice", "node", "comp", "asks", "n", "narrow")
    return rows.mapInArrow(lambda batches: _in_tiles(batches, every), "a long, b long").distinct()


def _verified(tables: Scratch, docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Of node pairs ``(a, b)`` those that link, with the sizes of intersection and union, from the whole sets."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = tables.write(used.join(nodes, "node").select("key", "node"), "wanted")
    sets = tables.write(_sets(docs, wanted, words).dropDuplicates(["node"]), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("common", F.size(F.array_intersect("ha", "hb")).cast("long"))
    both = both.withColumn("either", F.size("ha") + F.size("hb") - F.col("common"))
    need, of = similarity
    links = written(both.where(of * F.col("common") >= need * F.col("either")).select("a", "b", "common", "either"), "links")
    tables.drop("wanted", "sets")
    return links


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Members and links of the join.

    Members: a row per document, ``(key, doc_id, node, n, component_id, stays)``; ``key`` names
    its id and text, ``node`` its set, ``n`` is the set's size, ``component_id`` the least
    ``doc_id`` reachable by links, and ``stays`` holds for one key of each component: one of that
    id. Links: verified pairs of nodes, ``(a, b, common, either)``, enough of them to connect
    every component. It is not counted how many links each document has: in a group of near
    copies their number grows with the group's square.

    Words are lower-cased in A-Z and split at ASCII white space; a text with fewer words than
    ``words`` is one shingle. Null and empty texts have no shingles, link with nothing and all
    stay. A null ``doc_id`` takes part; a component is null if no member has an id. Repeated
    rows and ids have a row each. Other columns are ignored; an empty input gives no rows.
    """
    spark = df.sparkSession
    tables = Scratch(spark)
    id_, text_ = F.col(doc_id).cast("long"), F.col(text).cast("string")
    docs = df.select(F.xxhash64(id_, text_).alias("key"), id_.alias("doc_id"), text_.alias("text"))
    frequent, size = _frequent(docs, words)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    base = tables.write(_sketch(docs, words, frequent, buckets), "sketches")
    members = written(base.where("n is not null").select("key", "doc_id", "node", "n"), "members")
    offers = base.where("bucket is not null").select("bucket", "hot", "nodes", "signatures")
    parts = [offers.where(F.col("bucket") % BUCKET_ROUNDS == k).groupBy("bucket").applyInArrow(_meet, "grp long, node long, hot boolean") for k in range(BUCKET_ROUNDS)]
    found = reduce(DataFrame.union, [tables.write(part, f"found{k}") for k, part in enumerate(parts)])
    hot = found.where("hot").select("grp", "node").union(base.where("grp is not null").select("grp", "node")).distinct()
    hot = tables.write(hot, "hot")
    least = hot.groupBy("grp").agg(F.min("node").alias("least"))
    hot = hot.join(_small(least), "grp").select(F.col("least").alias("grp"), "node")
    met = tables.write(found.where("not hot").select("grp", "node").union(hot).distinct(), "met")
    sketches = base.where("narrow is not null").select("node", "n", "narrow")
    near = tables.write(sketches.join(_small(met.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"]), "near")
    tables.drop("sketches", "hot", *[f"found{k}" for k in range(BUCKET_ROUNDS)])
    nodes = members.where("n > 0").groupBy("node").agg(
        F.coalesce(F.min_by("key", "doc_id"), F.min("key")).alias("key"), F.min("doc_id").alias("least"), F.count("*").alias("rows")
    )
    nodes = tables.write(nodes, "nodes")

    # What sketches connect: large groups by their least node first, then all by tiles.
    alone = met.withColumn("comp", F.col("node"))
    star = tables.write(_candidates(alone, near, star=True), "star")
    supposed = components(star)
    named = lambda of, comps, c: of.join(comps.withColumnRenamed("comp", c), "node", "left").withColumn(c, F.coalesce(c, "node"))
    pairs = tables.write(star.union(_candidates(named(met, supposed, "comp"), near)).distinct(), "pairs")
    links = _verified(tables, docs, pairs, nodes, words, SIMILARITY)
    comps = components(links)
    if pairs.count() > links.count():
        # Where sets refuse what sketches connect, every pair that sketches allow across what is left is verified.
        whole = components(pairs)
        split = named(named(met, whole, "whole"), comps, "comp").withColumn("grp", F.xxhash64("grp", "whole")).drop("whole")
        apart = split.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("grp")
        split = tables.write(split.join(_small(apart), "grp", "left_semi"), "split")
        more = _candidates(split, near, every=True).join(pairs, ["a", "b"], "left_anti")
        new = _verified(tables, docs, tables.write(more, "more"), nodes, words, SIMILARITY)
        if new.limit(1).count():
            links = written(links.union(new), "links")
            comps = components(links)
        tables.drop("more", "split")

    shared = nodes.join(comps, "node", "left").where("rows > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "node"))
    shared = tables.write(shared, "shared")
    of = shared.groupBy("comp").agg(F.min("least").alias("component_id"), F.coalesce(F.min_by("key", "least"), F.min("key")).alias("stay"))
    classes = written(shared.join(of, "comp").select("node", "component_id", "stay"), "classes")
    tables.drop("met", "near", "nodes", "star", "pairs", "shared")
    out = members.join(_small(classes), "node", "left")
    linked = F.col("stay").isNotNull()
    out = out.select("key", "doc_id", "node", "n", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), (~linked | (F.col("stay") == F.col("key"))).alias("stays"))
    return out, links


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows without all but one row of each component (one of the least id; ids before nulls).

    Rows are told apart by id and text, so a repeated or null id doesn't save a copy. Texts without
    words all stay. Of repeated rows of the document that stays, one stays.
    """
    members, _ = join(df, doc_id, text)
    drop = written(members.where("not stays").select("key").distinct(), "dropped")
    again = written(members.where("stays and n > 0").groupBy("key").count().where("count > 1").select("key"), "repeated")
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    i, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    keyed = inner.withColumn("key", F.xxhash64(F.col(i).cast("long"), F.col(t).cast("string")))
    kept = keyed.join(_small(drop), "key", "left_anti")
    if again.limit(1).count():
        once = kept.join(_small(again), "key", "left_semi").dropDuplicates(["key"])
        kept = kept.join(_small(again), "key", "left_anti").unionByName(once)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
