"""Exact Jaccard self-join of documents by adaptive multi-match prefixes.

Shingles have a global order, rarest first by a sketch of their counts. Two similar documents of ``n``
shingles share ``l`` or more of their first ``n - ceil(t n) + l``, for any ``l``. Each document picks
its own ``l`` by the estimated cost of its candidates, and a pair is verified if it shares as many
prefix shingles as the smaller ``l`` of the two asks for.

Lists of a shingle's documents that are longer than ``LONG_LIST`` make no pairs. All of the list are
compared with one of them, its hub, and only those that are not linked to it with the others: two
documents linked to one hub are in one component already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import slices, split_by_keys, stored
from tallyweir.llm.components import components
from tallyweir.llm.shingles import forget_powers, shingle_sets

SHINGLE_WORDS = 4
# Similarity of at least this many hundredths.
PERCENT = 85
# The same for near duplicates, of which one stays.
NEAR_SHINGLE_WORDS = 5
NEAR_PERCENT = 80
SKETCH_BITS = 20
SKETCH_ROWS = 64
DEEPEST = 12
# What a posting, a pair of a list and a verification cost, relative to one another.
POSTING_COST, PAIR_COST, VERIFY_COST = 1.0, 0.5, 20.0
RARE = 8
LONG_LIST = 32
BLOCK_BYTES = 24 << 20
# Bytes of text hashed at once: some fifty bytes of arrays each.
SLICE_BYTES = 1 << 20
NEEDED_BITS = 25

HUB, MEMBER, PARTNER, VISITOR = 0, 1, 2, 3


def required_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a document of ``n`` must share with any similar one."""
    return -(-percent * n // 100)


def _profiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of each row its count and the digest of its set; of each task the sketch of its shingles."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["doc_id", "n_shingles", "digest", "part", "counts"]
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            sets = shingle_sets(rows.column("text"), size)
            if sets:
                everything = np.concatenate(sets)
                counts += np.bincount(everything & np.uint64(counts.size - 1), minlength=counts.size).astype(np.uint32)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
            ], names=names)
    if counts.any():
        parts = [p.tobytes() for p in counts.reshape(SKETCH_ROWS, -1)]
        yield pa.RecordBatch.from_arrays([
            pa.nulls(SKETCH_ROWS, pa.int64()), pa.nulls(SKETCH_ROWS, pa.int64()), pa.nulls(SKETCH_ROWS, pa.binary()),
            pa.array(range(SKETCH_ROWS), pa.int32()), pa.array(parts, pa.binary()),
        ], names=names)
    forget_powers()


def _added(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in tables:
        for counts in batch.column("counts").to_pylist():
            counts = np.frombuffer(counts, np.uint32).astype(np.uint64)
            total = counts if total is None else total + counts
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def _prefix(shingles: np.ndarray, sketch: np.ndarray, noise: int, percent: int) -> tuple[np.ndarray, int, int]:
    """A set's prefix, the matches it asks for, and how many of its shingles look rare."""
    n = len(shingles)
    counts = sketch[shingles & np.uint64(sketch.size - 1)]
    least = n - required_overlap(n, percent)
    order = np.argsort(counts, kind="stable")[: least + DEEPEST]
    others = np.maximum(counts[order].astype(np.int64) - noise - 1, 0)
    deepest = min(DEEPEST, n - least)
    pairs = np.cumsum(others)[least : least + deepest]
    depth = np.arange(1, deepest + 1)
    cost = (least + depth) * POSTING_COST + pairs * PAIR_COST + pairs / depth * VERIFY_COST
    matches = int(np.argmin(cost)) + 1
    return shingles[order[: least + matches]], matches, int(np.count_nonzero(counts < noise + RARE))


def _postings(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    noise = int(sketch.mean())
    met: set[bytes] = set()
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            token, doc, n, asked, rare = [], [], [], [], []
            for doc_id, shingles in zip(rows.column("doc_id").to_pylist(), shingle_sets(rows.column("text"), size), strict=True):
                # Of equal sets a task lets one go on; their documents are one class already.
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                if doc_id is None or not len(shingles) or digest in met:
                    continue
                met.add(digest)
                prefix, matches, light = _prefix(shingles, sketch, noise, percent)
                token.append(prefix)
                doc.append(np.full(len(prefix), doc_id))
                n.append(np.full(len(prefix), len(shingles), np.int32))
                asked.append(np.full(len(prefix), matches, np.int32))
                rare.append(np.full(len(prefix), light, np.int32))
            if token:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in token], doc, n, asked, rare)],
                    names=["token", "doc", "n", "asked", "rare"],
                )
    forget_powers()


def _sets(batches: Iterator[pa.RecordBatch], needed: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = batch.column("bit").to_numpy()
        wanted = np.flatnonzero(needed[bit >> 3] >> (bit & 7) & 1)
        chosen = batch.take(pa.array(wanted))
        for rows in slices(chosen, "text", SLICE_BYTES):
            packed = [s.tobytes() for s in shingle_sets(rows.column("text"), size)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(packed, pa.binary())], names=["doc", "shingles"])
    forget_powers()


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Verified links of each (hub, block, visit), whose rows come together; bytes of members left open if there are more blocks."""
    held, key = [], None
    out: list[tuple[int, int, int | None]] = []

    def flushed(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least and out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                names=["a", "b", "open"],
            )
            out.clear()

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("hub", "block", "visit", "doc", "role", "blocks", "shingles")]
        for hub, block, visit, doc, role, blocks, shingles in zip(*columns, strict=True):
            if (hub, block, visit) != key:
                out += _compared(key, held, percent) if key else ()
                held, key = [], (hub, block, visit)
                yield from flushed(10_000)
            held.append((role, doc, blocks, np.frombuffer(shingles, np.uint64)))
    out += _compared(key, held, percent) if key else ()
    yield from flushed(1)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (low + high - shared)


class _Groups:
    """Documents joined so far: of the links among many alike, only those that join more are told."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, doc: int) -> int:
        while (up := self.parent.get(doc, doc)) != doc:
            self.parent[doc] = self.parent.get(up, up)
            doc = up
        return doc

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def of(self, docs: list) -> np.ndarray:
        return np.array([self.find(d) for d, _ in docs])


def _compared(key, held: list, percent: int) -> list[tuple[int, int, int | None]]:
    hub = key[0]
    by_role = {role: [] for role in (HUB, MEMBER, PARTNER, VISITOR)}
    seen = set()
    for role, doc, blocks, shingles in held:
        held_as = (role, doc, hash(shingles.tobytes()))
        if held_as not in seen:
            seen.add(held_as)
            by_role[role].append((doc, blocks, shingles))
    groups = _Groups()
    # More than one if a doc_id is repeated with other texts.
    own = [s for _, _, s in by_role[HUB]]
    members = [m for m in by_role[MEMBER] if m[0] != hub]
    if not own:
        # The hub and the members of one block are compared already; these are visits.
        return _cross([(d, s) for d, _, s in by_role[VISITOR]], [(d, s) for d, _, s in members], percent, groups)
    joins = lambda s: any(_alike(o, s, percent) for o in own)
    found = [(hub, doc, None) for doc, _, s in by_role[PARTNER] if joins(s)]
    open_, linked = [], []
    for doc, blocks, shingles in members:
        if joins(shingles):
            found.append((hub, doc, None))
            groups.join(hub, doc)
            linked.append((doc, shingles))
        else:
            open_.append((doc, shingles))
            if blocks > 1:
                found.append((hub, doc, shingles.nbytes))
    found += _cross(open_, linked, percent, groups) + _cross(open_, open_, percent, groups)
    return found


def _cross(some: list, others: list, percent: int, groups: _Groups, tile: int = 256) -> list[tuple[int, int, None]]:
    """Links between two lists of (doc, set), by tiles in order of size; sizes too far apart are skipped."""
    found = []
    same = some is others
    some, others = (sorted(x, key=lambda d: len(d[1])) for x in (some, others))
    for i in range(0, len(some), tile):
        left = some[i : i + tile]
        for j in range(i if same else 0, len(others), tile):
            right = others[j : j + tile]
            if 100 * len(left[-1][1]) < percent * len(right[0][1]) or 100 * len(right[-1][1]) < percent * len(left[0][1]):
                continue
            found += _tile(left, right, percent, groups)
    return found


def _tile(left: list, right: list, percent: int, groups: _Groups) -> list[tuple[int, int, None]]:
    """All overlaps of two tiles at once: a product of their incidence matrices over shared shingles.

    Told are links that join groups, fewer than there are documents, and a tile of one group is skipped.
    """
    apart = groups.of(left)[:, None] != groups.of(right)[None, :]
    if not apart.any():
        return []
    sizes = [np.array([len(s) for _, s in x]) for x in (left, right)]
    flat = [np.concatenate([s for _, s in x]) for x in (left, right)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    overlap = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return []
    where = []
    for values, counts in zip(flat, sizes, strict=True):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        where.append((np.repeat(np.arange(len(counts)), counts)[hit], at[hit]))
    for start in range(0, len(shared), 4096):
        parts = []
        for (row, at), counts in zip(where, sizes, strict=True):
            here = (at >= start) & (at < start + 4096)
            matrix = np.zeros((len(counts), min(4096, len(shared) - start)), np.float32)
            matrix[row[here], at[here] - start] = 1
            parts.append(matrix)
        overlap += parts[0] @ parts[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - overlap
    alike = 100 * overlap.astype(np.float64) >= percent * union
    found = []
    while (alike & apart).any():
        # One link of each row at a time; what it joins needs no more.
        new = alike & apart
        for i in np.flatnonzero(new.any(axis=1)).tolist():
            a, b = left[i][0], right[int(new[i].argmax())][0]
            if groups.join(a, b):
                found.append((a, b, None))
        apart = groups.of(left)[:, None] != groups.of(right)[None, :]
    return found


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Prefix shingles that two similar documents share at least.

    As many as the smaller ``asked``; and of the document whose prefix ends first in the order, only
    what is past its prefix can be shared besides, so the prefixes share all else that they must.
    """
    required = lambda n: F.ceil(F.lit(percent) * n / 100)
    overlap = F.ceil(F.lit(percent) * (a["n"] + b["n"]) / (100 + percent))
    beyond = F.greatest(required(a["n"]) - a["asked"], required(b["n"]) - b["asked"])
    return F.greatest(F.least(a["asked"], b["asked"]), overlap - beyond)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """``hub, doc, role, n``: pairs that share enough prefix shingles, and the members of long lists with their hubs."""
    lists = postings.groupBy("token").agg(
        F.count("*").alias("length"), F.min(F.struct("rare", "doc", "n")).alias("hub")
    ).where("length > 1")
    listed = postings.join(stored(lists.select("token", "length", "hub.doc", F.col("hub.n").alias("hub_n"))
                                  .withColumnRenamed("doc", "hub"), "shingle-lists"), "token")
    short = listed.where(F.col("length") <= LONG_LIST).groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("doc", "n", "asked"))).alias("docs")
    )
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    pairs = F.flatten(F.transform("docs", lambda a, i: F.transform(
        F.filter("docs", lambda b, j: (j > i) & alike(a["n"], b["n"]) & (a["doc"] != b["doc"])),
        lambda b: F.struct(a["doc"].alias("hub"), b["doc"].alias("doc"), b["n"].alias("n"), _needed(a, b, percent).alias("needed"), a["n"].alias("hub_n")),
    )))
    verified = (
        short.select(F.explode(pairs).alias("p")).select("p.*")
        .groupBy("hub", "doc", "n", "needed", "hub_n").agg(F.count("*").alias("shared"))
        .where("shared >= needed").select("hub", "doc", F.lit(PARTNER).alias("role"), "n", "hub_n")
    )
    long = listed.where(F.col("length") > LONG_LIST).select("hub", "doc", F.lit(MEMBER).alias("role"), "n", "hub_n").distinct()
    return verified.union(long)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("hub", "block", "visit").sortWithinPartitions("hub", "block", "visit")


def _of_classes(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates between classes of equal sets, which need no verification among themselves."""
    of = classes.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "class_id").distinct()
    named = candidates.join(of.toDF("hub", "hub_class"), "hub").join(of.toDF("doc", "doc_class"), "doc")
    return named.where("hub_class <> doc_class").select(
        F.col("hub_class").alias("hub"), F.col("doc_class").alias("doc"), "role", "n"
    ).distinct()


def similar_pairs(docs: DataFrame, classes: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """Verified links ``a, b`` of classes that join everything similar: of those with one hub only what the hub does not join."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch)
    texts = docs.select("doc_id", "text")
    postings = stored(texts.mapInArrow(
        lambda batches: _postings(batches, sent.value, size, percent), "token bigint, doc bigint, n int, asked int, rare int"
    ), "postings")
    candidates = stored(_of_classes(_candidates(postings, percent), classes), "candidates")
    members = candidates.where(F.col("role") == MEMBER)
    width = stored(members.groupBy("hub").agg(
        F.ceil(F.sum(F.col("n").cast("long") * 8) / BLOCK_BYTES).cast("int").alias("blocks")
    ), "blocks-of-hubs")
    placed = candidates.join(width, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.when(F.col("role") == MEMBER, F.pmod(F.xxhash64("doc"), "blocks").cast("int")).otherwise(0))
    hubs = placed.groupBy("hub").agg(F.max("blocks").alias("blocks")).select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("doc"), F.lit(HUB).alias("role"), "blocks"
    )
    placed = stored(placed.select("hub", "block", "doc", "role", "blocks").union(hubs), "hub-members")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << NEEDED_BITS))
    sets = _needed_sets(texts, placed, bit, size)
    filled = placed.withColumn("visit", F.lit(0)).join(sets, "doc")
    schema = "a bigint, b bigint, open bigint"
    links = stored(_grouped(filled).mapInArrow(lambda batches: _links(batches, percent), schema), "links")
    found = links.where("open IS NULL").select("a", "b")
    # Members of a hub with several blocks that it does not link visit the other blocks, a block of them at a time.
    open_ = stored(links.where("open IS NOT NULL").groupBy(F.col("a").alias("hub"), F.col("b").alias("doc")).agg(F.sum("open").alias("size")), "open-members")
    if open_.isEmpty():
        return found
    visits = open_.groupBy("hub").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("visits"))
    visitors = (
        open_.join(visits, "hub").join(width, "hub").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
        .withColumn("visit", F.pmod(F.xxhash64("doc"), F.greatest("visits", F.lit(1))).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own")
        .select("hub", "block", "doc", F.lit(VISITOR).alias("role"), "blocks", "visit")
    )
    # Only blocks that have visitors are needed again.
    visited = placed.where((F.col("blocks") > 1) & (F.col("role") == MEMBER)).join(
        visitors.select("hub", "block", "visit").distinct(), ["hub", "block"]
    )
    again = visited.select(visitors.columns).union(visitors).join(sets, "doc")
    more = _grouped(again).mapInArrow(lambda batches: _links(batches, percent), schema)
    return found.union(more.select("a", "b"))


def _needed_sets(texts: DataFrame, placed: DataFrame, bit, size: int) -> DataFrame:
    """Sets of the documents to verify. A bitmap of fixed size keeps most others from being shuffled."""
    # Bits count from 1 in these functions.
    parts = placed.select((bit("doc") + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    ).collect()
    needed = np.zeros((1 << NEEDED_BITS) // 8, np.uint8)
    for r in parts:
        needed[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(needed)
    rows = texts.where("doc_id IS NOT NULL").select("doc_id", "text", bit("doc_id").alias("bit"))
    return rows.mapInArrow(lambda batches: _sets(batches, sent.value, size), "doc bigint, shingles binary")


def join(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (doc_id, text).

    Words are runs of anything but space, tab and line ends, A-Z lower-cased. A text of fewer than
    ``size`` words is one shingle; a null text, or one without words, has none and is its own
    component. ``component_id`` is the smallest doc_id that links lead to. Rows with a null doc_id
    link with nothing and have no component; rows that repeat a doc_id count as one node of the
    links. Equal texts are one class. Other columns are ignored. Shingles are compared by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    profiles = stored(texts.mapInArrow(
        lambda batches: _profiles(batches, size), "doc_id bigint, n_shingles bigint, digest binary, part int, counts binary"
    ), "profiles")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    summed = profiles.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(_added, "part int, counts binary")
    for r in summed.collect():
        counts = np.frombuffer(r["counts"], np.uint64)
        sketch[r.part * len(counts) : (r.part + 1) * len(counts)] = counts
    rows = profiles.where("part IS NULL").select("doc_id", "n_shingles", "digest")
    least = stored(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    classes = rows.join(least, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")
    )
    classes = stored(classes, "documents-of-classes")
    links = similar_pairs(texts, classes, sketch, size, percent)
    of = classes.where("doc_id IS NOT NULL").select("doc_id", "class_id").distinct()
    # A repeated doc_id with several texts ties their classes together.
    repeated = of.where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    several = of.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("doc_id").alias("a"))
    edges = links.select("a", "b").union(repeated.join(several, "a", "left_semi"))
    found = components(edges)
    return (
        classes.join(found, classes.class_id == found.node, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id")).alias("component_id"))
    )


def keep_representatives(docs: DataFrame, size: int = NEAR_SHINGLE_WORDS, percent: int = NEAR_PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, with all their columns.

    Of rows that repeat a doc_id the least by all columns stays; rows without a doc_id all stay.
    """
    found = stored(join(docs, size, percent), "components-of-documents").where("doc_id IS NOT NULL")
    judged = found.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("first")
    )
    concerned = stored(judged.where("rows > 1 OR NOT first").select("doc_id", "first"), "concerned-documents")
    some, rest = split_by_keys(docs, "doc_id", concerned.select("doc_id"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = some.join(concerned.where("first").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    return rest.union(some.join(concerned.select("doc_id"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))).union(one.select("row.*"))
