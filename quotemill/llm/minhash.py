"""Operator 3: near duplicates by MinHash.

Shingles of five words; two documents are linked if 100 * common >= 75 * together of their sets.

1. Each set becomes a signature: the minima of many universal hash functions. Equal sets are one class,
   named by its least doc_id; only classes are compared.
2. Three minima make a band. Classes that share a band are held against one of them, the bucket's pivot:
   as many comparisons as members. The pivot is the member whose buckets are the largest: among edited copies
   of a text that is one near to the text itself. Signatures are compared first, then whole sets.
3. Components of these links. A bucket of one component has nothing left to find. In a mixed one what isn't in
   the largest component is held against TRIES members of that, which hashes pick; components again. In those
   that still are mixed the classes
   of different components are compared with each other, within tasks, by signature; a pair is told only where
   its first shared band leads. A large bucket is cut into blocks, and each block of classes outside the
   largest component is held against each block: whatever the size, no pair that shares a band is left out.
4. Links found there join the others; components again.

A pair at the threshold misses all of 24 bands with probability 2e-6.

A very long text is hashed whole, alone in its block, and its set is sent once to each group that it is in. Ties in
the choice of pivots and of largest components go to the greater hash; links don't depend on them.
Null or empty text: an empty set, linked with nothing, kept. Null doc_id: not comparable, as it has no name:
component_id null, kept. Rows with one doc_id are one document, linked by any of its rows. Empty input: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import shared_folder, text_blocks, written
from .words import shingle_sets

BANDS, ROWS = 24, 3
#: Functions besides those of the bands, of whose minima a signature keeps one byte each.
MORE = 128
#: In hundredths, as the rule is one of whole numbers.
THRESHOLD = 75
SHINGLE_WORDS = 5
#: Members of a bucket that one task compares with each other.
BUCKET = 1024
#: Members outside its largest component up to which a large bucket is cut into blocks of BUCKET / 2; with more, blocks
#: have FEW members, as a member is sent once for each block it meets.
FEW = 4096
#: Signature agreement that leads to whole sets: the threshold less five standard errors.
AGREEMENT = 0.6
#: Members of a mixed bucket's largest component that each class outside it is held against.
TRIES = 3
#: Bytes of sets that a task confirming a group of pairs holds at once, and pairs of a group; and of their members in
#: one step of the count.
GROUP_BYTES, GROUP_PAIRS, STEP = 8 << 20, 2048, 64
#: Rows of a small table that are worth a partition.
PARTITION_ROWS = 50_000
#: Classes to be confirmed whose names, of 8 bytes each, may be broadcast to find their texts.
BROADCAST_ROWS = 250_000


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the hash functions: fixed, odd multipliers."""
    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, 1 << 63, BANDS * ROWS + MORE, dtype=np.uint64) * np.uint64(2)
    return draw() | np.uint64(1), draw()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of a * x + b over each set, the upper 32 bits of 64; sets must not be empty."""
    a, b = _functions()
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = np.concatenate(sets)
    out = np.empty((len(sets), len(a)), np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(((x * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), edges)
    return out


def packed_signatures(found: np.ndarray) -> list[bytes]:
    """The bands' minima as they are, of the others the lowest byte."""
    words, more = found[:, : BANDS * ROWS], found[:, BANDS * ROWS :].astype(np.uint8)
    return [w.tobytes() + m.tobytes() for w, m in zip(words, more)]


def unpacked(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bands' minima and the others' bytes, a row each."""
    whole = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return np.ascontiguousarray(whole[:, : 4 * BANDS * ROWS]).view(np.uint32), whole[:, 4 * BANDS * ROWS :]


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of each signature; bands never share keys."""
    from .words import mix

    parts = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (32-bit words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            sets = shingle_sets(texts, SHINGLE_WORDS)
            full = [s for s in sets if len(s)]
            found = iter(packed_signatures(signatures(full)) if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(found) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _members(classes: DataFrame) -> DataFrame:
    """key, band, rep: one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("signature").to_pylist()
            if raw:
                keys = band_keys(unpacked(raw)[0])
                reps = np.repeat(batch.column("rep").to_numpy(), BANDS)
                bands = np.tile(np.arange(BANDS, dtype=np.int32), len(raw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(bands), pa.array(reps)], ["key", "band", "rep"]
                )

    return classes.select("rep", "signature").mapInArrow(run, "key long, band int, rep long")


def _apart(df: DataFrame) -> DataFrame:
    """df, an aggregate, as files. Joined with them, a key of any number of rows is cut into many tasks as it runs; with
    the aggregate itself as a side it would have to stay in one."""
    return df.checkpoint()


def _few(df: DataFrame) -> tuple[DataFrame, int]:
    """df as files, read by as many tasks as its rows are worth, and the number of its rows."""
    df = df.checkpoint()
    rows = df.count()
    return df.coalesce(max(1, -(-rows // PARTITION_ROWS))), rows


def _agree(one: list[bytes], other: list[bytes]) -> np.ndarray:
    sides = zip(unpacked(one), unpacked(other))
    return sum((a == b).sum(axis=1) for a, b in sides) / (BANDS * ROWS + MORE)


def _by_signature(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and signatures allow the threshold."""
    own = classes.select("rep", "n", "signature")
    sides = [own.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    both = both.where(F.expr(f"100 * least(n_a, n_b) >= {THRESHOLD} * greatest(n_a, n_b)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _agree(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist()) >= AGREEMENT
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, reps: DataFrame, bounded: bool) -> DataFrame:
    """node, set: the sorted shingle hashes of the named classes, from the whole text of one document each.

    bounded: the names are few enough to be broadcast, so that only their texts are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            sets = [s.tobytes() for s in shingle_sets(texts, SHINGLE_WORDS)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())],
                ["rep", "digest", "set"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = reps.select(F.col("rep").alias("doc_id"))
    named = rows.join(F.broadcast(names) if bounded else names, "doc_id", "left_semi")
    found = named.select("doc_id", "text").mapInArrow(run, "rep long, digest binary, set binary")
    return found.join(reps, ["rep", "digest"]).select("node", "set").dropDuplicates(["node"])


def _sets_of(named: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, set of the classes named by node."""
    named, rows = _few(named.select("node").distinct())
    bounded = rows <= BROADCAST_ROWS
    reps = classes.select("node", "rep", "digest").join(F.broadcast(named) if bounded else named, "node", "left_semi")
    return _sets(docs, reps, bounded)


def _star_groups(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a, b of pivots a as groups g: a pivot's partners are cut in groups by their number and the bytes of their
    sets, so that a pivot of any number of partners is many groups, each with the pivot's set once."""
    sized = pairs.join(classes.select(F.col("node").alias("b"), "n"), "b")
    need = F.greatest(F.count("*") / GROUP_PAIRS, F.sum("n") * 8 / GROUP_BYTES)
    parts = _apart(sized.groupBy("a").agg(F.ceil(need).cast("long").alias("parts")))
    return pairs.join(parts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("g"), "a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs g, a, b those whose whole sets meet the threshold, as edges u, v: a group's sets are sent once each and
    not once for each of its pairs."""
    pairs, rows = _few(pairs)
    if not rows:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sides = [pairs.select(F.col("g").alias("h"), F.col(s).alias("node")).distinct() for s in "ab"]
    named, _ = _few(sides[0].unionByName(sides[1]).distinct())
    sets = named.join(_sets_of(named, docs, classes), "node").select("h", "node", "set")

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        names = sets.column("node").to_numpy()
        held = [np.frombuffer(s.as_py(), np.uint64) for s in sets.column("set")]
        order = np.argsort(names)
        a, b = (order[np.searchsorted(names[order], pairs.column(s).to_numpy())] for s in "ab")
        keep = np.zeros(len(a), bool)
        number = np.split(np.unique(np.concatenate(held), return_inverse=True)[1], np.cumsum([len(s) for s in held])[:-1])
        mark = np.zeros(1 + max(int(x.max()) for x in number), bool)
        sizes = np.array([len(s) for s in held])
        by_a = np.argsort(a, kind="stable")
        for own in np.split(by_a, np.flatnonzero(np.diff(a[by_a])) + 1):
            one = a[own[0]]
            mark[number[one]] = True
            for i in range(0, len(own), STEP):
                some = own[i : i + STEP]
                starts = np.concatenate([[0], np.cumsum(sizes[b[some]])[:-1]])
                common = np.add.reduceat(mark[np.concatenate([number[k] for k in b[some]])], starts, dtype=np.int64)
                keep[some] = 100 * common >= THRESHOLD * (sizes[one] + sizes[b[some]] - common)
            mark[number[one]] = False
        return pairs.select(["a", "b"]).filter(pa.array(keep)).rename_columns(["u", "v"])

    return _few(pairs.groupBy("g").cogroup(sets.groupBy("h")).applyInArrow(run, "u long, v long"))[0]


def _across(members: DataFrame) -> DataFrame:
    """Pairs a < b of different components in one group whose signatures nearly agree.
    members: group columns k1, k2, the band that led there, block, and node, component, n, signature. A pair is
    told if the band that led there is the first that it shares; in a group of two blocks only members of different
    ones meet. Pairs come as groups g, a, b of some GROUP_PAIRS, whose sets take up to GROUP_BYTES.
    """

    def run(table: pa.Table) -> pa.Table:
        node, part, n, band, block = (table.column(c).to_numpy() for c in ("node", "component", "n", "band", "block"))
        words, more = unpacked(table.column("signature").to_pylist())
        # members of the largest component come last: they needn't meet each other
        values, number, counts = np.unique(part, return_inverse=True, return_counts=True)
        order = np.argsort(number == counts.argmax(), kind="stable")
        node, part, n, words, more, block = node[order], part[order], n[order], words[order], more[order], block[order]
        one_block = (block == block[0]).all()
        out, seen, room, piece, pairs = [np.zeros((3, 0), np.int64)], np.zeros(len(node), bool), GROUP_BYTES, 0, 0
        for i in range(len(node) - int(counts.max())):
            rest = slice(i + 1, None)
            sizes = 100 * np.minimum(n[i], n[rest]) >= THRESHOLD * np.maximum(n[i], n[rest])
            may = i + 1 + np.flatnonzero(sizes & (part[rest] != part[i]) & (one_block | (block[rest] != block[i])))
            same = words[may] == words[i]
            agree = (same.sum(axis=1) + (more[may] == more[i]).sum(axis=1)) / (BANDS * ROWS + MORE)
            first = same.reshape(len(may), BANDS, ROWS).all(axis=2)[:, : band[0] + 1].sum(axis=1) == 1
            near = may[(agree >= AGREEMENT) & first]
            for some in (near[j : j + STEP] for j in range(0, len(near), STEP)):
                both = np.append(some, i)
                need = 8 * int(n[both[~seen[both]]].sum())
                if (need > room or pairs >= GROUP_PAIRS) and seen.any():
                    seen[:], room, piece, pairs = False, GROUP_BYTES, piece + 1, 0
                    need = 8 * int(n[both].sum())
                seen[both], room, pairs = True, room - need, pairs + len(some)
                out.append(np.stack([np.full(len(some), i), some, np.full(len(some), piece)]))
        found = np.concatenate(out, axis=1)
        pairs = node[found[:2]]
        keys = (np.full(found.shape[1], table.column(k)[0].as_py(), np.int64) for k in ("k1", "k2"))
        return pa.table([*keys, found[2], pairs.min(axis=0), pairs.max(axis=0)], ["k1", "k2", "piece", "a", "b"])

    found = members.groupBy("k1", "k2").applyInArrow(run, "k1 long, k2 long, piece long, a long, b long")
    return found.select(F.xxhash64("k1", "k2", "piece").alias("g"), "a", "b")


def _blocks(members: DataFrame) -> DataFrame:
    """members of buckets of any size, each once for each pair of blocks with its own, as groups of two blocks.

    The members of a bucket's largest component, linked already, needn't meet each other. Their blocks meet the
    blocks of the other members, and those meet each other.
    """
    strays = F.col("size") - F.col("n_major")
    half = F.when(strays > FEW, FEW).otherwise(BUCKET // 2)
    dealt = members.withColumns(
        {
            "a": F.ceil(F.col("n_major") / half).cast("int"),
            "b": F.ceil(strays / half).cast("int"),
            "is_major": F.col("component") == F.col("major"),
            "at": F.xxhash64("node"),
        }
    )
    dealt = dealt.withColumns(
        {
            "block": F.when(F.col("is_major"), F.pmod("at", "a")).otherwise(F.col("a") + F.pmod("at", "b")).cast("int"),
            "other": F.explode(F.expr("sequence(if(is_major, a, 0), a + b - 1)")),
        }
    )
    return dealt.select(
        F.xxhash64("k1", "k2", F.least("block", "other")).alias("k1"),
        F.xxhash64("k2", "k1", F.greatest("block", "other")).alias("k2"),
        "band", "block", "node", "component",
    )


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with the bucket's size and largest component."""
    counts = members.groupBy("k1", "k2", "component").agg(F.count("*").alias("c"))
    spread = counts.groupBy("k1", "k2").agg(
        F.sum("c").alias("size"), F.max("c").alias("n_major"), F.max_by("component", F.struct("c", "component")).alias("major")
    )
    return members.join(_apart(spread.where("n_major < size")), ["k1", "k2"])


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of each class and the pivots of its buckets. members: key, rep, size of the bucket."""
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = members.select("key", "rep").join(weights, "rep")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", "rep"))["rep"].alias("pivot"))
    pairs = members.join(_apart(pivots), "key").where("rep <> pivot")
    return pairs.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()


def _strays(members: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of each class outside its bucket's largest component and TRIES members of that, picked by hashes."""
    left = members.select("key", F.col("rep").alias("node")).join(found, "node", "left")
    left = left.withColumn("component", F.coalesce("component", "node"))
    # the hashes know no bucket: buckets of one component mostly pick the same members
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(TRIES)]
    parts = left.groupBy("key", "component").agg(F.count("*").alias("c"), F.array(*picks).alias("picks"))
    largest = parts.groupBy("key").agg(
        F.sum("c").alias("size"), F.max_by(F.struct("c", "component", "picks"), F.struct("c", "component")).alias("major")
    )
    largest = _apart(largest.where("major.c < size").select("key", "major"))
    pairs = left.join(largest, "key").where("component <> major.component")
    return pairs.select(F.explode(F.array_distinct("major.picks")).alias("a"), F.col("node").alias("b")).distinct()


def _candidates(members: DataFrame, found: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs of different components that share bands and nearly agree, as g, a, b: each pair in one group.

    members: key, band, rep of each class in each bucket; found: node, component; own: rep, n, signature.
    """
    signature = own.select(F.col("rep").alias("node"), "n", "signature")
    left = members.select(F.col("key").alias("k1"), F.lit(0).cast("long").alias("k2"), "band", F.col("rep").alias("node"))
    left = left.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = written(_mixed(left), "mixed")
    small, large = left.where(F.col("size") <= BUCKET), left.where(F.col("size") > BUCKET)
    out = _across(small.withColumn("block", F.lit(0)).join(signature, "node"))
    if not large.isEmpty():
        out = out.unionByName(_across(_blocks(large).join(signature, "node")))
    return out.groupBy("a", "b").agg(F.min("g").alias("g")).select("g", "a", "b")


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (digest, node) and the links of near ones (u, v).

    A node is a class, named by a hash of its set; a doc_id with several rows names one class for each of its sets.
    """
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    classes = written(classes, "classes").withColumn("node", F.xxhash64("digest"))
    own = classes.select(F.col("node").alias("rep"), "n", "signature")

    members = written(_members(own), "bands")
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(members.join(_apart(shared), "key"), "buckets")
    stars, _ = _few(_stars(members))
    edges = _confirmed(_star_groups(_few(_by_signature(stars, own))[0], classes), docs, classes)
    strays, _ = _few(_by_signature(_strays(members, components(edges)), own))
    edges = edges.unionByName(_confirmed(_star_groups(strays, classes), docs, classes))
    pairs = _candidates(members, components(edges), own)
    return classes, edges.unionByName(_confirmed(pairs, docs, classes))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept, of every row of docs."""
    shared_folder(docs.sparkSession)
    signed = written(_signed(docs), "signatures")
    classes, edges = links(docs, signed)
    # nodes are hashes of sets; the rows of a doc_id tie its sets together
    names = signed.where("doc_id IS NOT NULL AND n_shingles > 0").select(F.xxhash64("digest").alias("node"), "doc_id")
    several = names.distinct().groupBy("doc_id").agg(F.count("*").alias("k"), F.min("node").alias("v"))
    tied = names.join(several.where("k > 1"), "doc_id").where("node <> v").select(F.col("node").alias("u"), "v")
    parts = components(edges.select("u", "v").unionByName(tied))
    whole = classes.select("node", "rep").join(parts, "node", "left")
    whole = whole.select("node", "rep", F.coalesce("component", "node").alias("part"))
    least = whole.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "part").select("node", "component_id")
    rows = signed.select("doc_id", "n_shingles", F.xxhash64("digest").alias("node"))
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(named, "node")
    empty = rows.where("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    every = full.select(*columns).unionByName(empty.select(*columns))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: one document of each component."""
    found = near_duplicates(docs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
