"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

Sizes are dealt into bands [2^b, 2^(b+1)). In the band of the smaller set, hashing cuts the universe of shingles into
m segments. Two sets that link differ in at most H = floor((|r| + |s|) / 9) shingles (Jaccard >= 0.8), so of segments
allocated weights d (0: unused, 1: equal contents sought, 2: contents at most one shingle apart sought) with a sum above H
one must be found. Each set allocates by cost, cheapest first: segments of several shingles with one among them that few
documents hold, then the one-deletion neighbourhoods of segments with two such shingles (cost: the segment's size), then
all non-empty segments, then all their neighbourhoods, and empty segments, which all sets share, only when nothing else suffices. Each choice is a function of a segment's content and
contains the cheaper ones, so of two sets the one with the narrower choice is sure of a match that the other has
indexed too. Which shingles are frequent is counted over all documents and changes the cost only, never the result.

Copies collapse first: a set of shingles is a class, known by a 64-bit sum of mixed hashes (by a second, independent one where two
classes share the first, so by 128 bits in all), and all that follows works on classes. A signature shared by many classes gives a star (each class with the smallest), not all pairs; map tasks form their
stars before the shuffle, so a hot signature sends one row per flush. Signatures whose members end in different
components get further stars around other leaders while they would make many pairs, and in the end all their pairs
between different components are compared by sketch, in memory, and verified, so no link between components is lost. Before sets are compared, odd sketches (parities of hashed counts) give an exact lower
bound of the difference, which refuses nearly all pairs that don't link. Shingles are
compared as 64-bit hashes: within a pair of sets of 10^4 the chance of a wrong match is about 10^-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, column, release, released, small_batches, stored, text_buffers
from .words import U, mix, shingle_hashes, word_hashes

FLUSH_ROWS = 800_000
BROADCAST_IDS = 300_000
FREQUENT_BITS = 22
MAX_ROUNDS = 2
BLOCK_ROWS = 4096
FEW = 24  # members up to which a signature's pairs are joined, not compared in memory
PAIRS_PER_ROW = 8
SIGNATURE_BITS = 56  # a chance match costs a comparison, never a result
BUCKET_ROWS = 3_000_000
PACKED_ROWS = 32768
_SPREAD = 0.28  # segments per shingle of a band's largest set: above 1/4, so most sets need no empty segment


class Names:
    """Names of sets of shingles as signed 64-bit integers: a sum of mixed hashes, or, where that is in `clashing`, a second such sum.
    `bits` below 64 leaves fewer first names, for tests."""

    def __init__(self, clashing: frozenset[int] = frozenset(), bits: int = 64):
        self.clashing, self.bits = clashing, bits

    def both(self, shingles: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            first = mix(shingles, 0x2545F4914F6CDD1D).sum(dtype=U) + U(len(shingles)) * U(0xA0761D6478BD642F)
            second = mix(shingles, 0x3C79AC492BA7B653).sum(dtype=U) + U(len(shingles)) * U(0x1C69B3F74AC4AE35)
        names = mix(np.array([first, second], U), 0xE7037ED1A0B428DB)
        if self.bits < 64:
            names[0] &= U((1 << self.bits) - 1)
        return tuple(names.view(np.int64).tolist())

    def __call__(self, shingles: np.ndarray) -> int:
        first, second = self.both(shingles)
        return second if first in self.clashing else first


def configurations(n: int) -> list[tuple[int, int, int]]:
    """(band, segments, H) in which a set of n shingles takes part: its own band, and the one below if a set of that band
    can still link with it."""
    out = []
    band = n.bit_length() - 1
    for b, own in ((band, True), (band - 1, False)):
        if b < 0:
            continue
        top = (2 << b) - 1
        if own:
            apart = (n + 5 * n // 4) // 9
        elif 5 * top // 4 >= n:
            apart = (n + top) // 9
        else:
            continue
        out.append((b, max((top + 5 * top // 4) // 9 + 1, -(-int(_SPREAD * 100) * top // 100)), apart))
    return out


def _bits(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles, 0x589965CC75374CC3) >> U(64 - FREQUENT_BITS)).astype(np.int64)


def signatures(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The index entries of one set: of equal segments, and of one-deletion neighbourhoods where the allocation has them.

    frequent: 2^FREQUENT_BITS booleans by _bits, the same for all sets.
    """
    out = []
    rare = ~frequent[_bits(shingles)]
    for band, m, apart in configurations(len(shingles)):
        segment = ((mix(shingles, 0x9FB21C651E98DF25 + band) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        values = mix(shingles, 0xD6E8FEB86659FD93)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment, minlength=m)
        rares = np.bincount(segment[rare], minlength=m)
        special = rares > 0
        segment, values = segment[order], values[order]
        used = np.flatnonzero(counts)
        content = np.zeros(m, U)
        content[used] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(counts[used])[:-1]]))
        tag = mix(np.arange(m, dtype=U) + U(band << 40), 0x8EBC6AF09C88C6E3)
        need = apart + 1
        # (equal contents sought, one apart sought as well), each choice within the next; a segment of two rare shingles keeps one
        # whichever shingle goes, so its neighbours are indexed by the same choice
        choices = [(special & (counts >= k), None) for k in (4, 3, 2, 1)] + [(special, rares >= 2), (counts >= 1, rares >= 2), (counts >= 1, counts >= 2), (np.ones(m, bool), counts >= 2)]
        for chosen, wide in choices:
            if np.count_nonzero(chosen) + (0 if wide is None else np.count_nonzero(wide)) >= need:
                break
        if wide is not None:
            near = wide[segment]
            out.append(mix((content[segment] - values)[near] ^ tag[segment][near]))
        out.append(mix(content[chosen] ^ tag[chosen]))
    return np.concatenate(out) if out else np.zeros(0, U)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the counts in hashed buckets, two to four buckets a shingle, as 64-bit words. Buckets go by the low bits of a
    hash, so XOR-ing the halves of a sketch gives the sketch of half as many buckets."""
    bits = max(6, int(len(shingles)).bit_length() + 1)
    at = (mix(shingles, 0x1D8E4E27C47D124F) & U((1 << bits) - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Booleans by _bits of the shingles that at least 0.04 % of the documents of a task hold (and three of them), over all
    documents. The table has a fixed size; what doesn't fit shares a place, which costs some selectivity and no result."""

    def run(batches):
        held, size, documents = [], 0, 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            places = np.unique(_bits(keys[n >= max(3, documents * 0.0004)]))
            return pa.RecordBatch.from_pydict({"place": places})

        for batch in batches:
            for _, shingles in _sets(batch):
                held.append(shingles)
                size += len(shingles)
                documents += 1
                if size >= 2_500_000:
                    yield flush()
                    held, size, documents = [], 0, 0
        if size:
            yield flush()

    places = docs.select(column(docs, "text", "string").alias("text")).mapInArrow(released(run), "place long").distinct()
    # at most 2^FREQUENT_BITS bits, gathered as words of 32 bits
    words = places.groupBy(F.shiftright("place", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 32 as int)))").alias("x")).toPandas()
    packed = np.zeros(1 << (FREQUENT_BITS - 5), np.uint32)
    packed[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64)
    return np.packbits(np.unpackbits(packed.view(np.uint8), bitorder="little"))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for row, n, data, offsets in text_buffers(batch.column("text")):
        for i, shingles in enumerate(shingle_hashes(*word_hashes(data, offsets))):
            yield row + i, shingles


def document_classes(docs: DataFrame, names: Names) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, second, sketch) per row; cls is null for an empty set, which links with nothing. text_key
    is a hash of the text, which tells texts of one doc_id apart."""

    def run(batches):
        kind = pa.list_(pa.int64())
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                sizes, classes, seconds, sketches = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
                for i, shingles in _sets(batch):
                    if len(shingles):
                        sizes[i], sketches[i] = len(shingles), odd_sketch(shingles)
                        classes[i], seconds[i] = names.both(shingles)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), *(pa.array(x, pa.int64()) for x in (sizes, classes, seconds)), pa.array(sketches, kind)],
                    ["doc_id", "text_key", "n_shingles", "cls", "second", "sketch"],
                )

    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), text_key(docs).alias("text_key"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, text_key long, n_shingles long, cls long, second long, sketch array<long>")


def text_key(docs: DataFrame):
    return F.xxhash64(column(docs, "text", "string"))


def _star_rows(sig: np.ndarray, ids: np.ndarray):
    """(sig, id) -> the smallest id of each signature, and distinct (sig, id, leader) for the rest, in order of sig."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    sig, ids = sig[keep], ids[keep]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    leader = ids[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    return sig[first], ids[first], sig[~first], ids[~first], leader[~first]


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs, after a byte with that width."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    """The first n numbers of _narrow's form, and what follows them."""
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data[1 : 1 + n * width], np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8"), data[1 + n * width :]


def pack(sig: np.ndarray, *ids: np.ndarray) -> bytes:
    """Sorted signatures as their differences, and columns of ids as places in a list of the distinct ones."""
    every, place = np.unique(np.concatenate(ids), return_inverse=True)
    steps = sig.copy()
    steps[1:] -= sig[:-1]
    head = np.array([len(sig), len(every)], "<u4").tobytes()
    return head + every.astype("<i8").tobytes() + _narrow(steps) + b"".join(_narrow(x) for x in np.split(place.astype(U), len(ids)))


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    """What `pack` was given: signatures, then so many columns of ids."""
    n, many = (int(x) for x in np.frombuffer(data, "<u4", 2))
    every = np.frombuffer(data, "<i8", many, 8)
    steps, rest = _wide(memoryview(data)[8 + 8 * many :], n)
    out = [np.cumsum(steps, dtype=U)]
    for _ in range(columns):
        place, rest = _wide(rest, n)
        out.append(every[place.astype(np.int64)])
    return out


def _indexed(docs: DataFrame, buckets: int, names: Names) -> DataFrame:
    """(bucket, packed): a task's smallest class of each signature, packed by ranges of signatures; others, which already know that class,
    stand as (sig, id, leader) in pieces with buckets below 0, which may go anywhere."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))  # 2^FREQUENT_BITS bits

    def run(batches):
        frequent = np.unpackbits(shared.value).astype(bool)
        held, count = [], 0

        def flush():
            s, i = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            top_sig, top, sig, ids, leader = _star_rows(s >> U(64 - SIGNATURE_BITS), i)
            at = ((top_sig >> U(SIGNATURE_BITS - 32)) * U(buckets) >> U(32)).astype(np.int64)
            cuts = np.union1d(np.flatnonzero(np.diff(at)) + 1, np.arange(0, len(at) + PACKED_ROWS, PACKED_ROWS).clip(max=len(at)))
            places = [int(at[lo]) for lo in cuts[:-1]]
            packed = [pack(top_sig[lo:hi], top[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
            for lo in range(0, len(sig), PACKED_ROWS):
                part = slice(lo, lo + PACKED_ROWS)
                places.append(-1 - int(mix(sig[lo : lo + 1] ^ ids[lo : lo + 1].view(U))[0] >> U(2)))
                packed.append(pack(sig[part], ids[part], leader[part]))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for _, shingles in _sets(batch):
                found = signatures(shingles, frequent)
                if len(found):
                    held.append((found, np.full(len(found), names(shingles), np.int64)))
                    count += len(found)
                if count >= FLUSH_ROWS:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    rows = docs.where("doc_id is not null").select(column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(released(run), "bucket long, packed binary")


def _linked_to_first(batches):
    """Rows of _indexed sorted by bucket -> (sig, id, leader). What a bucket holds is brought down to one class a signature whenever it has
    doubled, so memory follows the distinct signatures of a bucket, not how often a hot one comes."""

    def rows(sig, ids, leader):
        for lo in range(0, len(sig), 200_000):
            part = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part].astype(np.int64)) for x in (sig, ids, leader)], ["sig", "id", "leader"])

    held, count, most, last = [], 0, BUCKET_ROWS, None
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket < 0:
                yield from rows(*unpack(data.as_py(), 2))
                continue
            if held and (bucket != last or count > 2 * most):
                sig, ids, *star = _star_rows(*(np.concatenate(x) for x in zip(*held)))
                yield from rows(*star)
                held, count, most = ([], 0, BUCKET_ROWS) if bucket != last else ([(sig, ids)], len(sig), max(BUCKET_ROWS, len(sig)))
            last = bucket
            held.append(tuple(unpack(data.as_py(), 1)))
            count += len(held[-1][0])
    if held:
        yield from rows(*_star_rows(*(np.concatenate(x) for x in zip(*held)))[2:])


def stars(docs: DataFrame, shingles: int, names: Names) -> DataFrame:
    """(sig, id, leader): every class that shares a signature, tied to a smaller class with that signature. `shingles`, of all
    documents, sets how finely signatures are dealt out."""
    packed = _indexed(docs, min(1 << 30, max(16, shingles // BUCKET_ROWS)), names)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_linked_to_first), "sig long, id long, leader long")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, names: Names) -> DataFrame:
    """(cls, shingles) of the wanted (doc_id, cls), recomputed from the texts."""
    small = wanted.count() <= BROADCAST_IDS
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    rows = rows.join(F.broadcast(wanted) if small else wanted, "doc_id")

    def run(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            cls = batch.column("cls").to_pylist()
            ids, sets, size = [], [], 0
            for i, shingles in _sets(batch):
                if names(shingles) == cls[i]:  # a doc_id may stand in several rows
                    ids.append(cls[i])
                    sets.append(shingles.view(np.int64))
                    size += len(shingles)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, kind)], ["cls", "shingles"])
                    ids, sets, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, kind)], ["cls", "shingles"])

    return rows.select("cls", "text").mapInArrow(released(run), "cls long, shingles array<long>")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, names: Names) -> DataFrame:
    """The (a, b) of `pairs` with 100 * |intersection| >= percent * |union|."""
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = stored(classes.join(ids, "cls").select("doc_id", "cls"), "wanted")
    sets = _shingle_sets(docs, wanted, names)
    left = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("of_b"))
    right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("of_a"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "b").join(right, "a").where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b").distinct()


def _folded(sketch, words):
    """A sketch of twice as many words folded to `words`."""
    return F.when(F.size(sketch) <= words, F.col(sketch)).otherwise(F.zip_with(F.slice(sketch, 1, words), F.slice(sketch, words + 1, words), lambda x, y: x.bitwiseXOR(y)))


def _apart(a: str, b: str):
    """A lower bound of the symmetric difference: the differing parities of two odd sketches."""
    words = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(_folded(a, words), _folded(b, words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, id, n, root) of the signatures whose members (sig, id, n) are in several components."""
    rooted = members.join(roots.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    return stored(rooted.join(several, "sig").select("sig", "id", "n", "root"), "open")


def _near_in_signatures(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share a signature of more than FEW members and whose sizes and sketches allow the similarity, from members
    (sig, id, n, root) and (id, sketch), which are joined once the small signatures are out. Signatures are compared in memory, in pairs of blocks of about BLOCK_ROWS members; only what passes is
    put out, so a hot signature is spread over tasks and makes no rows."""
    blocks = F.ceil(F.col("many") / BLOCK_ROWS).cast("int")
    counts = members.groupBy("sig").agg(F.count("*").alias("many")).where(F.col("many") > FEW)
    rows = members.join(counts, "sig").join(sketches, "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "n", "root", "sketch")

    def compare(group):
        ids, n, root = (np.concatenate([g[k] for g in group]) for k in range(3))
        sketches = [np.array(s, np.int64).view(U) for g in group for s in g[3]]
        width = min(map(len, sketches))
        for i, s in enumerate(sketches):
            while len(s) > width:
                s = s[: len(s) // 2] ^ s[len(s) // 2 :]
            sketches[i] = s
        matrix = np.array(sketches)
        for i in range(len(ids) - 1):
            total, least, most = n[i] + n[i + 1 :], np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
            some = np.flatnonzero((root[i + 1 :] != root[i]) & (least * 100 >= most * percent))
            if len(some):
                apart = np.bitwise_count(matrix[i + 1 + some] ^ matrix[i]).sum(1, dtype=np.int64)
                for j in some[apart * (100 + percent) <= total[some] * (100 - percent)]:
                    yield min(ids[i], ids[i + 1 + j]), max(ids[i], ids[i + 1 + j])

    def run(batches):
        last, group, seen = None, [], set()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in seen], pa.int64()), pa.array([p[1] for p in seen], pa.int64())], ["a", "b"])

        for batch in batches:
            sig, x, y, ids, n, root = (np.asarray(batch.column(k)) for k in range(6))
            sketch = batch.column(6).to_pylist()
            cuts = [0, *(np.flatnonzero((sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(sig)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                key = (sig[lo], x[lo], y[lo])
                if key != last:
                    seen.update(compare(group) if group else ())
                    last, group = key, []
                    if len(seen) > 200_000:
                        yield out()
                        seen.clear()
                group.append((ids[lo:hi], n[lo:hi], root[lo:hi], sketch[lo:hi]))
        seen.update(compare(group) if group else ())
        yield out()

    return rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(released(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, keyed: bool = False, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs(doc_id, text, ...); other columns are ignored. With `keyed` also text_key, a hash of the
    text, and root, which rows share that are linked, whatever their doc_ids; null for an empty set and a null doc_id.

    Null or wordless text: an empty set, linked with nothing, its own component. A null doc_id takes no part in links and has
    a null component_id. Repeated rows give repeated results. An empty table gives an empty result. Only 80 percent
    (the threshold the segments are laid out for) or more is allowed. `bits` is for tests (see Names).
    """
    if percent < 80:
        raise ValueError("the segments are laid out for a similarity of 0.8 or more")
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.keep(_components_of_rows(docs, percent, bits), "groups")
    release(docs.sparkSession)
    return found if keyed else found.drop("text_key", "root")


def _components_of_rows(docs: DataFrame, percent: int, bits: int) -> DataFrame:
    """The rows of near_duplicates with all their columns."""
    members = stored(document_classes(docs, Names(bits=bits)), "classes")
    # classes whose first names clash: n^2 / 2^65 pairs expected among n distinct sets, a few hundred of 10^11
    clashing = members.groupBy("cls").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b").select("cls")
    names = Names(frozenset(r["cls"] for r in clashing.collect()), bits)
    if names.clashing:
        members = members.withColumn("cls", F.when(F.col("cls").isin(*names.clashing), F.col("second")).otherwise(F.col("cls")))
    lowest = F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sketch"))
    classes = stored(members.where("cls is not null and doc_id is not null").groupBy("cls").agg(lowest.alias("x")).select("cls", "x.*"), "reps")
    shingles = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    release(docs.sparkSession)
    star = stored(stars(docs, shingles, names), "stars")
    release(docs.sparkSession)
    fit = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    sizes = classes.select("cls", "n")

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and sketches allow the similarity; neither test refuses a link."""
        both = pairs.join(classes.select("cls", "n", "sketch").toDF("a", "na", "sa"), "a").join(classes.select("cls", "n", "sketch").toDF("b", "nb", "sb"), "b")
        return both.where(fit(F.col("na"), F.col("nb")) & (_apart("sa", "sb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))).select("a", "b")

    met = stored(star.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "met")
    tried = stored(likely(met), "pairs")
    release(docs.sparkSession)
    links = stored(verified(docs, tried, classes, percent, names), "links")
    release(docs.sparkSession)
    roots = components(links)
    # signatures whose star left its members in several components
    members_of = star.select("sig", "id").unionByName(star.select("sig", F.col("leader").alias("id"))).distinct()
    open_ = _open(members_of.join(sizes.toDF("id", "n"), "id"), roots)
    for round_ in range(MAX_ROUNDS):
        release(docs.sparkSession)
        size = open_.groupBy("sig").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.expr("count * (count - 1) / 2")), F.lit(0)).alias("pairs")).first()
        if size["pairs"] <= PAIRS_PER_ROW * size["n"]:
            break
        # another leader for each signature: who doesn't link with the smallest class often links with another
        lead = open_.groupBy("sig").agg(F.min_by(F.struct("id", "root"), F.xxhash64(F.lit(round_), "id")).alias("lead"))
        pairs = open_.join(lead, "sig").where(F.col("root") != F.col("lead.root"))
        pairs = pairs.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
        pairs = stored(pairs, "met")
        release(docs.sparkSession)
        more = stored(verified(docs, stored(likely(pairs), "pairs"), classes, percent, names), "links")
        met, links = met.unionByName(pairs), links.unionByName(more)
        if not more.limit(1).count():
            break
        roots = components(links)
        open_ = _open(open_.drop("root"), roots)
    release(docs.sparkSession)
    few = open_.groupBy("sig").count().where(F.col("count") <= FEW).select("sig")
    few = open_.join(few, "sig").select("sig", "id", "n", "root")
    a, b = (few.toDF("sig", x, f"n{x}", f"r{x}") for x in "ab")
    again = a.join(b, "sig").where("a < b and ra <> rb").where(fit(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    again = again.unionByName(_near_in_signatures(open_, classes.select(F.col("cls").alias("id"), "sketch"), percent)).distinct()
    again = stored(likely(again.join(met, ["a", "b"], "left_anti")), "pairs")
    release(docs.sparkSession)
    more = stored(verified(docs, again, classes, percent, names), "links")
    release(docs.sparkSession)
    if more.limit(1).count():
        roots = components(links.unionByName(more))
        release(docs.sparkSession)
    named = classes.join(roots.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(lowest, "root").select("cls", "component_id", "root")
    own = F.col("doc_id").isNotNull()
    return members.select("doc_id", "n_shingles", "cls", "text_key").join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", F.when(own, F.coalesce("component_id", "doc_id")).alias("component_id"), "text_key", F.when(own, F.col("root")).alias("root")
    )


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs(doc_id, text, ...), columns unchanged, but for near copies: of each group of linked rows, the one with the smallest
    doc_id (of several texts of that doc_id, the one with the smallest hash; of rows that repeat both, the least by their columns)
    stays. Rows without doc_id and those without words link with nothing and all stay. An empty table stays empty.

    Up to BROADCAST_IDS kept rows are looked up in a broadcast; beyond, they are joined.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = near_duplicates(docs, percent, keyed=True)
        rows = found.where("root is not null").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
        kept = scratch.keep(rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("x")).select(F.col("x.doc_id").alias("_doc"), F.col("x.text_key").alias("_key"), F.col("x.n").alias("_n")), "kept")
    release(docs.sparkSession)
    free = column(docs, "doc_id", "bigint").isNull() | ~F.coalesce(column(docs, "text", "string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    sizes = kept.agg(F.count("*").alias("rows"), F.coalesce(F.max("_n"), F.lit(0)).alias("n")).first()
    hint = F.broadcast if sizes["rows"] <= BROADCAST_IDS else lambda x: x
    here = lambda keys: (column(docs, "doc_id", "bigint") == keys["_doc"]) & (text_key(docs) == keys["_key"])
    single = kept.where("_n = 1")
    out = docs.join(hint(single), here(single), "left_semi").unionByName(docs.where(free))
    if sizes["n"] > 1:
        again = kept.where("_n > 1")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = docs.select(row, column(docs, "doc_id", "bigint").alias("doc"), text_key(docs).alias("key"))
        least = rows.join(hint(again), (rows["doc"] == again["_doc"]) & (rows["key"] == again["_key"])).groupBy("doc", "key").agg(F.min("row").alias("row"))
        out = out.unionByName(least.select("row.*"))
    return out
