"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: the text with A-Z lower-cased is cut into words; the XXH64 values (seed 42)
of its word shingles, repeats included, vote on each bit; a bit is set if more than half
of them have it. Links: fingerprints that differ in at most ``radius`` bits.

Finding links. Equal fingerprints are one row from here on (with the smallest id), so a
group of exact copies costs one row. Two fingerprints that differ in r bits agree wholly
in all but r of ``BLOCKS`` = r + 2 blocks of the bits, so they meet in the bucket of some
pair of blocks (every pair is tried): a bucket's key is the pair and the bits of its two
blocks. Within the buckets the distances are counted bit-sliced: the fingerprints of many
buckets stand side by side, one bit plane per bit position; one shift compares every
fingerprint with the one ``d`` places on, and carry-save counters over the 64 difference
planes give all these distances at once. A lane whose count passes the radius is out, and
a block of lanes is abandoned as soon as all of its lanes are out. Only each bucket's
spanning forest leaves the task, not its pairs.

Hot buckets: a bucket with more than ``bucket_limit`` distinct fingerprints is not
compared; its members' remaining bits are cut into blocks again and the bucket becomes
buckets with longer keys, level by level. After the last level a bucket has at most
2^8 members with the default radius, whatever the input, so every link is found and no
task holds an unbounded group. The forests are joined into components by
:mod:`voltframe.llm.components`.

Edge cases: null and blank texts have no shingle and fingerprint zero, and link like any
other; fewer words than a shingle has are one shingle. Repeated ids are rows of their own;
null ids get the component of their fingerprint (null only if no linked row has an id).
An empty table gives no rows. Input columns named like a result column are replaced;
others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.llm.components import components, forest
from voltframe.session import materialize

SEED = 42
BITS = 64
LANES = 1 << 15  # fingerprints that stand side by side in one block of a task
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BUCKET_LIMIT = 4096


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:].tolist()
    h = xxhash.xxh64_intdigest
    values = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), dtype="<u8", count=n)
    set_ = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):  # a slice at a time, so that a long text needs little memory
        bits = np.unpackbits(values[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """``docs`` without the text, plus ``out_col`` (the fingerprint as a signed long)."""
    kept = [f for f in docs.schema if f.name not in (text_col, out_col)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(fps.view(np.int64))], names=[*names, out_col])
            del batch
            pa.default_memory_pool().release_unused()  # workers stay; a large batch's memory should not

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.LongType())]))


# ------------------------------------------------------------------ bit-sliced comparison
def _plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _planes(fps: np.ndarray) -> list[int]:
    return [_plane((fps >> np.uint64(b)) & np.uint64(1)) for b in range(BITS)]


def _lanes(mask: int, n: int) -> np.ndarray:
    data = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little")[:n])


def close_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``radius`` bits apart, both in the same bucket.

    The buckets lie one after another in ``fps``, the largest first; ``sizes`` are theirs.
    """
    place = np.concatenate([np.arange(s) for s in sizes])
    size = np.repeat(sizes, sizes)
    width = (radius + 1).bit_length()
    n, planes = len(fps), None
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        active = int(sizes[sizes > d].sum())
        if planes is None or active * 2 < n:
            n, planes = active, _planes(fps[:active])
        valid = _plane(place[:n] + d < size[:n])
        full = (1 << n) - 1
        out = full ^ valid
        counter = [0] * width
        for p in planes:
            carry = (p ^ (p >> d)) & ~out
            if not carry:
                continue
            for j in range(width):  # carry-save: add the difference bit to every lane's count
                counter[j], carry = counter[j] ^ carry, counter[j] & carry
                if not carry:
                    break
            passed = full
            for j in range(width):
                passed &= counter[j] if (radius + 1) >> j & 1 else ~counter[j]
            out |= passed
            if out == full:
                break
        if out != full:
            lanes = _lanes(full ^ out, n)
            yield lanes, lanes + d


def bucket_forest(ids: np.ndarray, fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each bucket (``bucket`` is sorted)."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return ids[:0], ids[:0]
    take = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in order])
    ids, fps = ids[take], fps[take]
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[by_id] = np.arange(len(ids))
    a, b, held = [], [], 0
    for x, y in close_pairs(fps, sizes[order], radius):
        a.append(rank[x])
        b.append(rank[y])
        held += len(x)
        if held > 1_000_000:  # keep a forest instead of the pairs
            label = forest(len(ids), np.concatenate(a), np.concatenate(b))
            node = np.flatnonzero(label != np.arange(len(ids)))
            a, b, held = [node], [label[node]], 0
    if not a:
        return ids[:0], ids[:0]
    label = forest(len(ids), np.concatenate(a), np.concatenate(b))
    node = np.flatnonzero(label != np.arange(len(ids)))
    return ids[by_id[node]], ids[by_id[label[node]]]


def _bucket_links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Forest edges ``u, v`` of rows ``keys, fp, rep``; buckets are bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def compare(table: pa.Table, last: bool):
            key = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(table.num_rows, dtype=bool)
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            end = table.num_rows if last or not change.any() else int(np.flatnonzero(change)[-1])
            if not last and not change.any():
                return None, table
            head = table.slice(0, end)
            u, v = bucket_forest(head.column("rep").to_numpy(), head.column("fp").to_numpy().view(np.uint64),
                                 np.cumsum(change[:end]), radius)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]), table.slice(end)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LANES:
                out, rest = compare(pa.Table.from_batches(held).combine_chunks(), False)
                if out is not None:
                    yield out
                held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if rows:
            yield compare(pa.Table.from_batches(held).combine_chunks(), True)[0]

    return (
        rows.repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(run, "u long, v long")
    )


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def near_links(distinct: DataFrame, radius: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Forest edges ``u, v`` (ids ``rep``) of all fingerprints ``fp`` within ``radius`` bits.

    ``distinct`` has one row per fingerprint: ``fp`` (long) and ``rep`` (long, not null).
    """
    parts = radius + 2
    found = []
    rows = distinct.select("fp", "rep", F.lit(0).alias("way"))
    ways = {0: list(range(BITS))}  # way -> the bits not yet in its key
    while True:
        nxt: dict[int, list[int]] = {}
        keyed = None
        for way, bits in ways.items():
            own = rows.where(F.col("way") == way)
            blocks = _blocks(bits, parts)
            choices = []
            for pair in combinations(range(parts), parts - radius):
                number = len(nxt)
                nxt[number] = [b for i in range(parts) if i not in pair for b in blocks[i]]
                choices.append(number)
            spread = own.select("fp", "rep", F.explode(F.array(*[F.lit(c) for c in choices])).alias("way"))
            keyed = spread if keyed is None else keyed.unionByName(spread)
        used = F.lit(0).cast("long")
        for number, rest in nxt.items():
            used = F.when(F.col("way") == number, F.lit(_mask([b for b in range(BITS) if b not in rest]))).otherwise(used)
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(used))
        keyed = materialize(keyed, "simhash-keys")
        counts = keyed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        exhausted = max(len(r) for r in nxt.values()) <= 2 * parts
        counts = materialize(counts, "simhash-buckets")
        hot = 0 if exhausted else counts.where(F.col("n") > bucket_limit).count()
        small = counts if exhausted else counts.where(F.col("n") <= bucket_limit)
        found.append(_bucket_links(keyed.join(small.select("way", "key"), ["way", "key"], "left_semi"), ["way", "key"], radius))
        if not hot:
            break
        rows = keyed.join(counts.where(F.col("n") > bucket_limit).select("way", "key"), ["way", "key"], "left_semi").drop("key")
        ways = nxt
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def link_components(fingerprints: DataFrame, radius: int, id_col: str = "doc_id", fp_col: str = "fp",
                    bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``fingerprints`` with ``component_id``: the smallest id reachable over links, null in a component without ids.

    The nodes that links join are the fingerprints themselves, so rows without an id take part like
    any others, whatever numbers the ids use up.
    """
    given = fingerprints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(F.col(id_col).cast("long")).alias("least"))
    distinct = materialize(given, "simhash-distinct")
    linked = components(near_links(distinct.select("fp", F.col("fp").alias("rep")), radius, bucket_limit))
    classes = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    names = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "class").select(F.col("fp").alias(fp_col), "component_id")
    return fingerprints.drop("component_id").join(named, fp_col)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``id_col, fp, component_id`` of every row (fingerprint as a signed long)."""
    narrow = materialize(with_fingerprints(docs.select(id_col, text_col), shingle, text_col), "simhash")
    return link_components(narrow, radius, id_col, "fp", bucket_limit).select(id_col, "fp", "component_id")


def hex_fingerprint(fp):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
