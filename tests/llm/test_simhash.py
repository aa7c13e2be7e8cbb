"""SimHash groups against brute force."""

from __future__ import annotations

import numpy as np
import xxhash

from voltframe.llm import simhash
from voltframe.llm.components import components, forest

from ..conftest import SF001
from .common import WORD, clashing, frame, groups


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    values = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    out = []
    for own in groups(len(rows), near):
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        out += [(rows[i][0], f"{fps[i]:016x}", least) for i in own]
    return sorted(out, key=str)


def result(df, **kw):
    found = simhash.near_duplicates(df, **kw).select("doc_id", simhash.hex_fingerprint("fp").alias("f"), "component_id")
    return sorted(map(tuple, found.collect()), key=str)


def test_edge_rows(spark):
    df = clashing(frame(spark), ["fp", "component_id", "rep", "way"])
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert result(df.limit(0)) == []


def test_documents_and_hot_buckets(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert result(docs) == want
    assert result(docs, bucket_limit=2) == want


def test_dense_fingerprints_over_all_levels(spark):
    rng = np.random.default_rng(0)
    flips = [[1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))] for _ in range(900)]
    bases = [int(b) for b in rng.integers(0, 1 << 63, 6)]
    fps = sorted({bases[i % 6] ^ sum(set(f)) for i, f in enumerate(flips)})
    all_ = np.array(fps, dtype=np.uint64)
    label = forest(len(fps), *np.where(np.bitwise_count(all_[:, None] ^ all_[None, :]) <= 2))
    df = spark.createDataFrame([(i + 7, int(f)) for i, f in enumerate(all_.view(np.int64))], "doc_id long, fp long")
    for limit in (4096, 5):
        got = dict(simhash.link_components(df, 2, bucket_limit=limit).select("doc_id", "component_id").collect())
        assert got == {i + 7: int(x) + 7 for i, x in enumerate(label)}


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (203, 201), (201, 202), (201, 203), (203, 201)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {202: 201, 203: 201}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ids_next_to_the_largest_long_and_rows_without_one(spark):
    """Rows without an id need no number of their own; two of their fingerprints are joined only if they link."""
    top = 2**63 - 33
    rows = [(top, 5), (None, 5), (None, 7), (None, 2**62 + 12345), (None, 12346 - 2**62), (3, -1), (None, -2)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.link_components(prints, 2).collect()}
    assert got == {(top, 5): top, (None, 5): top, (None, 7): top, (None, 2**62 + 12345): None, (None, 12346 - 2**62): None, (3, -1): 3, (None, -2): 3}
