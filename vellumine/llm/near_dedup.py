"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

1. Equal texts are collapsed to one node each (its SHA-256).
2. A node's words (lower case, runs of letters and digits) give shingles of five words; a
   shorter text is one shingle.  Runs of nodes form chunks.  A chunk sends its distinct
   shingle hashes, sorted and delta-coded, to buckets of the hash space; a bucket counts in
   how many nodes of the whole corpus each hash occurs, and answers with the hashes that
   occur more than once.
3. The weight of a shingle is tf * idf ** IDF_POWER, idf = ln((1 + N) / (1 + df)) + 1.  Two
   nodes can only share shingles with df > 1, so a node whose share of such weight is below
   the threshold has no partner; leaving it out loses nothing.
4. The others get an improved consistent weighted sample (Ioffe's scheme: r and c from
   Gamma(2, 1), beta uniform, all derived from the shingle's hash) of BANDS * ROWS values,
   which are banded.  Nodes with an equal band share a bucket.
5. In a bucket a leader is compared with all members.  Candidates whose samples agree in
   less than ``MIN_AGREEMENT`` of the places (four standard errors below what the threshold
   gives) are left out; the others are verified by exact weighted Jaccard similarity.  Links
   are joined to classes.  A bucket all of whose members are in its leader's class is done.
6. In any other bucket every pair of members of different classes is compared: as rows in
   buckets of up to ``SMALL`` members, else in tiles.  The members outside the leader's class
   and those in it are dealt to blocks of about ``BLOCK``; a tile holds two blocks, one of
   them from outside, so a large bucket is spread over many tasks and its pairs never become
   rows.  A tile passes over pairs that share an earlier band (they meet there) and pairs
   whose classes it has already linked, so it returns fewer links than it has members.

The idf is damped because in a large group of near copies the common shingles have a high
document frequency, and with the plain idf a few edits would outweigh them.

Edge cases: a null text counts as empty; a text without a word has no shingle and is near to
equal texts only; a text of one to four words is one shingle; rows that repeat an identifier
are classed by their texts; a class has the smallest identifier of its members (nulls last);
an empty table gives an empty result; whole texts are read, whatever their length; columns
other than identifier and text are ignored by ``near_classes`` and passed on, whatever their
names, by ``keep_one``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, partitions, remove, ship, shared_root, small_or_shuffled
from .components import components

#: Words of a shingle, least similarity, bands and values in a band.
WORDS = 5
THRESHOLD = 0.8
BANDS = 26
ROWS = 5
#: Share of sample places in which a candidate pair agrees at least.
MIN_AGREEMENT = 0.66
#: Members of a bucket whose pairs of different classes are listed as rows, at most.
SMALL = 8
#: Members of a block of a larger bucket, about.
BLOCK = 256
#: Power of the inverse document frequency; 1 is plain TF-IDF, 0 counts shingles.
IDF_POWER = 0.1
#: Shingles after which a chunk is closed, and hashes that a bucket should hold at most.
CHUNK_SHINGLES = 1_000_000
BUCKET_HASHES = 4_000_000
#: Bits of a shingle's hash.
BITS = 48
#: Shingle-by-sample cells computed at once.
CELLS = 1 << 16
NO_ID = 2**63 - 1

WORD = re.compile(r"\w+")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    wide = np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(wide.reshape(-1))


def _expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending.astype(np.uint64), prepend=np.uint64(0))


def shingles(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and how often each occurs.

    known: hashes of words met before.
    """
    hashes = []
    for w in WORD.findall(text.lower()):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = np.array(hashes, np.uint64)
    size = min(WORDS, len(words))
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = _mix(rolled + words[k : len(words) - size + 1 + k])
    return np.unique(rolled >> np.uint64(64 - BITS), return_counts=True)


CHUNKS = (
    "chunk string, nodes array<binary>, sizes array<int>, places binary, times binary, "
    "slices array<struct<bucket: bigint, size: int, hashes: binary, counts: binary>>"
)
CHUNK_TYPES = pa.schema(
    [
        ("chunk", pa.string()),
        ("nodes", pa.list_(pa.binary())),
        ("sizes", pa.list_(pa.int32())),
        ("places", pa.binary()),
        ("times", pa.binary()),
        ("slices", pa.list_(pa.struct([("bucket", pa.int64()), ("size", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))),
    ]
)


def _chunks(bucket_bits: int):
    """Nodes with their texts to chunks."""

    def close(nodes: list[bytes], own: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        """The row of a chunk; ``own`` and ``times`` are emptied, and each array goes as soon as the next is made of it."""
        sizes, flat = [len(x) for x in own], np.concatenate(own)
        own.clear()
        each = _squeeze(np.concatenate(times))
        times.clear()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.diff(flat, prepend=~flat[:1]) != 0
        begin = np.flatnonzero(first)
        distinct, counts = flat[begin], np.diff(begin, append=len(flat))
        del flat, begin
        place = np.empty(len(order), np.uint32)
        place[order] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
        del order, first
        gaps = np.diff(place, prepend=np.uint32(0))
        start = np.cumsum([0, *sizes[:-1]])
        gaps[start] = place[start]  # each node counts from 0
        del place
        places = _squeeze(gaps)
        del gaps
        of = (distinct >> np.uint64(BITS - bucket_bits)).astype(np.int64)
        bounds = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        slices = [
            {
                "bucket": int(of[i]),
                "size": j - i,
                "hashes": _squeeze(_gaps(distinct[i:j] - (np.uint64(of[i]) << np.uint64(BITS - bucket_bits)))),
                "counts": _squeeze(counts[i:j]),
            }
            for i, j in zip(bounds, [*bounds[1:], len(distinct)], strict=True)
        ]
        row = {
            "chunk": uuid.uuid4().hex,
            "nodes": nodes,
            "sizes": sizes,
            "places": places,
            "times": each,
            "slices": slices,
        }
        return pa.RecordBatch.from_pylist([row], schema=CHUNK_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, own, times, total, known = [], [], [], 0, {}
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                hashes, each = shingles(text.as_py() or "", known)
                if not len(hashes):
                    continue
                nodes.append(node.as_py())
                own.append(hashes)
                times.append(each.astype(np.uint32))
                total += len(hashes)
                if total >= CHUNK_SHINGLES:
                    known = {}
                    yield close(nodes, own, times)
                    nodes, total = [], 0
                    give_back()
        known = {}
        if nodes:
            yield close(nodes, own, times)
        del nodes, own, times, known
        give_back()

    return run


ANSWERS = "chunk string, bucket bigint, size int, places binary, names binary, counts binary"
ANSWER_TYPES = pa.schema(
    [("chunk", pa.string()), ("bucket", pa.int64()), ("size", pa.int32()), ("places", pa.binary()), ("names", pa.binary()), ("counts", pa.binary())]
)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a bucket, for each chunk those of its hashes that are above 1."""

    def answer(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        hashes = [np.cumsum(_expand(r[3]), dtype=np.uint64) for r in rows]
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate([_expand(r[4]) for r in rows]).astype(float)).astype(np.int64)
        rank = np.cumsum(df > 1) - 1
        out, start = [], 0
        for (_, chunk, size, _, _), own in zip(rows, hashes, strict=True):
            mine = at[start : start + len(own)]
            start += len(own)
            places = np.flatnonzero(df[mine] > 1)
            out.append(
                {
                    "chunk": chunk,
                    "bucket": bucket,
                    "size": size,
                    "places": _squeeze(_gaps(places)),
                    "names": _squeeze(_gaps(rank[mine[places]])),
                    "counts": _squeeze(df[mine[places]]),
                }
            )
        return pa.RecordBatch.from_pylist(out, schema=ANSWER_TYPES)

    now, rows = None, []
    for batch in batches:  # rows come sorted by bucket
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[0] != now and rows:
                yield answer(now, rows)
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield answer(now, rows)
    del rows
    give_back()


def sample(names: np.ndarray, weights: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The improved consistent weighted sample of a weighted set: one value for each seed."""
    best = np.full(len(seeds), np.inf)
    value = np.zeros(len(seeds), np.uint64)
    every = np.arange(len(seeds))
    step = max(1, CELLS // len(seeds))
    low = np.uint64(0xFFFFFFFF)
    unit = 2.0**-32
    for first in range(0, len(names), step):
        ids = names[first : first + step]
        log_w = np.log(weights[first : first + step])[None, :]
        x = _mix(ids[None, :] ^ seeds[:, None])
        y, z = _mix(x + M1), _mix(x + M2)
        r = -np.log(((x >> np.uint64(32)) + 0.5) * unit * ((x & low) + 0.5) * unit)
        log_c = np.log(-np.log(((y >> np.uint64(32)) + 0.5) * unit * ((y & low) + 0.5) * unit))
        beta = (z >> np.uint64(32)) * unit
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        i = log_a.argmin(axis=1)
        least = log_a[every, i]
        better = least < best
        best[better] = least[better]
        value[better] = _mix(ids[i[better]] ^ _mix(t[every, i][better].astype(np.int64).view(np.uint64) + M2))
    return value


VECTORS = "node binary, total double, names binary, weights binary, bands array<bigint>, places binary"
VECTOR_TYPES = pa.schema(
    [("node", pa.binary()), ("total", pa.float64()), ("names", pa.binary()), ("weights", pa.binary()), ("bands", pa.list_(pa.int64())), ("places", pa.binary())]
)


def _vectors(count: int, threshold: float, bucket_bits: int, bands: int, rows: int, power: float):
    """Chunks with their answers to the weighted sets and bands of nodes that can have a partner."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * M1)

    def idf(df: np.ndarray) -> np.ndarray:
        return (np.log((1 + count) / (1 + df)) + 1) ** power

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, places, times, answers in zip(*(batch.column(i) for i in range(5)), strict=True):
                sizes = np.array(sizes.as_py(), np.int64)
                parts = sorted(answers.as_py(), key=lambda a: a["bucket"])
                start = np.cumsum([0, *(a["size"] for a in parts)])
                name = np.zeros(start[-1], np.uint64)
                df = np.ones(start[-1], np.int64)
                for a, s in zip(parts, start[:-1], strict=True):
                    at = np.cumsum(_expand(a["places"])).astype(np.int64) + s
                    name[at] = (np.uint64(a["bucket"]) << np.uint64(32)) + np.cumsum(_expand(a["names"]), dtype=np.uint64) + np.uint64(1)
                    df[at] = _expand(a["counts"])
                weight = idf(df)
                gaps, each = _expand(places.as_py()).astype(np.int64), _expand(times.as_py()).astype(float)
                out, begin = [], 0
                for node, size in zip(nodes.as_py(), sizes.tolist(), strict=True):
                    at = np.cumsum(gaps[begin : begin + size])
                    w = weight[at] * each[begin : begin + size]
                    begin += size
                    shared = df[at] > 1
                    total = w.sum()
                    if w[shared].sum() < (threshold - 1e-9) * total:
                        continue
                    # a shingle of this node alone can match none: any name of its own will do
                    names = name[at]
                    alone = np.flatnonzero(~shared)
                    names[alone] = _mix(np.uint64(xxhash.xxh3_64_intdigest(node)) + alone.astype(np.uint64)) | np.uint64(1 << 63)
                    values = sample(names, w, seeds).reshape(bands, rows)
                    band = np.full(bands, 7, np.uint64)
                    for k in range(rows):
                        band = _mix(band + values[:, k])
                    order = np.argsort(names[shared], kind="stable")
                    out.append(
                        {
                            "node": node,
                            "total": float(total),
                            "names": _squeeze(_gaps(names[shared][order])),
                            "weights": zstandard.ZstdCompressor(level=1).compress(w[shared][order].astype("<f8").tobytes()),
                            "bands": band.view(np.int64).tolist(),
                            "places": (values & np.uint64(0xFF)).astype(np.uint8).tobytes(),
                        }
                    )
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=VECTOR_TYPES)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=VECTOR_TYPES)
                out = name = df = weight = each = gaps = None
        give_back()

    return run


def _load(names: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_expand(names), dtype=np.uint64), np.frombuffer(zstandard.ZstdDecompressor().decompress(weights), "<f8")


def _jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], tx: float, ty: float) -> float:
    """Weighted Jaccard similarity of two sets with their totals."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    return float(both / (tx + ty - both)) if tx + ty > both else 1.0


def _similar(threshold: float):
    """Pairs with both weighted sets to the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, jaccard = [], [], []
            last, held = None, None
            for x, y, tx, ty, nx, wx, ny, wy in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if x != last:
                    last, held = x, _load(nx, wx)
                s = _jaccard(held, _load(ny, wy), tx, ty)
                if s >= threshold:
                    a.append(x)
                    b.append(y)
                    jaccard.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(jaccard, pa.float64())], names=["a", "b", "similarity"]
            )

    return run


def _agree(share: float):
    """Pairs with the low bytes of both samples to the pairs that agree in enough places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if not left:
                continue
            same = np.frombuffer(b"".join(left), np.uint8) == np.frombuffer(b"".join(right), np.uint8)
            kept = pa.array(same.reshape(len(left), -1).mean(axis=1) >= share)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def verify(pairs: DataFrame, vectors: DataFrame, threshold: float, home: str) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted Jaccard similarity reaches the threshold."""
    pairs = materialise(_both(pairs, vectors, ["places"]).mapInArrow(_agree(MIN_AGREEMENT), "a binary, b binary"), home)
    full = _both(pairs, vectors, ["total", "names", "weights"])
    return full.select("a", "b", "total_a", "total_b", "names_a", "weights_a", "names_b", "weights_b").mapInArrow(
        _similar(threshold), "a binary, b binary, similarity double"
    )


def _both(pairs: DataFrame, vectors: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of both nodes."""
    left = vectors.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = vectors.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select(
        "a", "b", *(f"{c}_{x}" for c in columns for x in "ab")
    )


TILE = ["band", "value", "i", "j"]
#: Tables of ``links`` that nothing reads once it has returned.
PARTS = ("crowded", "members", "pairs-1", "agreeing-1", "found-1", "components-1", "state", "open", "open-members", "pairs-2", "agreeing-2", "tiles", "found-2")


def _tiled(threshold: float, share: float):
    """Members dealt to tiles, sorted by tile, to links (a, b) between classes."""

    def compare(band: int, left: list[tuple], right: list[tuple], same: bool) -> list[tuple[bytes, bytes]]:
        if not left or not right:
            return []
        number: dict[bytes, int] = {}
        classes = [np.array([number.setdefault(r[6], len(number)) for r in rows]) for rows in (left, right)]
        bands = [np.array([r[7] for r in rows], np.int64)[:, :band] for rows in (left, right)]
        places = [np.frombuffer(b"".join(r[8] for r in rows), np.uint8).reshape(len(rows), -1) for rows in (left, right)]
        x, y, agreement = [], [], []
        for k in range(len(left)):
            first = k + 1 if same else 0
            agree = (places[1][first:] == places[0][k]).mean(axis=1)
            at = np.flatnonzero((agree >= share) & (classes[1][first:] != classes[0][k]))
            at = at[~(bands[1][first:][at] == bands[0][k]).any(axis=1)]
            x.append(np.full(len(at), k))
            y.append(at + first)
            agreement.append(agree[at])
        x, y, agreement = np.concatenate(x), np.concatenate(y), np.concatenate(agreement)
        parent = list(range(len(number)))

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found = []
        last, held = None, None
        # the likeliest first, as each link spares pairs; whole hundredths keep pairs of a member together
        for p in np.lexsort((y, x, -np.round(agreement, 2))).tolist():
            k, m = int(x[p]), int(y[p])
            u, v = root(int(classes[0][k])), root(int(classes[1][m]))
            if u == v:
                continue
            if k != last:
                last, held = k, _load(left[k][10], left[k][11])
            if _jaccard(held, _load(right[m][10], right[m][11]), left[k][9], right[m][9]) >= threshold:
                parent[max(u, v)] = min(u, v)
                found.append((left[k][6], right[m][6]))
        return found

    def links_of(tile: tuple, rows: list[tuple]) -> pa.RecordBatch:
        band, _, i, j = tile
        left = [r for r in rows if r[4] == i]
        found = compare(band, left, left if i == j else [r for r in rows if r[4] == j], i == j)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:  # rows come sorted by tile
            for row in zip(*(batch.column(i).to_pylist() for i in range(12)), strict=True):
                if row[:4] != now and rows:
                    yield links_of(now, rows)
                    rows = []
                now = row[:4]
                rows.append(row)
        if rows:
            yield links_of(now, rows)
        del rows
        give_back()

    return run


def _tiles(crowd: DataFrame) -> DataFrame:
    """Members (band, value, node, r, out, n, n_out) of crowded buckets with block and each tile (i, j)."""
    outer = F.ceil(F.col("n_out") / BLOCK).cast("int")
    inner = F.ceil((F.col("n") - F.col("n_out")) / BLOCK).cast("int")
    lot = F.xxhash64("node", "band")
    block = F.when(F.col("out"), F.pmod(lot, outer)).otherwise(outer + F.pmod(lot, inner)).cast("int")
    dealt = crowd.withColumns({"block": block, "outer": outer, "blocks": outer + inner})
    tile = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))
    )
    # blocks 0 to outer - 1 are outside the leader's class; two blocks inside it needn't meet
    tiles = dealt.withColumn("tile", F.explode(F.filter(tile, lambda x: x["i"] < F.col("outer"))))
    return tiles.select("band", "value", "tile.i", "tile.j", "block", "node", "r")


def links(vectors: DataFrame, home: str, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of all nodes with a partner."""
    spark = vectors.sparkSession
    members = vectors.select("node", F.posexplode("bands").alias("band", "value"))
    crowded = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1")
    crowded = materialise(crowded, f"{home}/crowded")
    members = materialise(members.join(crowded, ["band", "value"]), f"{home}/members")
    pairs = materialise(members.where("node <> a").select("a", F.col("node").alias("b")).distinct(), f"{home}/pairs-1")
    found = materialise(verify(pairs, vectors, threshold, f"{home}/agreeing-1"), f"{home}/found-1").select("a", "b")
    roots = materialise(components(found, f"{home}/components-1"), f"{home}/roots-1")
    lead = roots.select(F.col("node").alias("a"), F.col("root").alias("lead"))
    state = members.join(roots, "node", "left").join(lead, "a", "left")
    state = state.select("band", "value", "node", "n", F.coalesce("root", "node").alias("r"), F.coalesce("lead", "a").alias("lead"))
    state = materialise(state.select("band", "value", "node", "n", "r", (F.col("r") != F.col("lead")).alias("out")), f"{home}/state")
    # buckets with members outside their leader's class
    left = materialise(state.where("out").groupBy("band", "value").agg(F.count(F.lit(1)).alias("n_out")), f"{home}/open")
    left = materialise(state.join(left, ["band", "value"]), f"{home}/open-members")
    few = left.where(F.col("n") <= SMALL).select("band", "value", "node", "r")
    pairs = few.withColumnsRenamed({"node": "a", "r": "ra"}).join(few.withColumnsRenamed({"node": "b", "r": "rb"}), ["band", "value"])
    pairs = materialise(pairs.where("a < b and ra <> rb").select("a", "b").distinct(), f"{home}/pairs-2")
    found = verify(pairs, vectors, threshold, f"{home}/agreeing-2").select("a", "b")
    tiles = materialise(_tiles(left.where(F.col("n") > SMALL)), f"{home}/tiles")
    full = tiles.join(vectors.hint("merge"), "node").select(*TILE, "block", "node", "r", "bands", "places", "total", "names", "weights")
    full = full.repartition(partitions(spark), *TILE).sortWithinPartitions(*TILE)
    found = materialise(found.union(full.mapInArrow(_tiled(threshold, MIN_AGREEMENT), "a binary, b binary")), f"{home}/found-2")
    if found.isEmpty():
        return roots
    # links between classes, each named by its root
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    found = found.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = materialise(components(found, f"{home}/components-2"), f"{home}/joined")
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    return materialise(moved.union(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")), f"{home}/roots-2")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    idf_power: float = IDF_POWER,
) -> DataFrame:
    """doc_id, class_id, class_size, node (SHA-256 prefix of the text) and class of every row."""
    spark = docs.sparkSession
    ship(spark)
    home = shared_root(spark)
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("node", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    rows_of = materialise(keyed.select("doc_id", "node", F.length("text").alias("n")), f"{home}/rows")
    equal = rows_of.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"))
    stats = rows_of.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars")).first()
    hits = small_or_shuffled(materialise(equal.where("k > 1").drop("k"), f"{home}/equal"))
    nodes = keyed.select("node", "text").join(hits, "node", "left_anti").union(
        keyed.join(hits, "node").where(F.coalesce("doc_id", F.lit(NO_ID)) == F.col("first")).select("node", "text").dropDuplicates(["node"])
    )
    count = equal.count()
    hashes = (stats["chars"] or 0) // 6
    buckets = max(4 * partitions(spark), hashes // BUCKET_HASHES + 1)
    bits = max(1, (buckets - 1).bit_length())
    chunks = materialise(nodes.mapInArrow(_chunks(bits), CHUNKS), f"{home}/chunks", packed=True)
    asked = chunks.select("chunk", F.explode("slices").alias("s")).select("s.bucket", "chunk", "s.size", "s.hashes", "s.counts")
    answers = (
        asked.repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_count, ANSWERS)
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("bucket", "size", "places", "names", "counts")).alias("answers"))
    )
    joined = chunks.drop("slices").hint("merge").join(answers, "chunk").select("nodes", "sizes", "places", "times", "answers")
    vectors = materialise(joined.mapInArrow(_vectors(count, threshold, bits, bands, rows, idf_power), VECTORS), f"{home}/vectors", packed=True)
    remove(spark, f"{home}/chunks")
    roots = links(vectors, home, threshold)
    for part in ("vectors", *PARTS):
        remove(spark, f"{home}/{part}")
    classed = rows_of.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("class"))
    # written out, as a join under which an aggregate stands can't split a hot class
    classed = materialise(classed, f"{home}/classed")
    named = classed.groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), F.count(F.lit(1)).alias("class_size"))
    named = materialise(named, f"{home}/named")
    return classed.join(named, "class").select("doc_id", F.when(F.col("first") != NO_ID, F.col("first")).alias("class_id"), "class_size", "node", "class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest identifier.

    Rows that repeat both identifier and text of one that stays stay with it.
    """
    home = shared_root(docs.sparkSession)
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "node")
    classed = materialise(near_classes(docs, id_col, text_col, threshold).select(order.alias("row"), "class"), f"{home}/classes")
    best = classed.groupBy("class").agg(F.min("row").alias("best"))
    gone = classed.join(materialise(best, f"{home}/best"), "class").where("row <> best").select("row.id", "row.node").distinct()
    gone = small_or_shuffled(materialise(gone.withColumnsRenamed({"id": "__x_id", "node": "__x_node"}), f"{home}/gone"))
    keyed = docs.withColumns(
        {
            "__x_id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)),
            "__x_node": F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)), 1, 16),
        }
    )
    return keyed.join(gone, ["__x_id", "__x_node"], "left_anti").select(*docs.columns)
