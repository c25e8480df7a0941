r"""SimHash near-dedup by a generalised pigeonhole.

Fingerprints. Lower-cased (A-Z) words ``[^\x20\x09-\x0D]+`` in shingles, repeats included (but for the wide search); a bit is 1 if it is set in
over half of the shingles' hashes. One word of bits uses XXH64 (seed 42) itself; more words are mixed from it.

Search. Bits are grouped into partitions, correlated bits together, from the bits' joint counts over all fingerprints.
Fingerprints within ``tau`` bits differ by at most t_i bits in some partition i if the sum of (t_i + 1) is tau + 1; a
dynamic programme picks the t_i (-1: a partition isn't probed) and the number of partitions by the candidates and rows
they are estimated to cost. Each fingerprint is filed under its value in each partition, probes all values within t_i,
and candidates are verified on all bits.

Sizes. Equal fingerprints are one node. Signatures are sorted by value and run through; members of values with at most
SMALL of them are compared on the way; larger ones are cut into blocks, each pair of blocks is compared in a task of
bounded memory, and only a spanning forest of its links comes back. So no candidate is dropped and no group gives all
its pairs. Values of one component only are passed over. The wide search goes in three rounds, each with the components
that the rounds before have found.

Cases: null and empty texts, or texts without words, have fingerprint zero and are linked like any other; fewer words
than a shingle: the whole sequence is one; repeated rows and ids keep all rows; a null id joins in but names no
component unless alone (then null); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import reduce
from itertools import combinations
from math import comb, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, drop_written, lean, small_batches, written
from .components import components

SMALL, BLOCK, BLOCK_SHINGLES, SUMS, BROADCAST, BROADCAST_NODES, CONSTANT = 16, 2048, 1 << 19, 16, 100_000, 500_000, 1000
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str | None, size: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(line, 42)]
    return [h(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())]


def _bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits of each group of hashes; starts: where each group begins, none empty."""
    sizes = np.diff(np.append(starts, len(h)))
    parts = -(-sizes // 255)
    cuts = np.repeat(starts, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)  # eight counters of a byte in each
    some = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).astype(np.int32)
    return np.add.reduceat(some, np.cumsum(parts) - parts, axis=0)


def prefix_of(hashes: list[int], similarity: float, most: int) -> list[int]:
    """The least hashes of a set of at most ``most``, one more than can be missing: sets of that Jaccard similarity share one of these. Of larger sets none; of an empty one the number 0, which stands for it."""
    k = len(hashes)
    return [] if k > most else sorted(hashes)[: k - int(np.ceil(similarity * k - 1e-9)) + 1] if k else [0]


def fingerprints_of(texts: list[str | None], size: int, words: int, distinct: bool = False, prefixes: list | None = None, similarity: float = 0.8) -> np.ndarray:
    """(texts, words) unsigned 64-bit. distinct: each shingle of a text counts once. prefixes: gets the number and prefix_of() each text's shingles."""
    out = np.zeros((len(texts), words), np.uint64)
    most = max(20_000, 400_000 // words)
    at, hashes, ids, starts, n = 0, [], [], [], 0
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def flush():
        h, s = np.concatenate(hashes), np.array(starts)
        size_of = np.diff(np.append(s, len(h)))[:, None]
        for k in range(words):
            with np.errstate(over="ignore"):
                x = h
                if words > 1:
                    x = h + _GOLD * np.uint64(k + 1)
                    x = (x ^ (x >> np.uint64(30))) * _M1
                    x = (x ^ (x >> np.uint64(27))) * _M2
                    x = x ^ (x >> np.uint64(31))
            out[ids, k] = ((2 * _bit_counts(x, s) > size_of).astype(np.uint64) * weights).sum(1, dtype=np.uint64)

    while at < len(texts):
        hs = shingle_hashes(texts[at], size)
        if distinct:
            hs = list(set(hs))
        if prefixes is not None:
            prefixes.append((len(hs), prefix_of(hs, similarity, SHORT)))
        if hs:
            ids.append(at)
            starts.append(n)
            hashes.append(np.array(hs, np.uint64))
            n += len(hs)
        at += 1
        if n and (n >= most or at == len(texts)):
            flush()
            hashes, ids, starts, n = [], [], [], 0
    return out


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text", key: bool = False, distinct: bool = False, similarity: float | None = None) -> DataFrame:
    """(id, f0 .. f{words-1}): longs that hold the unsigned words; with ``key`` also the text's XXH64, with ``similarity`` also the prefix of its shingles for that (prefix_of, as longs) and their number."""
    kind, more = docs.schema[id_col].dataType, ["key"] * key
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        for b in batches:
            found = [] if similarity else None
            f = fingerprints_of(b.column(1).to_pylist(), size, words, distinct, found, similarity or 0).view(np.int64)
            extra = []
            if similarity:
                extra = [pa.array([np.array(p, np.uint64).view(np.int64) for _, p in found], pa.list_(pa.int64())), pa.array([k for k, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, k]) for k in range(words)), *b.columns[2:], *extra], ["id", *names, *more, *["prefix", "shingles"][: len(extra)]])

    small_batches(docs.sparkSession)
    cols = [F.col(id_col).alias("id"), F.col(text_col), *(F.xxhash64(text_col).alias(k) for k in more)]
    fields = [T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in [*names, *more])]
    fields += [T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("shingles", T.LongType())] if similarity else []
    return docs.select(*cols).mapInArrow(lean(run), T.StructType(fields))


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, s, k): the sorted distinct shingle hashes of the nodes' texts, 32 bits of each, and their number. nodes: (node, least, key), the id and text hash of a row of docs; sent to all tasks if they are at most BROADCAST_NODES, so that no other text moves.

    Of texts of k and l shingles k * l / 2**32 hashes are expected to be equal by chance: less than a thousandth of the
    smaller set below four million shingles.
    """

    def run(batches):
        for b in batches:
            sets = [np.unique((np.array(shingle_hashes(t.as_py(), size), np.uint64) >> np.uint64(32)).astype(np.uint32)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], ["node", "s", "k"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("key"))
    n = nodes.count()
    met = rows.join(F.broadcast(nodes) if n <= BROADCAST_NODES else nodes, "key").where(F.col("_id").eqNullSafe(F.col("least"))).select("node", "_text")
    made = written(met.mapInArrow(lean(run), "node bigint, s binary, k bigint"), "shingle-sets")
    return made if made.count() <= n else made.dropDuplicates(["node"])  # repeated rows


def _alike(similarity: float, shared, k, other):
    """Whether sets of k and other elements with so many in common have that Jaccard similarity; two empty sets have."""
    return shared + 1e-9 >= similarity * (k + other - shared)


# --- the plan of partitions and thresholds


def bit_statistics(nodes: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """Number of nodes and the joint counts of bits, over all nodes: (64 words)^2 numbers whatever the input."""
    names, width = [f"f{k}" for k in range(words)], 64 * words
    upper = np.triu_indices(width)  # the counts are the same on both sides of the diagonal

    def row(n: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["n", "total"])

    def run(batches):
        total, n = np.zeros((width, width)), 0
        for b in batches:
            f = np.stack([b.column(k).to_numpy() for k in range(words)], 1)
            for i in range(0, len(f), 4096):
                bits = np.unpackbits(np.ascontiguousarray(f[i : i + 4096]).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(f)
        if n:
            yield row(n, total[upper].astype(np.int64))

    def add(batches):
        total, n = np.zeros(len(upper[0]), np.int64), 0
        for b in batches:
            for m, t in zip(b.column(0).to_pylist(), b.column(1)):
                n += m
                total += np.frombuffer(zlib.decompress(t.as_py()), np.int64)
        if n:
            yield row(n, total)

    schema = "n bigint, total binary"
    sums, left = nodes.select(*names).mapInArrow(lean(run), schema), (nodes.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    while left > 1:  # each part sums up by itself, then so many sums at a time
        left = -(-left // SUMS)
        sums = sums.repartition(left).mapInArrow(add, schema)
    found = sums.collect()  # one row
    joint = np.zeros((width, width), np.int64)
    joint[upper] = np.frombuffer(zlib.decompress(found[0].total), np.int64) if found else 0
    return sum(r.n for r in found), np.maximum(joint, joint.T)


def group_bits(joint: np.ndarray, n: int, parts: int, width: int | None = None) -> list[list[int]]:
    """Partitions of even size; each takes the free bits most correlated with those it has."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(len(p))), []
    sizes = [width] * parts if width else [len(p) // parts + (i < len(p) % parts) for i in range(parts)]
    for size in sizes:
        rest = np.array(free)
        mine = [int(rest[np.argmax(corr[np.ix_(rest, rest)].sum(1))])]
        free.remove(mine[0])
        while len(mine) < size:
            rest = np.array(free)
            best = int(rest[np.argmax(corr[np.ix_(rest, mine)].sum(1))])
            mine.append(best)
            free.remove(best)
        out.append(sorted(mine))
    return out


def within(bits: list[int], joint: np.ndarray, n: int, t: int) -> float:
    """Estimated share of pairs of nodes that differ by at most t of these bits: a binomial of as many bits as the correlations leave."""
    if t < 0:
        return 0.0
    p = np.diag(joint)[bits] / max(n, 1)
    m = 1 - 2 * p
    s = 1 - 2 * (p[:, None] + p[None, :] - 2 * joint[np.ix_(bits, bits)] / max(n, 1))
    cov = (s**2 - np.outer(m**2, m**2)) / 4
    w = len(bits)
    mean = float(((1 - m**2) / 2).mean())
    var = max(float(cov.sum()), 1e-6)
    eff = max(1.0, min(float(w), w * w * mean * (1 - mean) / var)) if mean > 0 else 1.0
    d = min(max(mean, 1e-6), 1 - 1e-6)
    k = t * eff / w
    whole = int(k)
    tail = sum(comb(max(1, round(eff)), j) * d**j * (1 - d) ** (eff - j) for j in range(whole + 1))
    return min(1.0, tail)


def allocate(parts: list[list[int]], joint: np.ndarray, n: int, tau: int, pair_cost: float = 1.0, row_cost: float = 20.0) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost with the sum of (t + 1) equal to tau + 1, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, min(2, tau - used) + 1):
                rows = 0 if t < 0 else 1 + (t > 0) * sum(comb(len(bits), j) for j in range(t + 1))
                c = cost + pair_cost * n * n / 2 * within(bits, joint, n, t) + row_cost * n * rows
                if used + t + 1 <= tau + 1 and (used + t + 1 not in new or c < new[used + t + 1][0]):
                    new[used + t + 1] = (c, [*ts, t])
        best = new
    return best.get(tau + 1, (float("inf"), []))


def plan(joint: np.ndarray, n: int, tau: int, parts_tried=(2, 3, 4, 5, 6)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    tried = []
    for m in parts_tried:
        parts = group_bits(joint, n, m)
        cost, ts = allocate(parts, joint, n, tau)
        tried.append((cost, m, [(b, t) for b, t in zip(parts, ts) if t >= 0]))
    return min(tried, key=lambda x: x[:2])[2]


# --- candidates and links


def _mask(bits: list[int], words: int) -> list[int]:
    out = [0] * words
    for b in bits:
        out[b // 64] |= 1 << (b % 64)
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def _value(fs: list, masks: list[int], flip: list[int]):
    """A long that stands for the bits of a partition: themselves for one word, else a hash of them."""
    used = [(f, m, x) for f, m, x in zip(fs, masks, flip) if m]
    cols = [F.col(f).bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(x)) if x else F.col(f).bitwiseAND(F.lit(m)) for f, m, x in used]
    return cols[0] if len(cols) == 1 else F.xxhash64(*cols)


def _close(quick: int, n_words: int):
    """Rows (key, node, comp, data, quick words ..) by key: the (a, b) of different components within ``quick`` bits in groups of at most SMALL rows, and the keys of larger ones that have different components."""

    def of_groups(x: list[np.ndarray]) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], np.diff(x[0]) != 0])) if len(x[0]) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(x[0])))
        mixed = np.minimum.reduceat(x[2], begin) != np.maximum.reduceat(x[2], begin) if len(begin) else size > 0
        large = x[0][begin[(size > SMALL) & mixed]]
        node, comp, data, *q = (c[np.repeat(size <= SMALL, size)] for c in x[1:])
        size = size[size <= SMALL]
        end, i, d, a, b = np.repeat(np.cumsum(size), size), np.arange(len(node)), 1, [large[:0]], [large[:0]]
        while len(i := i[i + d < end[i]]):
            j = i + d
            near = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int32) for w in q) <= quick
            near &= (comp[i] != comp[j]) & (data[i] | data[j])
            a.append(np.minimum(node[i[near]], node[j[near]]))
            b.append(np.maximum(node[i[near]], node[j[near]]))
            d += 1
        a, b = np.concatenate(a), np.concatenate(b)
        none = pa.nulls(len(large), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), none]), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(large)])], ["a", "b", "key"])

    def run(batches):
        held = None
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = [np.concatenate(y) for y in zip(held, x)] if held else x
            if not len(x[0]):
                continue
            last = int(np.searchsorted(x[0], x[0][-1]))  # this group may go on; SMALL + 1 rows tell that it is large, two its components
            yield of_groups([c[:last] for c in x])
            ends = [last + int(f(x[2][last:])) for f in (np.argmin, np.argmax)]
            some = np.unique([*ends, *range(last, min(len(x[0]), last + SMALL + 1))])
            held = [c[some] for c in x]
        if held:
            yield of_groups(held)

    return run


def _only(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows with (or without) these keys; keys are sent to all tasks only if they are at most BROADCAST."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, keys.columns, how)


def _split(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows without and with these keys, a long each; at most CONSTANT of them are a constant of the plan, which takes no join."""
    name = keys.columns[0]
    some = [r[0] for r in keys.limit(CONSTANT + 1).collect()]
    if len(some) > CONSTANT:
        return _only(rows, keys, "left_anti"), _only(rows, keys, "left_semi")
    return rows.where(~F.col(name).isin(some)), rows.where(F.col(name).isin(some))


def block_numbers(rows: DataFrame) -> DataFrame:
    """(key, top, apart, m) of the values of rows (key, comp, data, shingles) that have different components and data. m is the number of blocks; the first ``apart`` of them hold the value's largest component ``top``, none if that fits into one block."""
    blocks = lambda n, k: F.greatest(F.ceil(n / BLOCK), F.ceil(k / BLOCK_SHINGLES)).cast("int")
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("shingles").alias("k"), F.bool_or("data").alias("data"))
    each = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.struct("n", "k", "comp")).alias("top"), F.count("*").alias("comps"), F.bool_or("data").alias("data")).where("comps > 1 AND data")
    own = blocks(F.col("top.n"), F.col("top.k"))
    each = each.withColumn("apart", F.when(own > 1, own).otherwise(0))
    rest = F.when(F.col("apart") > 0, blocks(F.col("n") - F.col("top.n"), F.col("k") - F.col("top.k"))).otherwise(blocks(F.col("n"), F.col("k")))
    return each.select("key", F.col("top.comp").alias("top"), "apart", (F.col("apart") + rest).alias("m"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows with their block ``mine`` and a row for each other block that it meets, ``other``: all blocks, but those of one component not each other."""
    of_top = (F.col("comp") == F.col("top")) & (F.col("apart") > 0)
    place = F.xxhash64("node")
    mine = F.when(of_top, F.pmod(place, "apart")).otherwise(F.col("apart") + F.pmod(place, F.col("m") - F.col("apart"))).cast("int")
    return rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.when(of_top, F.col("apart")).otherwise(0), F.col("m") - 1)))


def links(nodes: DataFrame, probes: list[tuple[list[int], int]], words: int, most: int, quick_words: int = 2, quick_most: int | None = None, sets_of=None, similarity: float = 0.0) -> DataFrame:
    """(a, b): links that connect all nodes within ``most`` bits that meet in a probe. nodes: (node long, f0 ..[, comp]).

    prefix: further values of a node, an array; few: whether it has these only, and no probes; shingles: their number. comp: what is connected already; only links between different ones are looked for. With sets_of, a function from
    (node) to shingle_sets(), only nodes whose sets have that Jaccard similarity are linked.

    Signatures are made and written once, then shuffled by value. Values of hot hash buckets (more than BLOCK rows, counted
    with a combine before the shuffle) stay out of that and are dealt in blocks, as are the other values of more than SMALL
    rows. Where a value's largest component takes more than one block its blocks meet those of the other rows only.
    """
    fs = [f"f{k}" for k in range(words)]
    q = fs[: min(words, quick_words)]
    quick_most = most if len(q) == words else quick_most
    prefix = [F.transform("prefix", lambda x: F.struct(F.xxhash64(F.lit("shingle"), x).alias("key"), F.lit(True).alias("data")))] if "prefix" in nodes.columns else []
    few = F.col("few") if "few" in nodes.columns else F.lit(False)
    nodes = nodes.select("node", *fs, F.col("comp") if "comp" in nodes.columns else F.col("node").alias("comp"), F.col("shingles") if "shingles" in nodes.columns else F.lit(0).alias("shingles"), *[x.alias("own") for x in prefix], few.alias("few"))
    keys = []
    for i, (bits, t) in enumerate(probes):
        m = _mask(bits, words)
        for k in range(t + 1):
            for e in combinations(bits, k):
                keys.append(F.struct(F.xxhash64(F.lit(i), _value(fs, m, _mask(list(e), words))).alias("key"), F.lit(not e).alias("data")))
    probed = F.when(F.col("few"), F.array()).otherwise(F.array(*keys))
    every = F.concat(probed, F.coalesce("own", F.array())) if prefix else probed
    sig = nodes.select("node", "comp", "shingles", *q, every.alias("every")).select("node", "comp", "shingles", *q, F.explode("every").alias("k"))
    sig = written(sig.select("k.key", "node", "comp", "k.data", "shingles", *q), "signatures")  # they are gone through several times
    nodes = nodes.select("node", *fs)

    buckets = max(1, nodes.count() * len(keys) // (BLOCK // 4))
    bucket = F.pmod("key", F.lit(buckets))
    hot = written(sig.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket"), "hot-buckets")
    cold, big = _split(sig.withColumn("bucket", bucket), hot)
    cold = cold.select("key", "node", "comp", "data", *q)
    close = written(cold.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_close(quick_most, len(q))), "a bigint, b bigint, key bigint"), "close")
    met = close.where("a IS NOT NULL").select("a", "b").distinct()

    # the values dealt in blocks, but for those of one component
    big = big.unionByName(_only(sig, close.where("key IS NOT NULL").select("key").distinct(), "left_semi").withColumn("bucket", bucket))
    large = written(big.select("key", "node", "comp", "data", "shingles"), "large-rows")
    drop_written(sig)
    values = written(block_numbers(large), "large-values")
    big = written(large.select("key", "node", "comp").join(values, "key"), "mixed-rows")
    drop_written(large)

    if len(q) < words:
        for side in ("a", "b"):
            met = met.join(nodes.select(F.col("node").alias(side), *(F.col(x).alias(f"{side}_{x}") for x in fs)), side)
        met = met.where(reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in fs]) <= most).select("a", "b")

    exact = sets_of is not None
    if exact:
        met = written(met, "met")
        sets = sets_of(written(met.select(F.col("a").alias("node")).union(met.select("b")).union(big.select("node")).distinct(), "wanted"))
        for side in ("a", "b"):
            met = met.join(sets.select(F.col("node").alias(side), F.col("s").alias(f"s_{side}")), side)

        def same(batches):
            for b in batches:
                x, y = ([np.frombuffer(v.as_py(), np.uint32) for v in b.column(i)] for i in (2, 3))
                ok = pa.array([bool(_alike(similarity, len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))) for p, q in zip(x, y)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

        met = met.select("a", "b", "s_a", "s_b").mapInArrow(lean(same), "a bigint, b bigint")

        nodes = nodes.join(sets.select("node", "s"), "node")

    held = [*fs, "s"] if exact else fs
    big = in_blocks(big.join(nodes, "node"))
    big = big.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", "comp", "mine", *held)

    def block(group: pa.Table) -> pa.Table:
        node, mine, comp = (group.column(c).to_numpy() for c in ("node", "mine", "comp"))
        f = np.stack([group.column(x).to_numpy() for x in fs], 1).view(np.uint64)
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        inside = x == y
        left, first = np.unique(node, return_index=True)
        f, mine, comp = f[first], mine[first], comp[first]
        if exact:
            own = [np.frombuffer(v.as_py(), np.uint32) for v in group.column("s").take(pa.array(first))]
            k = np.array([len(v) for v in own])
            begin = np.cumsum(k) - k
            codes = np.unique(np.concatenate(own), return_inverse=True)[1]
            mark = np.zeros(len(codes), bool)

        def alike(i: int, near: np.ndarray) -> np.ndarray:
            """Those of near whose sets are like that of i."""
            mine_codes = codes[begin[i] : begin[i] + k[i]]
            mark[mine_codes] = True
            owner = np.repeat(np.arange(len(near)), k[near])
            at = np.arange(len(owner)) + np.repeat(begin[near] - (np.cumsum(k[near]) - k[near]), k[near])
            shared = np.bincount(owner[mark[codes[at]]], minlength=len(near))
            mark[mine_codes] = False
            return near[_alike(similarity, shared, k[i], k[near])]

        todo = np.ones(len(left), bool)
        out_a, out_b = [], []
        for s in range(len(left)):
            if not todo[s]:
                continue
            todo[s] = False
            front = [s]
            while front:
                i = front.pop()
                joined = np.flatnonzero(todo & (comp == comp[i]))  # without a new link
                rest = np.flatnonzero((todo if inside else todo & (mine != mine[i])) & (comp != comp[i]))
                near = rest[np.bitwise_count(f[rest] ^ f[i]).sum(1, dtype=np.int32) <= most]
                if exact and len(near):
                    near = alike(i, near)
                todo[near] = todo[joined] = False
                front.extend(near.tolist())
                front.extend(joined.tolist())
                out_a.extend([left[i]] * len(near))
                out_b.extend(left[near].tolist())
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return met.unionByName(big.groupBy("key", "x", "y").applyInArrow(block, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, size: int = 3, tau: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, component_id): components of links between fingerprints of one word within tau bits."""
    prints = written(fingerprints(docs, size, 1, id_col, text_col), "fingerprints")
    return _classes(prints, 1, lambda nodes: links(nodes, plan(*reversed(bit_statistics(nodes, 1)), tau), 1, tau)).withColumnRenamed("id", id_col)


WIDE, RECALL = 10, 0.99
SHORT = 40  # shingles of the texts that also meet by a prefix of their sets


def meetings(share: float, width: int, t: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For 0 .. most differing bits: their chance at this expected share, and the chance that a random group of width bits has at most t of them."""
    bits = 64 * WIDE
    log = np.array([lgamma(i + 1) for i in range(bits + 1)])
    d = np.arange(min(most, bits - width) + 1)
    chance = np.exp(log[bits] - log[d] - log[bits - d] + d * np.log(share) + (bits - d) * np.log1p(-share))
    meet = np.zeros(len(d))
    for j in range(t + 1):
        x, rest = d[j:], bits - d[j:] - width + j
        meet[j:] += np.exp(log[x] - log[j] - log[x - j] + log[bits - x] - log[width - j] - log[rest] - log[bits] + log[width] + log[bits - width])
    return chance, np.minimum(meet, 1 - 1e-12)


def recall_wide(share: float, width: int, t: int, parts: int, most: int) -> float:
    """The chance that two fingerprints with this expected share of differing bits meet in one of parts random groups of width bits with threshold t, and differ by at most ``most`` bits."""
    chance, meet = meetings(share, width, t, most)
    return float((chance * -np.expm1(parts * np.log1p(-meet))).sum())


def plan_wide(joint: np.ndarray, n: int, share: float, most: int, target: float = RECALL, pair_cost: float = 1.0, row_cost: float = 20.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe: whatever n is, as many as find ``target`` of the pairs at that share.

    Width and threshold are those of least estimated cost, in the measure of allocate(), with at most eight nodes a value
    at random. More partitions than the bits make in one dealing are filled from further dealings of the shuffled bits.
    """
    bits, tried = 64 * WIDE, []
    least = max(8, int(np.ceil(np.log2(max(n, 2)))) - 3)
    for t in (0, 1):
        for width in range(least, least + 16):
            parts = 1
            while recall_wide(share, width, t, parts, most) < target and parts < 1 << 14:
                parts *= 2
            low = parts // 2
            while parts - low > 1:
                mid = (low + parts) // 2
                low, parts = (low, mid) if recall_wide(share, width, t, mid, most) >= target else (mid, parts)
            chance = sum(comb(width, j) for j in range(t + 1)) / 2.0**width
            tried.append((parts * (pair_cost * n / 2 * chance + row_cost * (1 + t * (1 + width))), width, t, parts))
    _, width, t, parts = min(tried)
    out, rng = group_bits(joint, n, min(parts, bits // width), width), np.random.default_rng(42)
    while len(out) < parts:
        mixed = rng.permutation(bits).tolist()
        out += [sorted(mixed[i * width : (i + 1) * width]) for i in range(bits // width)]
    return [(b, t) for b in out[:parts]]


# a text of four shingles and the same with a fifth: of all sizes, the largest share of bits by which sets of similarity 0.8 differ
SHORT_SHARE = 3 / 16


def near_duplicates_wide(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): components of texts whose shingle sets have that Jaccard similarity or more.

    A Jaccard similarity j means a cosine of about 2j/(1+j), and so an expected share acos(cosine)/pi of differing bits.
    plan_wide() takes so many partitions that RECALL of the pairs of just that similarity meet in one, and more of those
    above it, at any number of texts. That holds for texts of many shingles; of few, bits differ more often, so texts of at
    most SHORT shingles meet by the prefixes of their sets, which all pairs of that similarity share (and by bits only where
    their partners may be longer). Bits only choose
    candidates, by a cut 3.5 deviations above the expected number; links are decided by the sets of the texts' shingles.
    """
    prints = written(fingerprints(docs, size, WIDE, id_col, text_col, key=True, distinct=True, similarity=similarity), "fingerprints")
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    far = max(angle, SHORT_SHARE)
    most, quick = (int(bits * far + 3.5 * (bits * far * (1 - far)) ** 0.5) for bits in (64 * WIDE, 128))

    def found(nodes: DataFrame) -> DataFrame:
        n, joint = bit_statistics(nodes, WIDE)
        named = nodes.select("node", "least", "key")
        # all texts that are like one of so few shingles have prefixes too, so it needs no bits to meet them
        nodes = nodes.withColumn("few", F.col("shingles") <= int(similarity * SHORT + 1e-9))
        probes = plan_wide(joint, n, angle, most)

        def of(nodes: DataFrame, some: list) -> DataFrame:
            return links(nodes, some, WIDE, most, 2, quick, lambda wanted: shingle_sets(docs, written(named.join(wanted, "node"), "wanted-nodes"), size, id_col, text_col), similarity)

        # the first partitions connect most copies; those that follow look only for links between what isn't connected
        cuts = [0, max(1, len(probes) // 10), max(2, 4 * len(probes) // 10), len(probes)]
        rounds = [probes[x:y] for x, y in zip(cuts, cuts[1:]) if x < y]
        now, all_links = nodes, None
        for i, some in enumerate(rounds):
            if all_links is not None:
                met = nodes.join(components(all_links), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
                now = written(met, "nodes-met")
            # prefixes once, when large groups of copies are connected already
            new = written(of(now if i == min(1, len(rounds) - 1) else now.drop("prefix"), some), "links-found")
            all_links = new if all_links is None else all_links.unionByName(new)
        return all_links

    return _classes(prints, WIDE, found).select(F.col("id").alias(id_col), "component_id")


def _classes(prints: DataFrame, words: int, find) -> DataFrame:
    """prints with component_id, the least id of the component. Equal fingerprints are one node, named by a hash-free number: its least id, or for null ids its place among the negatives."""
    fs = [f"f{k}" for k in range(words)]
    keyed = "key" in prints.columns
    first = F.struct(F.col("id").isNull(), F.col("id").cast("long"), "key") if keyed else None
    nodes = prints.groupBy(*fs).agg(F.min("id").cast("long").alias("least"), *([F.min(first)["key"].alias("key")] if keyed else []), *([F.min("prefix").alias("prefix"), F.max("shingles").alias("shingles")] if "prefix" in prints.columns else []))
    # without any id the fingerprint itself names the node, far from ids in use
    nodes = written(nodes.withColumn("node", F.coalesce("least", F.xxhash64(*fs))), "nodes")
    if nodes.isEmpty():
        return prints.withColumn("component_id", F.col("id").cast("long"))
    with Scratch() as scratch:
        roots = scratch.keep(components(find(nodes)))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(*fs, "component_id")
    return prints.join(named, fs)
