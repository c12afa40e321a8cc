"""Near-duplicate texts by a hierarchical index of fingerprints in Gray order.

A fingerprint holds three bits of each of 84 min-hashes of a text's word shingles, so that its Hamming distance
follows the similarity of the shingle sets. The masked bit patterns at the top of the index are 28 segments of
three min-hashes; texts that agree on a segment form a group. Within a group the fingerprints are sorted by Gray
rank; every node of the tree keeps the bits all fingerprints below it agree on and that no node above has
settled, and a search drops a whole subtree once the differences added up on the way exceed the threshold.
Surviving pairs are compared exactly on their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import WORD, cut

#: Words of a shingle, least words of a text and least similarity, as TESTDATA.md defines problem 4.
SHINGLE, MIN_WORDS, SIMILARITY = 3, 40, 0.5
SEGMENTS, PER_SEGMENT, BITS, PER_LONG = 28, 3, 3, 21
HASHES = SEGMENTS * PER_SEGMENT
LONGS = HASHES // PER_LONG
#: Fingerprints of a leaf, children of a node, and of a group that one task searches; larger groups are salted.
LEAF, FAN, GROUP = 16, 4, 2048
#: Bits of the filter that selects texts for the exact check: at most 16 MB; when full it only selects more.
MAX_FILTER_BITS = 1 << 27

_RNG = np.random.default_rng(1953)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def threshold(similarity: float) -> int:
    """Hamming distance two deviations beyond the mean at this similarity; pairs that are more similar lie well within.

    Measured on sf0.1 against brute force it keeps 99.9 % of the similar pairs that share a segment.
    """
    differ = 1 - similarity
    mean, var = BITS / 2 * differ, differ * (BITS / 4 + BITS * BITS / 4) - (BITS / 2 * differ) ** 2
    return int(np.ceil(HASHES * mean + 2.0 * np.sqrt(HASHES * var)))


class _Words(dict):
    """64-bit hashes of words; emptied when large, which changes no result."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str, words: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the neighbouring word sequences of a text, in order and with repeats."""
    w = WORD.findall(text.lower())
    a = np.fromiter((words[x] for x in w), np.uint64, len(w))
    n = len(a) - shingle + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h = (h + a[k : k + n]) * _GOLD
        h ^= h >> np.uint64(29)
    return h


def fingerprints(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x LONGS) and segment keys (n x SEGMENTS, 32 bit) of texts by their shingle hashes."""
    n = len(shingles)
    flat = np.concatenate(shingles)
    first = np.r_[0, np.cumsum([len(s) for s in shingles])[:-1]]
    low = np.empty((HASHES, n), np.uint64)
    for k in range(HASHES):
        v = flat * _MUL[k] + _ADD[k]
        v ^= v >> np.uint64(32)
        low[k] = np.minimum.reduceat(v * _MIX, first)
    fp = np.zeros((n, LONGS), np.uint64)
    for k in range(HASHES):
        bits = (low[k] * _MIX) >> np.uint64(64 - BITS)
        fp[:, k // PER_LONG] |= bits << np.uint64(BITS * (k % PER_LONG))
    keys = np.empty((n, SEGMENTS), np.int32)
    for s in range(SEGMENTS):
        h = np.zeros(n, np.uint64)
        for k in range(s * PER_SEGMENT, (s + 1) * PER_SEGMENT):
            h = (h ^ low[k]) * _MIX
            h ^= h >> np.uint64(32)
        keys[:, s] = h.astype(np.uint32).view(np.int32)
    return fp, keys


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int, min_words: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            ids, shingles, content = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingle_hashes(text, words, shingle)
                if len(h) and len(h) >= min_words - shingle + 1:
                    ids.append(i)
                    shingles.append(h)
                    content.append(xxhash.xxh64_intdigest(np.unique(h).tobytes()))
            if ids:
                fp, keys = fingerprints(shingles)
                cols = [pa.array(ids, pa.string()), pa.array(np.array(content, np.uint64).view(np.int64))]
                cols += [pa.array(fp[:, k].copy().view(np.int64)) for k in range(LONGS)]
                offsets = pa.array(np.arange(0, keys.size + 1, SEGMENTS, dtype=np.int32))
                cols.append(pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "c", *(f"f{k}" for k in range(LONGS)), "keys"])


def signatures(df: DataFrame, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, c, f0.., keys) of the texts with enough words; ``c`` identifies the shingle set, so copies share it."""
    schema = "id string, c long, " + ", ".join(f"f{k} long" for k in range(LONGS)) + ", keys array<int>"
    rows = df.select("id", "text").where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(lambda b: _signatures(b, shingle, min_words), schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Rank of each fingerprint in the Gray code sequence, as words to be compared in order."""
    out, parity = np.empty_like(fp), np.zeros(len(fp), np.uint64)
    for k in range(fp.shape[1]):
        x = fp[:, k].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        x ^= np.uint64(0) - parity
        out[:, k] = x
        parity = x & np.uint64(1)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


class GrayIndex:
    """Hierarchical index of fingerprints in Gray order; levels[0] are the leaves' parents, the last the roots."""

    def __init__(self, fp: np.ndarray) -> None:
        rank = gray_rank(fp)
        self.order = np.lexsort(rank.T[::-1])
        self.fp = fp[self.order]
        levels, either, both, size = [], self.fp, self.fp, LEAF
        while True:
            first = np.arange(0, len(either), size)
            either, both = np.bitwise_or.reduceat(either, first), np.bitwise_and.reduceat(both, first)
            levels.append((~(either ^ both), both))
            if len(either) == 1:
                break
            size = FAN
        # What a parent has settled is left out of its children, so differences add up along a path.
        self.levels = []
        for k, (mask, pattern) in enumerate(levels):
            if k + 1 < len(levels):
                mask = mask & ~levels[k + 1][0][np.arange(len(mask)) // FAN]
            self.levels.append((mask, pattern & mask))

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the fingerprints given) of all pairs within a Hamming distance of ``most``."""
        n = len(self.fp)
        query, node, sofar = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[k]
            sofar = sofar + np.bitwise_count((self.fp[query] ^ pattern[node]) & mask[node]).sum(axis=1, dtype=np.int32)
            # A pair is found from its later member: nodes that begin after the query hold only later ones.
            keep = (sofar <= most) & (node * LEAF * FAN**k < query)
            query, node, sofar = query[keep], node[keep], sofar[keep]
            if k:
                count = len(self.levels[k - 1][0])
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                ok = child < count
                query, sofar, node = np.repeat(query, FAN)[ok], np.repeat(sofar, FAN)[ok], child[ok]
        left, right = [], []
        for at in range(0, len(query), 100_000):
            q = np.repeat(query[at : at + 100_000], LEAF)
            other = (node[at : at + 100_000, None] * LEAF + np.arange(LEAF)).ravel()
            ok = other < q
            q, other = q[ok], other[ok]
            near = _distance(self.fp[q], self.fp[other]) <= most
            left.append(self.order[q[near]])
            right.append(self.order[other[near]])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _near(group: np.ndarray, salt: np.ndarray, fp: np.ndarray, cross: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within the groups of sorted rows. Groups of two salts give only pairs that cross them."""
    n, left, right = len(group), [], []
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    small = np.repeat(size <= LEAF, size)
    for gap in range(1, LEAF):
        i = np.flatnonzero((group[gap:] == group[:-gap]) & small[gap:]) if gap < n else np.empty(0, int)
        if not len(i):
            break
        i = i[_distance(fp[i], fp[i + gap]) <= most]
        left.append(i)
        right.append(i + gap)
    for g in np.flatnonzero(size > LEAF):
        a, b = GrayIndex(fp[first[g] : first[g] + size[g]]).pairs(most)
        left.append(a + first[g])
        right.append(b + first[g])
    a, b = (np.concatenate(x) if x else np.empty(0, int) for x in (left, right))
    ok = ~cross[a] | (salt[a] != salt[b])
    return a[ok], b[ok]


def _search(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows (g, salt, cross, c, f0..) that come sorted by g; a group may go over several batches."""
    rest = None
    names = ["a", "b"]

    def found(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        fp = np.stack([col(f"f{k}").view(np.uint64) for k in range(LONGS)], axis=1)
        c = col("c")
        a, b = _near(col("g"), col("salt"), fp, col("cross"), most)
        a, b = np.minimum(c[a], c[b]), np.maximum(c[a], c[b])
        pair = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=names)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = t.column("g")[-1]
        n = t.num_rows - (pc.sum(pc.equal(t.column("g"), last)).as_py() or 0)
        if n:
            yield found(t.slice(0, n))
        rest = t.slice(n)
    if rest is not None and rest.num_rows:
        yield found(rest)


def candidates(sig: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of different shingle sets that agree on a segment and whose fingerprints are near."""
    bits = [f"f{k}" for k in range(LONGS)]
    sets = sig.groupBy("c").agg(F.first("keys").alias("keys"))
    segments = sets.select("c", F.posexplode("keys").alias("s", "k")).select("c", (F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.col("k").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("g"))
    groups = segments.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("n > 1")
    # Groups beyond GROUP are salted, and every pair of salts is a block of its own that any task may take.
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    groups = groups.withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "salt").alias("i"), F.greatest(x, "salt").alias("j")))
    rows = groups.withColumn("x", F.explode(blocks)).select("c", "salt", F.when(F.col("parts") == 1, F.col("g")).otherwise(F.xxhash64("g", "x.i", "x.j")).alias("g"), (F.col("x.i") != F.col("x.j")).alias("cross"))
    prints = sig.groupBy("c").agg(*[F.first(f).alias(f) for f in bits])
    rows = rows.join(prints, "c").select("g", "salt", "cross", "c", *bits)
    most = threshold(similarity)
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _search(b, most), "a long, b long").distinct()


def _filter(ids: DataFrame) -> tuple[bytes, int]:
    """A bit for the hash of every id, in a filter of bounded size."""
    n = max(1, ids.count())
    bits = min(MAX_FILTER_BITS, max(1 << 15, 1 << (16 * n - 1).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = ids.select(F.floor(at / 32768).alias("k"), (at % 32768).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    out = bytearray(bits // 8)
    for r in maps:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = r["b"]
    return bytes(out), bits


def _sets(batches: Iterator[pa.RecordBatch], bitmap: bytes, shingle: int, min_words: int) -> Iterator[pa.RecordBatch]:
    words, bits = _Words(), np.frombuffer(bitmap, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False)
        keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        texts = batch.column(1).filter(pa.array(keep.astype(bool)))
        for k in range(0, len(texts), 2000):
            sets = [np.unique(h) for t in texts.slice(k, 2000).to_pylist() if len(h := shingle_hashes(t, words, shingle)) and len(h) >= min_words - shingle + 1]
            if sets:
                c = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["c", "shingles"])


def similar_sets(df: DataFrame, sig: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(a, b, similarity) of pairs of different shingle sets, compared exactly."""
    pairs = cut(candidates(sig, similarity))
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    ids = sig.groupBy("c").agg(F.min("id").alias("id")).join(wanted, "c", "left_semi").select("id")
    bitmap, bits = _filter(ids)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    texts = df.where("id IS NOT NULL AND text IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at"), "text")
    sets = texts.mapInArrow(lambda b: _sets(b, shared.value, shingle, min_words), "c long, shingles array<long>").groupBy("c").agg(F.first("shingles").alias("x"))
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("c").alias("b"), F.col("x").alias("xb")), "b")
    common, total = F.size(F.array_intersect("xa", "xb")), F.size("xa") + F.size("xb")
    rows = both.select("a", "b", common.alias("n"), total.alias("m"))
    return rows.select("a", "b", (F.col("n") / (F.col("m") - F.col("n"))).alias("similarity")).where(F.col("similarity") >= similarity)


def near_pairs(df: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids whose texts are similar, copies expanded.

    Null ids and texts and texts with too few words have no pairs; repeated rows of an id count once. A class of
    m exact copies has m * (m - 1) / 2 pairs by definition; near_groups has the same result in linear form.
    """
    sig = cut(signatures(df, shingle, min_words))
    sets = similar_sets(df, sig, similarity, shingle, min_words).select("a", "b")
    members = sig.select("id", "c").distinct()
    copies = members.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("a"), F.col("c").alias("b"))
    left, right = members.select(F.col("c").alias("a"), F.col("id").alias("x")), members.select(F.col("c").alias("b"), F.col("id").alias("y"))
    ids = sets.union(copies).join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return ids.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b); root is the least node.

    Large-star and small-star steps alternate until nothing changes; every step is checkpointed.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small)
        if new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(new.select(F.col("v"), F.col("v"))).distinct()
        e = new


def near_groups(df: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, group_id, links): one row per id with enough words. Ids whose texts are linked, directly or through
    others, share the least id of their group; ``links`` counts the different similar texts, a copy counting as one.
    """
    sig = cut(signatures(df, shingle, min_words))
    pairs = cut(similar_sets(df, sig, similarity, shingle, min_words).select("a", "b"))
    members = sig.select("id", "c").distinct()
    roots = components(pairs).withColumnsRenamed({"node": "c"})
    degree = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    copies = members.groupBy("c").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k"))
    classes = copies.join(roots, "c", "left").join(degree, "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = classes.groupBy("root").agg(F.min("least").alias("group_id"))
    links = (F.coalesce("n", F.lit(0)) + F.when(F.col("k") > 1, 1).otherwise(0)).cast("long")
    return members.join(classes.join(names, "root").select("c", "group_id", links.alias("links")), "c").select("id", "group_id", "links")
