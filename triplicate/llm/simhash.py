"""Near-duplicates by SimHash: fingerprints of word shingles, linked by a binary-trie self-join within Hamming budget."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.llm.common import join_hot, map_batches, materialize, mix, plainly_named, prepare, table, texts, word_hashes, words_of
from triplicate.llm.components import components

BITS = 64


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if more than half of the XXH64 of all shingles, repeats included, have it set.

    Words are parted by ASCII white space and A-Z lower-cased; a text of fewer words is one shingle, one without
    words has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):  # bounds the unpacked bits of a very long text
        counts += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

        return step

    return make


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    prepare(docs.sparkSession)
    return map_batches(texts(docs), _fingerprints(shingle), "doc_id long, fp long")


# The join ------------------------------------------------------------------


class TrieJoin:
    """Links between distinct sorted fingerprints within ``budget`` differing bits, as a spanning forest.

    The trie is path-compressed and lies in the sorted array: a node is a range of it, parted at the highest bit
    in which its ends differ. Pairs of nodes are traversed together; the bits in which their common prefixes
    differ are the error so far, and beyond the budget the pair is dropped. Pairs of nodes that are each linked
    through and already linked to one another add nothing and are dropped as well, so a dense group costs about
    as much as its size.
    """

    def __init__(self, keys: list[int], budget: int) -> None:
        self.keys, self.budget = keys, budget
        self.parent = list(range(len(keys)))
        self.whole: dict[tuple[int, int], bool] = {}
        self.nodes: dict[tuple[int, int], int] = {}

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def _part(self, lo: int, hi: int) -> int:
        """Where the second child of [lo, hi) begins."""
        if (at := self.nodes.get((lo, hi))) is None:
            keys = self.keys
            bit = (keys[lo] ^ keys[hi - 1]).bit_length() - 1
            a, b = lo, hi - 1
            while b - a > 1:
                m = (a + b) // 2
                if keys[m] >> bit & 1:
                    b = m
                else:
                    a = m
            self.nodes[lo, hi] = at = b
        return at

    def _pair(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        stack = [(a, b)]
        keys, budget = self.keys, self.budget
        while stack:
            (alo, ahi), (blo, bhi) = a, b = stack.pop()
            below = max((keys[alo] ^ keys[ahi - 1]).bit_length(), (keys[blo] ^ keys[bhi - 1]).bit_length())
            if ((keys[alo] ^ keys[blo]) >> below).bit_count() > budget:
                continue
            if self.whole.get(a, ahi - alo == 1) and self.whole.get(b, bhi - blo == 1) and self.find(alo) == self.find(blo):
                continue
            if not below:
                self.parent[self.find(blo)] = self.find(alo)
                continue
            # Part the node whose children differ higher up.
            if (keys[alo] ^ keys[ahi - 1]).bit_length() == below:
                m = self._part(alo, ahi)
                stack += [((alo, m), b), ((m, ahi), b)]
            else:
                m = self._part(blo, bhi)
                stack += [(a, (blo, m)), (a, (m, bhi))]

    def join(self) -> list[int]:
        """Each fingerprint's root: the index of another that it is linked with, over several links perhaps."""
        todo = [(0, len(self.keys), False)] if self.keys else []
        while todo:
            lo, hi, ready = todo.pop()
            if hi - lo < 2:
                continue
            m = self._part(lo, hi)
            if not ready:
                todo += [(lo, hi, True), (lo, m, False), (m, hi, False)]
                continue
            self._pair((lo, m), (m, hi))
            whole = self.whole.get((lo, m), m - lo == 1) and self.whole.get((m, hi), hi - m == 1)
            self.whole[lo, hi] = whole and self.find(lo) == self.find(m)
        return [self.find(i) for i in range(len(self.keys))]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    """The rows of each (mask, key) that has two or more, from rows sorted by them; None after each batch.

    A run may go on in the next batch.
    """
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        mask, key = batch.column("mask").to_numpy(), batch.column("key").to_numpy()
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        lows, highs = np.concatenate(([0], cuts)), np.concatenate((cuts, [batch.num_rows]))
        inner = (highs - lows > 1) | (lows == 0) | (highs == batch.num_rows)  # single rows inside a batch link to nothing
        for lo, hi in zip(lows[inner].tolist(), highs[inner].tolist(), strict=True):
            this = (int(mask[lo]), int(key[lo]))
            if this != held_key:
                if sum(b.num_rows for b in held) > 1:
                    yield pa.Table.from_batches(held)
                held, held_key = [], this
            held.append(batch.slice(lo, hi - lo))
        yield None
    if sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)


def _linked(solve: Callable[[pa.Table], tuple[list[int], list[int]]]):
    """Links (a, b) of all runs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for rows in _runs(batches):
            if rows is not None:
                more = solve(rows)
                a += more[0]
                b += more[1]
            elif a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _within(budget: int):
    def solve(rows: pa.Table) -> tuple[list[int], list[int]]:
        keys = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        roots = TrieJoin(keys.tolist(), budget).join()
        signed = keys.view(np.int64)
        linked = [(i, r) for i, r in enumerate(roots) if i != r]
        return [int(signed[i]) for i, _ in linked], [int(signed[r]) for _, r in linked]

    return solve


def masks(budget: int) -> list[int]:
    """Bit masks of which any two words within ``budget`` differing bits agree under one at least.

    The bits are cut into ``budget + 2`` blocks; with ``budget`` errors two blocks at least are free of them.
    """
    blocks = budget + 2
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [block[i] | block[j] for i, j in combinations(range(blocks), 2)]


#: Rows of one masked value that one task joins with one another, or with as many others, at about most.
RUN = 1 << 16


def _pairs(block: Column, blocks: Column) -> Column:
    """Numbers of the pairs of blocks that hold ``block``: each two blocks meet once, what lies in one meets there as well."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: k != block)
    pairs = F.transform(others, lambda k: F.least(k, block) * blocks + F.greatest(k, block))
    return F.when(blocks > 1, pairs).otherwise(F.array(F.lit(0).cast("long")))


def _runs_sorted(keyed: DataFrame, by: str) -> DataFrame:
    """Rows with each (mask, key) together and sorted by ``by``; one of more than ``RUN`` rows is dealt as pairs of blocks.

    ``mask`` then tells such pairs apart as well.
    """
    total = keyed.count()
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.withColumn("mask", F.col("mask").cast("long"))
    if total > RUN:
        large = materialize(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > RUN))
        if not large.isEmpty():
            large = large.withColumn("blocks", F.ceil(F.col("n") / F.lit(RUN)))
            blocks = F.coalesce("blocks", F.lit(1).cast("long"))
            parts = _pairs(F.pmod(F.xxhash64(by), blocks), blocks)
            keyed = join_hot(keyed, large, ["mask", "key"], "n", total, "left").withColumn("part", F.explode(parts))
            keyed = keyed.withColumn("mask", F.col("part") * 256 + F.col("mask")).drop("part", "blocks")
    return keyed.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", by)


def link(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """(fp, root) for every distinct fingerprint: root is the same for those that links connect.

    Fingerprints go, once for each mask, to the task of their masked bits, where a trie join links them; what it
    gives is a forest no larger than its input, and components join the forests. A task holds the distinct fingerprints
    of one mask value, or of two blocks of about ``RUN`` where there are more.
    """
    spark = distinct.sparkSession
    prepare(spark)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(budget)]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "key"))
    found = components(_runs_sorted(keyed, "fp").mapInArrow(_linked(_within(budget)), "a long, b long"))
    roots = found.select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), *[c for c in distinct.columns if c != "fp"])


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) of every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows are linked to
    one another; an empty table gives no rows; columns besides doc_id and text are not read. Documents of one
    fingerprint are gathered by partial aggregation before anything is joined, and those of a very frequent one are
    joined apart.
    """
    by_doc = materialize(fingerprints(docs, shingle))
    distinct = materialize(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = materialize(link(distinct, budget))
    classes = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    of_fp = materialize(join_hot(linked, classes, ["root"], "members", linked.count()).select("fp", "component_id", "n"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_hot(by_doc, of_fp, ["fp"], "n", by_doc.count()).select("doc_id", hexed, "component_id")


# Near-duplicates by similarity of shingle sets ------------------------------

#: Bits of the fingerprint of a text's set of shingles, which parts candidates from chance meetings.
WIDE = 256
#: Bands, and minima of each, under which candidates meet: sets of similarity s share one with 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 24, 5
#: Shingles of the texts that one task compares with one another, or with as many others, at about most.
BLOCK = 1 << 20


def budget_for(similarity: float, bits: int = WIDE) -> int:
    """Differing bits that sets of this Jaccard similarity do not exceed: the mean and five standard deviations.

    Sets of equal size have the cosine 2s / (1 + s), others of that similarity a larger one, and a bit differs with
    the angle's share of a half turn.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def _votes(hashes: np.ndarray, seeds: range) -> np.ndarray:
    """For each seed 64 bits, set if more than half of the distinct hashes have them set once scrambled by the seed."""
    counts = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] + (np.array(seeds, np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
        counts += np.unpackbits(mix(part).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes))


_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _bands(hashes: np.ndarray) -> np.ndarray:
    """For each band a hash of the least of the set's hashes under each of the band's factors."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + 512]).min(1), out=least)
    return mix(mix(least.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=np.uint64)).sum(1, dtype=np.uint64)).view(np.int64)


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of ``shingle`` words in a row; a text of fewer words is one shingle."""
    raw, begin, end, first = words_of(column)
    lower = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    words = word_hashes(lower, begin, end)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        of = words[a:b]
        rolled = np.zeros(max(1, len(of) - shingle + 1), np.uint64)
        for k in range(shingle if len(of) >= shingle else 0):
            rolled += mix(of[k : k + len(rolled)] + np.uint64(k + 1))
        if len(of) < shingle:
            rolled[0] = np.bitwise_xor.reduce(mix(of + np.arange(1, len(of) + 1, dtype=np.uint64))) if len(of) else 0
        yield np.unique(rolled)


def _node(hashes: np.ndarray) -> int:
    """What a set is known by: texts of one set have one."""
    return int(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))


def _signatures(shingle: int):
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), "node": [], "n": [], "wide": [], "bands": []}
            for hashes in _sets(batch.column("text"), shingle):
                out["node"].append(_node(hashes))
                out["n"].append(len(hashes))
                out["wide"].append(_votes(hashes, range(3, 3 + WIDE // 64)).tobytes())
                out["bands"].append(_bands(hashes))
            return out

        return step

    return make


def _similar(budget: int):
    def solve(rows: pa.Table) -> tuple[list[int], list[int]]:
        nodes: dict[int, list[int]] = {}
        for wide, node in zip(rows.column("wide").to_pylist(), rows.column("node").to_pylist(), strict=True):
            nodes.setdefault(int.from_bytes(wide, "big"), []).append(node)
        keys = sorted(nodes)
        linked = [(nodes[keys[i]][0], nodes[keys[r]][0]) for i, r in enumerate(TrieJoin(keys, budget).join()) if i != r]
        linked += [(node, of[0]) for of in nodes.values() for node in of[1:]]  # different sets of one fingerprint
        return [a for a, _ in linked], [b for _, b in linked]

    return solve


def verified(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what all pairs of this Jaccard similarity or more connect; each is such a pair.

    Sets are taken by size, each against the smaller ones that it is not connected with yet and that are large
    enough: first those that have linked most, one of each component, then all others.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    label, hits, links = np.arange(len(sets)), np.zeros(len(sets), np.int64), []
    hub: dict[int, int] = {}

    def compare(i: int, others: np.ndarray) -> None:
        of = sets[i]
        ends = np.cumsum(sizes[others])
        joined = np.concatenate([sets[j] for j in others.tolist()])
        at = np.minimum(np.searchsorted(of, joined), len(of) - 1)
        common = np.add.reduceat((of[at] == joined).astype(np.int64), np.concatenate(([0], ends[:-1])))
        for j in others[common / (sizes[i] + sizes[others] - common) >= similarity].tolist():
            hits[j] += 1
            if label[i] != label[j]:
                links.append((order[i], order[j]))
                old, kept = sorted((hub.pop(int(label[i]), i), hub.pop(int(label[j]), j)), key=lambda x: hits[x])
                label[label == label[i]] = label[j]
                hub[int(label[j])] = kept
            elif hits[j] > hits[hub[int(label[j])]]:
                hub[int(label[j])] = j

    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes[:i], similarity * int(sizes[i]) * (1 - 1e-12)))
        if low == i:
            continue
        first = np.array([h for h in sorted(hub.values(), key=lambda x: -hits[x])[:64] if low <= h < i], np.int64)
        for k in range(0, len(first), 8):
            compare(i, first[k : k + 8])
        rest, size = low + np.flatnonzero(label[low:i] != label[i]), 16
        rest = np.setdiff1d(rest, first, assume_unique=True)
        while len(rest):
            compare(i, rest[:size])
            rest = rest[size:]
            rest = rest[label[rest] != label[i]]
            size = min(2 * size, 256)
    return links


def _verified(similarity: float):
    def solve(rows: pa.Table) -> tuple[list[int], list[int]]:
        of = dict(zip(rows.column("node").to_pylist(), rows.column("hashes").to_pylist(), strict=True))  # repeated rows are one
        nodes = list(of)
        links = verified([np.frombuffer(h, np.uint64) for h in of.values()], similarity)
        return [nodes[a] for a, _ in links], [nodes[b] for _, b in links]

    return solve


def _hashes(shingle: int):
    """The sets themselves; none for a text that is not the node's, as that of another row with its doc_id."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            wanted = batch.column("node").to_pylist()
            sets = zip(_sets(batch.column("text"), shingle), wanted, strict=True)
            hashes = pa.array([s.tobytes() if _node(s) == node else None for s, node in sets], pa.binary())
            return {"node": batch.column("node"), "key": batch.column("key"), "parts": batch.column("parts"), "hashes": hashes}

        return step

    return make


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id reachable over links of similar texts.

    Texts are similar if their sets of ``shingle`` words in a row have this Jaccard similarity or more, counted on the
    sets themselves (of 64-bit hashes). Candidates meet under ``BANDS`` bands of ``ROWS`` minima of hashes of the
    shingles, where a trie join links those whose fingerprints differ in no more bits than similar texts do; a pair
    of similarity 0.8 meets with a probability of 0.9999, a closer one with more. Components of candidates are
    then dealt out with their sets, one of more than ``BLOCK`` shingles as pairs of blocks, and only similar texts
    stay linked. Texts of one set are gathered first. Null, empty and blank texts are alike; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, node long, n long, wide binary, bands array<long>"
    by_doc = materialize(map_batches(texts(docs), _signatures(shingle), schema))
    one = [F.first(c).alias(c) for c in ("n", "wide", "bands")]
    distinct = materialize(by_doc.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *one))
    keyed = distinct.select("node", "wide", F.posexplode("bands").alias("mask", "key"))
    met = components(_runs_sorted(keyed, "wide").mapInArrow(_linked(_similar(budget_for(similarity))), "a long, b long"))
    met = materialize(met.join(distinct.select("node", "least", "n"), "node").select("node", "least", "n", F.col("root").alias("key")))
    blocks = materialize(met.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("blocks"), F.count("*").alias("members")))
    parts = _pairs(F.pmod(F.xxhash64("node"), F.col("blocks")), F.col("blocks")).alias("parts")
    dealt = join_hot(met, blocks, ["key"], "members", met.count()).select(F.col("least").alias("doc_id"), "node", "key", parts)
    read = texts(docs).join(dealt.hint("shuffle_hash"), "doc_id").select("node", "key", "parts", "text")
    sets = map_batches(read, _hashes(shingle), "node long, key long, parts array<long>, hashes binary").where("hashes is not null")
    sets = sets.select("node", "key", "hashes", F.explode("parts").alias("mask"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "node")
    roots = components(sets.mapInArrow(_linked(_verified(similarity)), "a long, b long"))
    rooted = distinct.select("node", "least", "copies").join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    of_node = materialize(rooted)
    classes = materialize(of_node.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    of_node = materialize(join_hot(of_node, classes, ["root"], "members", of_node.count()).select("node", "component_id", "copies"))
    return join_hot(by_doc.select("doc_id", "node"), of_node, ["node"], "copies", by_doc.count()).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The same columns, with one document of each group of similar texts: that of the smallest doc_id.

    Rows that repeat the doc_id that stays, stay with it. Rows without a doc_id always stay, copies too: nothing tells one
    of them from another. Columns may have any names and types.
    """
    dropped = similar_groups(docs, shingle, similarity).where("component_id <> doc_id").select("doc_id").distinct()
    plain = plainly_named(docs)
    return plain.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*plain.columns).toDF(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at two or fewer differing bits of fingerprints of three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))
