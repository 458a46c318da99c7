"""Exact n-gram Jaccard join by parity sketches.

Shingles are XOR-ed into the pieces of a sketch. A differing shingle changes one piece at most, so of as many pieces as two
similar sets may have differing shingles, plus one, at least one is equal: those pieces are joined on (pigeonhole), in bands
of like set sizes. Sets that share a piece are compared by bit sketches: their Hamming distance is a lower bound of the
symmetric difference, so what is too far apart is no candidate. Families of candidates are verified on the sets, in blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay.llm.common import hashed_words, lean, list_array, map_texts, mix64, run_starts, runs, word_hashes
from rowassay.llm.components import components
from rowassay.session import discard, materialize

#: Set sizes of a band lie within this factor of each other.
GROWTH = 1.5
#: Sets, and shingles of sets, of a block of a family that one task compares with another block.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, ascending; the whole sequence as one if it has fewer words."""
    sets, end = [], 0
    for n in counts.tolist():
        own, end = hashes[end : end + n], end + n
        if n == 0:
            sets.append(own)
            continue
        size = min(n, width)
        code = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + own[k : n - size + 1 + k])
        sets.append(np.unique(code))
    return sets


def _band(size: int) -> int:
    band = int(np.log(size) / np.log(GROWTH))
    while _low(band + 1) <= size:
        band += 1
    while _low(band) > size:
        band -= 1
    return band


def _low(band: int) -> int:
    """The least size of a band."""
    return int(np.ceil(GROWTH**band - 1e-9))


@functools.cache
def _pieces(band: int, percent: int) -> tuple[int, int]:
    """Pieces of the sketches of a band, and how many of them may be empty in a set that gives no keys for its empty ones.

    Similar sets differ in ``d`` pieces at most, as |A ^ B| <= (100 - p) / (100 + p) * (|A| + |B|) if 100 |A & B| >= p |A | B|.
    So with d + 1 + e pieces at least e + 1 are equal, and if one of the sets has only e empty ones, one that is not empty
    is among them. ``e`` is a little more than the least sets of the band are expected to have.
    """
    least = 2 * (_low(band + 1) - 1) * (100 - percent) // (100 + percent) + 1
    low, spare = max(1, _low(band) * percent // 100), 0
    while True:
        empty = (least + spare) * (1 - 1 / (least + spare)) ** low
        if spare >= empty + np.sqrt(empty) or spare >= least:
            return least + spare, spare
        spare += 1


def piece_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the pieces of a set's sketches, one sketch for each band in which it may meet a similar set.

    The larger set of a pair is in its own band; the smaller one also goes to the next band if that may hold the larger.
    Empty pieces are alike in sets that have nothing in common, so only a set with too many of them gives keys for them; a
    similar set with as many does so too, and any other shares a piece with it that is not empty.
    """
    size, keys = len(found), []
    if not size:
        return np.zeros(0, np.uint64)
    own = _band(size)
    for band in (own, own + 1):
        if band > own and size * 100 < percent * _low(band):
            break
        pieces, spare = _pieces(band, percent)
        piece = (found >> np.uint64(11)) % np.uint64(pieces)
        order = np.argsort(piece, kind="stable")
        sorted_piece = piece[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_piece[1:] != sorted_piece[:-1]]))
        sketch = np.zeros(pieces, np.uint64)
        sketch[sorted_piece[starts]] = np.bitwise_xor.reduceat(found[order], starts)
        key = mix64(sketch + mix64(np.arange(pieces, dtype=np.uint64) * np.uint64(4096) + np.uint64(band)))
        keys.append(key if pieces - len(starts) > spare else key[sorted_piece[starts]])
    return np.concatenate(keys)


def _signature(found: np.ndarray) -> int:
    """One number for a set: equal sets have equal ones."""
    if not len(found):
        return 0
    whole = np.array([mix64(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(found), len(found)], np.uint64)
    return int(mix64(mix64(mix64(whole[:1]) ^ whole[1:2]) ^ whole[2:]).view(np.int64)[0])


def _sketched(df: DataFrame, keep: list[str], text_col: str, width: int, percent: int, lower: bool) -> DataFrame:
    """Size, signature and piece keys of every text's set."""

    def begin():
        store = word_hashes()

        def work(texts):
            sets = shingle_sets(*hashed_words(texts, store, lower), width)
            keys = [piece_keys(s, percent).view(np.int64) for s in sets]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_signature(s) for s in sets], pa.int64()),
                list_array(np.concatenate(keys), np.array([len(k) for k in keys])),
                pa.array([bit_sketch(s, _bit_words(len(s))).tobytes() for s in sets], pa.binary()),
            ]

        return work

    return map_texts(df, keep, text_col, "size long, node long, keys array<bigint>, bits binary", begin)


def _sets(df: DataFrame, keep: list[str], text_col: str, width: int, lower: bool) -> DataFrame:
    def begin():
        store = word_hashes()

        def work(texts):
            sets = shingle_sets(*hashed_words(texts, store, lower), width)
            return [pa.array([_signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

        return work

    return map_texts(df, keep, text_col, "made long, shingles binary", begin)


def _shared(batches):
    """Of (key, node) rows sorted by key and node: the distinct rows of each key that several nodes have."""
    held = None  # key and first node of the run that reached the end of the last batch, and whether that row is out
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        out = np.zeros(len(key), bool)
        if held is not None:
            key, node, out = np.append(held[0], key), np.append(held[1], node), np.append(held[2], out)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(new) - 1
        again = ~new & (node == np.concatenate([node[:1], node[:-1]]))
        several = np.bincount(run, node != node[new][run]) > 0
        on = several[run] & ~out & ~again
        yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(node[on])], names=["key", "node"])
        first = np.flatnonzero(new)[-1]
        held = (key[first], node[first], bool(several[-1]))


def _bit_words(size: int) -> int:
    """Words of 64 bits of a set's bit sketch: two to four bits a shingle, a power of two, so that it can be folded."""
    return 1 << max(0, (max(size, 1) - 1) // 32).bit_length()


def bit_sketch(found: np.ndarray, words: int) -> np.ndarray:
    """Parity of the shingles that fall on each of ``64 * words`` bits."""
    bits = np.bincount((found >> np.uint64(3)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The bit sketch of fewer words: bits that fall together are XOR-ed."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


#: A group of more nodes than this is compared as part of all such groups under its head.
SMALL_GROUP = 16


class Compared:
    """Nodes met under one head: their sketches, and what near pairs have joined.

    Keys under one head hold much the same nodes. The nodes of its larger groups are kept as one set of which every pair has
    been compared, so a key costs what it brings anew, and a key that brings nothing costs a look.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.place: dict[int, int] = {}
        self.nodes: list[int] = []
        self.bits: list[np.ndarray] = []
        self.folded: dict[int, np.ndarray] = {}
        self.size = self.label = np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)  # in the set of which every pair has been compared

    def add(self, nodes: list[int], sizes: np.ndarray, bits) -> np.ndarray:
        first, own = len(self.nodes), []
        for node, size, b in zip(nodes, sizes.tolist(), bits):
            if node not in self.place:
                self.place[node] = len(self.nodes)
                self.nodes.append(node)
                self.bits.append(np.frombuffer(b.as_buffer(), np.uint64))
                own.append(size)
        if own:
            self.size = np.concatenate([self.size, np.array(own, np.int64)])
            self.label = np.concatenate([self.label, np.arange(first, len(self.nodes))])
            self.met = np.concatenate([self.met, np.zeros(len(own), bool)])
        return np.fromiter((self.place[n] for n in nodes), np.int64, len(nodes))

    def _sketches(self, words: int) -> np.ndarray:
        """The bit sketches of all nodes, folded; a shorter one is left empty, and not used at that width."""
        known = self.folded.get(words, np.zeros((0, words), np.uint64))
        if len(known) < len(self.bits):
            more = [_folded(b, words) if len(b) >= words else np.zeros(words, np.uint64) for b in self.bits[len(known) :]]
            known = self.folded[words] = np.concatenate([known, np.stack(more)])
        return known

    def near(self, at: np.ndarray) -> list[tuple[int, int]]:
        """New near pairs that the nodes at these places bring: a forest beyond what is joined."""
        if len(at) <= SMALL_GROUP:
            return self._compare(at, at) if (self.label[at] != self.label[at[0]]).any() else []
        fresh = at[~self.met[at]]
        if not len(fresh):
            return []
        self.met[fresh] = True
        return self._compare(fresh, np.flatnonzero(self.met))

    def _compare(self, some: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
        found = []
        words = min(len(self.bits[k]) for k in others.tolist())
        sketch, percent = self._sketches(words), self.percent
        for i in some.tolist():
            other = others[self.label[others] != self.label[i]]
            low, high = np.minimum(self.size[other], self.size[i]), np.maximum(self.size[other], self.size[i])
            other = other[100 * low >= percent * high]
            distance = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1)
            for j in other[distance * (100 + percent) <= (100 - percent) * (self.size[other] + self.size[i])].tolist():
                if self.label[i] != self.label[j]:
                    found.append((self.nodes[i], self.nodes[j]))
                    self.label[self.label == self.label[j]] = self.label[i]
        return found


def _near(percent: int):
    def run(batches):
        head, state = None, None
        for table in runs(batches, 2):
            starts = run_starts(table, 2)
            heads, node, size, raw = table["head"].to_numpy(), table["node"].to_numpy(), table["size"].to_numpy(), table["bits"].combine_chunks()
            pairs = []
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if heads[x] != head:
                    head, state = heads[x], Compared(percent)
                pairs.extend(state.near(state.add(node[x:y].tolist(), size[x:y], (raw[k] for k in range(x, y)))))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def links_between(sets: list[np.ndarray], second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Enough similar pairs to join all sets that similar pairs join (a spanning forest).

    ``second`` marks the sets of another block: then only pairs across are looked at. If it marks none, all pairs are.
    """
    size = np.array([len(s) for s in sets])
    words = _bit_words(2 * int(size.max()))
    sketch = np.stack([bit_sketch(s, words) for s in sets])
    label, found = np.arange(len(sets)), []
    across = second.any()
    for i in np.flatnonzero(~second) if across else range(len(sets)):
        others = np.flatnonzero((second if across else np.arange(len(sets)) > i) & (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        if not len(others):
            continue
        distance = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
        for j in others[distance * (100 + percent) <= (100 - percent) * (size[others] + size[i])]:
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (size[i] + size[j] - common):
                found.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return found


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, lower: bool = True) -> DataFrame:
    """Components of the texts whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns per row: ``id_col``, n_shingles, component_id (the least id reachable by links, itself included). Words are runs
    of anything but ASCII white space, with A-Z in lower case if ``lower``; a set holds the distinct ``width``-word
    shingles, or the whole sequence if there are fewer words. Null texts and texts without words have the empty set, which
    is linked with nothing. Rows with equal sets are one node, however many they are; rows with a null id take part, and are
    named by the least other id of their component, if any. Repeated rows are kept; other columns are not read.
    """
    sketched = materialize(_sketched(df, [id_col], text_col, width, percent, lower), "sketches")
    base = materialize(sketched.drop("keys", "bits"), "sizes")
    # one row for each distinct set; copies meet here as counts do, and go no further
    nodes = materialize(sketched.filter("size > 0").groupBy("node", "size").agg(F.min(id_col).alias("_id"), F.first("bits").alias("bits")), "nodes")
    first = sketched.join(nodes.select("node", "_id").hint("merge"), (sketched["node"] == nodes["node"]) & sketched[id_col].eqNullSafe(nodes["_id"]), "left_semi")
    keyed = first.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    shared = materialize(keyed.mapInArrow(lean(_shared), "key long, node long"), "shared")
    discard(sketched)
    # many keys have the same nodes, and one of those keys says all; keys of one family come together under its first node
    groups = shared.groupBy("key").agg(
        F.min("node").alias("head"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n")
    )
    telling = groups.groupBy("x", "y", "n").agg(F.min_by(F.struct("head", "key"), "key").alias("k")).select("k.head", "k.key")
    met = shared.join(telling.hint("merge"), "key").join(nodes.select("node", "size", "bits").hint("merge"), "node")
    sorted_ = met.select("head", "key", "size", "node", "bits").repartition("head").sortWithinPartitions("head", "key", "size", "node")
    near = sorted_.mapInArrow(lean(_near(percent)), "a long, b long")
    family = components(near)
    # the sets of the family members only
    members = materialize(family.join(nodes.drop("bits"), "node").select("node", "size", "_id", F.col("component").alias("family")), "members")
    totals = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocked = members.join(totals, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    texts = df.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    # texts are joined alike at every size; a small side must not decide the plan
    wanted = texts.join(blocked.hint("merge"), texts["_doc"].eqNullSafe(blocked["_id"]))
    sets = _sets(wanted, ["node", "family", "blocks", "own"], "_text", width, lower).filter("made = node").dropDuplicates(["node"])
    # block i meets every block; the pair's first block is the lesser
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "shingles"
    )
    linked = paired.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node").mapInArrow(lean(_linker(percent)), "a long, b long")
    joined = components(linked)
    least = joined.join(nodes.select("node", "_id"), "node").groupBy("component").agg(F.min("_id").alias("least"))
    named = joined.join(least, "component").select("node", "least")
    own = base.select(id_col, "size", "node").join(nodes.select("node", "_id"), "node", "left").join(named, "node", "left")
    return own.select(id_col, F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("least", "_id")).otherwise(F.col(id_col)).alias("component_id"))


def _linker(percent: int):
    def run(batches):
        for table in runs(batches, 3):
            starts = run_starts(table, 3)
            own, second, node = table["own"].to_numpy(), table["j"].to_numpy(), table["node"].to_numpy()
            crossing = table["i"].to_numpy() != second
            raw, a, b = table["shingles"], [], []
            for x, y in zip(starts[:-1], starts[1:]):
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in raw.slice(x, y - x)]
                mark = (own[x:y] == second[x:y]) & crossing[x:y]
                if crossing[x] and (mark.all() or not mark.any()):
                    continue
                for i, j in links_between(sets, mark, percent):
                    a.append(node[x + i])
                    b.append(node[x + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run
