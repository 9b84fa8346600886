"""N-gram Jaccard join with a prefix tree.

Every text becomes a set of hashed word shingles. Texts with equal sets are one node. All sets are put into one
global order, rare shingles first by a count-min estimate, and two sets that link share one of their first
``n - ceil(threshold n) + 1`` shingles. A shingle estimated once links nothing and is not sent at all.
Sets that share such a shingle and are of like size are put into one block; blocks are exact in that no link leaves one.

Inside a block the sets, frequent shingles first, go into a prefix tree with shared beginnings. A probe walks
the tree level by level, adds up the overlap with shared paths once, and leaves a subtree when what
remains of it cannot reach the overlap that is needed. A set linked to the block's pivot needs no probe of
its own: every pair with a set outside is met by the outside set's probe.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.llm import sketch
from reachgrid.llm.components import components
from reachgrid.llm.words import Words, blocks, mixed, pack, pack_plain, runs, shuffle_partitions, text_ids, unpack, unpack_plain, words_of
from reachgrid.session import checkpoint_folder

WORDS = 4
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: One sketch row of 2 ** CELL_BITS cells and three thresholds: 48 MB.
CELL_BITS = 27
LEVELS = (2, 8, 64)
#: Shingles of the sets that one task joins; a larger block is dealt over pairs of parts of half that size.
BLOCK_SHINGLES = 6_000_000
#: Type of a node: holds every long and as many numbers again.
NODE = "decimal(20,0)"
#: Prefix entries that a task holds.
HELD = 2_000_000


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    n = len(words.codes)
    size = np.diff(words.starts)
    h = words.hashes()[words.codes] if n else np.zeros(0, np.uint64)
    whole = np.flatnonzero((size > 0) & (size < k))  # shorter texts: the whole sequence is the shingle
    start = np.flatnonzero(np.arange(n) + k <= np.repeat(words.starts[1:], size))
    g = np.full(len(start), k, np.uint64)
    for j in range(k):
        g = mixed(g) + h[start + j]
    g = mixed(g)
    doc = text_ids(words.starts)[start]
    short = []
    for d in whole:
        x = np.array([size[d]], np.uint64)
        for w in h[words.starts[d]:words.starts[d + 1]]:
            x = mixed(x) + w
        short.append(mixed(x)[0])
    if len(whole):
        at = np.searchsorted(doc, whole)
        g, doc = np.insert(g, at, np.array(short, np.uint64)), np.insert(doc, at, whole)
    cuts = np.searchsorted(doc, np.arange(len(size) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], np.concatenate(([0], np.cumsum(keep)))[cuts]


def signatures(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two arrays; an empty set has 0, 0."""
    out = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAAAAAAAAAAAAAAAB)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ salt))))
        out.append(mixed(total[starts[1:]] - total[starts[:-1]]))
    return out[0].view(np.int64), out[1].view(np.int64)


def _sketched(k: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for block in blocks(batches):
            yield shingle_sets(words_of(block.column("text"), lower=True), k)[0]
    return keys


# -- first pass: nodes, sets, and what shares a prefix shingle ----------------------------------------------

OUT = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("_key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
OUT_NAMES = "kind string, doc_id long, _key long, a long, b long, n long, data binary"


def _rows(kind: str, doc_id, key, a, b, n, data) -> pa.RecordBatch:
    size = len(a)
    none = pa.nulls(size, pa.int64())
    values = [pa.array([kind] * size), *(none if x is None else pa.array(x, pa.int64()) for x in (doc_id, key, a, b, n)),
              pa.nulls(size, pa.binary()) if data is None else pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(values, schema=OUT)


def _chained(token: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, percent: int):
    """Runs of size intervals that could link under one token: per run token, low, high, its least node; and star edges inside."""
    order = np.lexsort((a, low, token))
    token, low, high, a = token[order], low[order], high[order], a[order]
    # Highest size so far inside the token: sizes are small, so a token's offset keeps tokens apart.
    step = int(high.max()) + 1 if len(high) else 1
    group = np.cumsum(np.concatenate(([0], (token[1:] != token[:-1]).astype(np.int64)))) if len(token) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate(high + group * step) - group * step
    new = np.ones(len(token), bool)
    new[1:] = (group[1:] != group[:-1]) | (100 * reach[:-1] < percent * low[1:])
    first = np.flatnonzero(new)
    if not len(first):
        return token, low, high, a, np.zeros((0, 2), np.int64)
    least, top = np.minimum.reduceat(a, first), np.maximum.reduceat(high, first)
    ends = np.stack((np.repeat(least, np.diff(np.append(first, len(a)))), a), 1)
    ends = ends[ends[:, 0] != ends[:, 1]]
    if len(ends):
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
        ends = ends[np.concatenate(([True], (ends[1:] != ends[:-1]).any(1)))]
    return token[first], low[first], top, least, ends


def _first_pass(k: int, percent: int, buckets: int, seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            token, size, a = (np.concatenate([h[i] for h in held]) for i in range(3))
            token, low, high, a, edges = _chained(token, size, size, a, percent)
            if len(edges):
                yield _rows("edge", None, None, edges[:, 0], edges[:, 1], None, None)
            cuts = np.searchsorted(token, np.array([(i << 64) // buckets for i in range(buckets)], np.uint64))
            for i, at in enumerate(np.split(np.arange(len(token)), cuts[1:])):
                if len(at):
                    data = b"".join(len(x).to_bytes(4, "little") + x for x in (
                        pack(token[at]), pack_plain(low[at].astype(np.uint32)), pack_plain(high[at].astype(np.uint32)), pack_plain(a[at])))
                    yield _rows("run", None, None, [i], None, None, [data])
        n = 0
        for block in blocks(batches):
            sets, starts = shingle_sets(words_of(block.column("text"), lower=True), k)
            a, b = signatures(sets, starts)
            size = np.diff(starts)
            yield _rows("doc", block.column("doc_id"), block.column("_key"), a, b, size, None)
            level = np.zeros(len(sets), np.uint8)
            for i in range(len(LEVELS)):
                level += seen.value.reaches(sets, i)
            chosen, packed = [], []
            for d in np.flatnonzero(size).tolist():
                node = (int(a[d]), int(b[d]))
                if node in known:
                    continue
                lo, hi = int(starts[d]), int(starts[d + 1])
                prefix = hi - lo - -(-percent * (hi - lo) // 100) + 1
                lv = level[lo:hi]
                at = np.argsort(lv, kind="stable")[:prefix]  # sets are sorted by hash: by level, then hash
                at = at[lv[at] > 0]
                if len(at):
                    known.add(node)
                    held.append((sets[lo:hi][at], np.full(len(at), hi - lo, np.int64), np.full(len(at), a[d], np.int64)))
                    n += len(at)
                    chosen.append(d)
                    packed.append(pack(sets[lo:hi]))
            if chosen:
                yield _rows("set", None, None, a[chosen], b[chosen], size[chosen], packed)
            if n >= HELD:
                yield from out()
                held.clear()
                known.clear()
                n = 0
        if held:
            yield from out()
    return run


def _sharing(percent: int):
    def edges(key: tuple, parts: pa.Table) -> pa.Table:
        got: list[list] = [[], [], [], []]
        for data in parts.column("data"):
            data, at = data.as_py(), 0
            for i, kind in enumerate(("u8", "u4", "u4", "i8")):
                size = int.from_bytes(data[at:at + 4], "little")
                piece = data[at + 4:at + 4 + size]
                got[i].append(unpack(piece, kind) if i == 0 else unpack_plain(piece, kind))
                at += 4 + size
        token, low, high, a = map(np.concatenate, got)
        ends = _chained(token, low.astype(np.int64), high.astype(np.int64), a, percent)[4]
        return pa.table({"u": pa.array(ends[:, 1], pa.int64()), "v": pa.array(ends[:, 0], pa.int64())})
    return edges


# -- blocks ------------------------------------------------------------------------------------------------


class PrefixTree:
    """Sets of small integers in ascending order, as a tree of runs of elements."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        parent, start, stop = [-1], [0], [0]
        leaf: list[tuple[int, int]] = []  # node, set
        tokens, base = [], 0
        path: list[tuple[int, int]] = [(0, 0)]  # node, depth at its end
        last = np.zeros(0, np.uint32)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            below = None
            while path[-1][1] > common:
                below = path.pop()
            if path[-1][1] < common:  # the shared part ends inside a run: cut the run in two
                node, depth = below
                top = len(parent)
                parent.append(parent[node])
                start.append(start[node])
                stop.append(start[node] + common - path[-1][1])
                start[node] = stop[top]
                parent[node] = top
                path.append((top, common))
            tokens.append(s)
            if len(s) > common:
                node = len(parent)
                parent.append(path[-1][0])
                start.append(base + common)
                stop.append(base + len(s))
                path.append((node, len(s)))
            leaf.append((path[-1][0], i))
            last = s
            base += len(s)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
        self.parent, self.start, self.stop = map(np.array, (parent, start, stop))
        n = len(parent)
        depth = np.zeros(n, np.int64)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            kids[parent[i]].append(i)
        top_down = [0]
        for i in top_down:
            top_down.extend(kids[i])
        self.leaf = {}
        least, most, rest = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for node, i in leaf:
            self.leaf.setdefault(node, []).append(i)
            least[node], most[node] = min(least[node], sizes[i]), max(most[node], sizes[i])
        for i in reversed(top_down[1:]):  # bounds of what lies below each node
            p = parent[i]
            least[p], most[p] = min(least[p], least[i]), max(most[p], most[i])
            rest[p] = max(rest[p], rest[i] + self.stop[i] - self.start[i])
        self.least, self.most, self.rest, self.depth = least, most, rest, depth
        self.kids_at = np.concatenate(([0], np.cumsum([len(x) for x in kids])))
        self.kids = np.array([c for x in kids for c in x], np.int64)
        self.is_leaf = np.zeros(n, bool)
        self.is_leaf[list(self.leaf)] = True

    def linked(self, probe: np.ndarray, size: int, percent: int, has: np.ndarray) -> list[int]:
        """Sets that link with a set of ``size`` elements of which ``probe`` are in the tree's vocabulary; ``has`` is scratch space."""
        has[probe] = True
        found: list[int] = []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lowest, highest = -(-percent * size // 100), 100 * size // percent
        while len(nodes):
            for node, o in zip(nodes[self.is_leaf[nodes]].tolist(), overlap[self.is_leaf[nodes]].tolist(), strict=True):
                found += [i for i in self.leaf[node] if 100 * o >= percent * (size + int(self.sizes[i]) - o)]
            count = self.kids_at[nodes + 1] - self.kids_at[nodes]
            at = np.repeat(self.kids_at[nodes] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            nodes, overlap = self.kids[at], np.repeat(overlap, count)
            length = self.stop[nodes] - self.start[nodes]
            if not len(nodes):
                break
            begin = np.concatenate(([0], np.cumsum(length)[:-1]))
            place = np.repeat(self.start[nodes] - begin, length) + np.arange(length.sum())
            overlap = overlap + np.add.reduceat(has[self.tokens[place]].astype(np.int64), begin)
            other = np.maximum(self.least[nodes], lowest)
            need = -(-percent * (size + other) // (100 + percent))
            best = overlap + np.minimum(len(probe) - overlap, self.rest[nodes])
            keep = (best >= need) & (self.least[nodes] <= highest) & (self.most[nodes] >= lowest)
            nodes, overlap = nodes[keep], overlap[keep]
        has[probe] = False
        return found


def join_block(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set of hashes the number of its component inside the block; only connectedness is found, not every link."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    first, count = runs(every[order])
    shared = count > 1
    # Elements in several sets, the most frequent first; the others never add to an overlap.
    rank = np.full(len(first), -1, np.int64)
    rank[np.flatnonzero(shared)[np.argsort(-count[shared], kind="stable")]] = np.arange(shared.sum())
    dense = np.empty(len(every), np.int64)
    dense[order] = np.repeat(rank, count)
    weight = np.empty(len(every), np.int64)
    weight[order] = np.repeat(count, count)
    at = np.concatenate(([0], np.cumsum(sizes)))
    coded = []
    for i in range(len(sets)):
        x = dense[at[i]:at[i + 1]]
        coded.append(np.sort(x[x >= 0]).astype(np.uint32))
    pivot = int(np.argmax(np.add.reduceat(weight, at[:-1]) / np.sqrt(sizes)))
    tree, has = PrefixTree(coded, sizes), np.zeros(int(shared.sum()), bool)
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def probe(i: int) -> list[int]:
        found = tree.linked(coded[i], int(sizes[i]), percent, has)
        for j in found:
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
        return found
    covered = {pivot, *probe(pivot)}
    for i in range(len(sets)):
        if i not in covered:
            probe(i)
    return [top(i) for i in range(len(sets))]


def _joined(percent: int):
    def join(key: tuple, parts: pa.Table) -> pa.Table:
        top = np.array(join_block([unpack(x.as_py(), "u8") for x in parts.column("data")], percent), np.int64)
        rows = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"u": parts.column("rep").take(pa.array(rows)), "v": parts.column("rep").take(pa.array(top[rows]))})
    return join


def near_groups(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, _key and _first of every row.

    A set is the distinct ``k``-word shingles of the text, A-Z lower-cased; a text of fewer words is one
    shingle; a NULL or empty text has an empty set and is alone. ``component_id`` is the least doc_id
    that links reach. Rows that repeat a doc_id are one document, linked by any of its texts; a row with a
    NULL doc_id is a document of its own text and comes back NULL, as does the component of such rows alone. ``_first``
    marks rows of the document that a component is named after. Other columns are ignored; every long is a doc_id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_key"))
    buckets = 2 * shuffle_partitions(spark)
    seen = sketch.merged(source.select("text"), _sketched(k), bits=cell_bits, rows=1, thresholds=LEVELS)
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    source.mapInArrow(_first_pass(k, percent, buckets, seen), OUT_NAMES).write.partitionBy("kind").parquet(path)
    seen.destroy()  # what needed it is written
    schema = spark.createDataFrame([], OUT_NAMES).schema
    rows = spark.read.schema(schema).parquet(path)
    behind = F.lit(str(1 << 63)).cast(NODE)
    # Nodes are numbers wider than a long: all longs are ids, and a document without id goes by its text's hash behind them.
    node = F.coalesce(F.col("doc_id").cast(NODE), behind + F.pmod("_key", F.lit((1 << 63) - 1)).cast("decimal(19,0)")).cast(NODE)
    nodes = rows.where("kind = 'doc'").select("doc_id", "_key", "a", "b", "n", node.alias("node"))
    reps = nodes.where("n > 0").groupBy("a", "b").agg(F.min("node").alias("rep"))
    near = rows.where("kind = 'edge'").select(F.col("b").alias("u"), F.col("a").alias("v"))
    far = rows.where("kind = 'run'").select(F.col("a").alias("bucket"), "data").groupBy("bucket").applyInArrow(_sharing(percent), "u long, v long")
    block = components(near.unionByName(far)).withColumnRenamed("node", "a").withColumnRenamed("component", "block")
    # A set may have been met by several tasks; any of the equal copies will do.
    sets = rows.where("kind = 'set'").join(block, "a").groupBy("block", "a", "b").agg(F.first("n").alias("n"), F.first("data").alias("data")).join(reps, ["a", "b"])
    sizes = sets.groupBy("block").agg(F.ceil(F.sum("n") / (BLOCK_SHINGLES // 2)).cast("int").alias("parts"), F.count("*").alias("members")).where("members > 1")
    dealt = sets.join(sizes.drop("members"), "block").withColumn("parts", F.when(F.col("parts") > 2, F.col("parts")).otherwise(1))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", "data")
    links = dealt.groupBy("block", "i", "j").applyInArrow(_joined(percent), f"u {NODE}, v {NODE}")
    # Texts of one id are one document: where an id has several sets, the document is tied to each.
    several = nodes.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("x"), F.max(F.struct("a", "b")).alias("y")).where("x <> y")
    ties = nodes.where("n > 0").join(several.select("doc_id"), "doc_id").join(reps, ["a", "b"]).select(F.col("node").alias("u"), F.col("rep").alias("v"))
    found = components(links.unionByName(ties))
    linked = reps.join(found, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("component", "rep").alias("component"))
    full = nodes.where("n > 0").join(linked, ["a", "b"]).select("doc_id", "_key", "n", "node", "component")
    empty = nodes.where("n = 0").join(found, "node", "left").select("doc_id", "_key", "n", "node", F.coalesce("component", "node").alias("component"))
    return full.unionByName(empty).select("doc_id", F.when(F.col("component") < behind, F.col("component").cast("long")).alias("component_id"),
                                          F.col("n").alias("n_shingles"), "_key", (F.col("node") == F.col("component")).alias("_first"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the least doc_id stays, of equal ids the one with the least hash.

    Documents without words stay.
    """
    groups = near_groups(docs, **options)
    # An id's first text stays; rows without id are documents by their text.
    one = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("_key"))).orderBy("_key")
    stay = groups.where(F.col("_first") | (F.col("n_shingles") == 0)).withColumn("_at", F.row_number().over(one)).where("_at = 1 or n_shingles = 0")
    stay = stay.select(F.col("doc_id").alias("_llm_stay_id"), F.col("_key").alias("_llm_stay_key")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("_llm_key", F.xxhash64(text))
    out = keyed.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_stay_id")) & (F.col("_llm_key") == F.col("_llm_stay_key")), "left_semi")
    return out.select(*docs.columns)
