"""Exact n-gram Jaccard join by parity sketches.

A set's shingle hashes are XORed into the blocks of a parity sketch: equal shingles cancel, so the sketches of two sets
differ in at most as many blocks (and bits) as the sets differ in shingles. Sets of one size band share a block count
with more blocks than linked sets can differ in shingles (pigeonhole), so linked sets agree on whole blocks. If the
blocks of both are put in one order, rarest first, linked sets agree within their first d + 1, where d is the largest
difference a set of that size may have. Rarity is counted over all texts; a block no other set has is never sent on.

Within a block's group every set is first compared with one hub, and the components of these links are found. Only
sets of one group that are still apart are then compared with each other: small groups pair by pair. In large groups
every set is XORed with the hub of a component that most of them belong to. What is left, its difference from the hub,
obeys the same law: if a and b are linked and one of them is not linked with the hub, their differences share elements,
and if the elements are put in one order, rarest first, they share one that stands before the last few; fewer still
need to be looked at on the side that is closer to the hub (see Bands.difference_slack). These elements group the sets
anew, without what the whole group has in common, and the new groups are compared in tiles of bounded bytes.

Candidates are compared by their full sketches first, whose Hamming distance bounds the difference from below, and
survivors are verified on whole shingle sets; a tile returns only links between what is still apart in it. So a group of
thousands of near copies costs rows in proportion to its members, and no link between different texts is lost. Equal
sets are one class throughout.

Hash classes are 64-bit: n distinct sets collide with a chance of about n * n / 2 ** 65.

Edge cases: texts without words (null, empty, blank) have an empty set, link with nothing and are their own component;
repeated rows and copies share a class; an empty table gives an empty result; other columns are not read; a row with a
null id has a component only through the copies and links of its text.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import textkernel as tk
from strandlake.llm.common import bit_filter, documents, materialise, named, passes, shuffle_width
from strandlake.llm.components import connected_components

WORDS = 5
#: Linked when SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (80, 100)
#: Larger groups are compared through a hub.
GROUP = 64
#: About the bytes of sets on either side of a tile.
TILE_BYTES = 8 << 20
#: Bytes of entries one reducer holds, and entries a mapper gathers before it deals them out.
REDUCER_BYTES, MAPPER_ROWS = 48 << 20, 1 << 20
U = tk.U
_BLOCK, _BAND = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)
#: A token of a set: the set's class and size, and how many of its most frequent tokens linked sets need not agree on.
_PLAIN = np.dtype([("token", "<u8"), ("class", "<u8"), ("size", "<u4"), ("slack", "<u4")])
#: The same of a set XORed with a hub: its distance from the hub, and the slack as the closer one of two sets.
_XORED = np.dtype([*_PLAIN.descr, ("hub", "<u8"), ("far", "<i8"), ("closer", "<u4")])


class Bands:
    """Size bands [2**k, 2**(k+1)) with their block counts, for one threshold."""

    def __init__(self, share: tuple[int, int] = SHARE):
        self.num, self.den = share
        if not 2 * self.num >= self.den > self.num > 0:
            raise ValueError("the threshold must be at least 0.5 and below 1")

    def differ(self, size):
        """Most shingles in which a set of this size may differ from a linked one."""
        return (self.den - self.num) * size // self.num

    def blocks(self, band):
        return self.differ(2 ** (band + 1) - 1) * 5 // 4 + 4

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1

    def reaches_down(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a linked set may stand in the band below."""
        return (band > 0) & (-(-self.num * size // self.den) < 2**band)

    def needed(self, size, band):
        return self.differ(np.minimum(size, 2 ** (band + 1) - 1)) + 1

    def difference_slack(self, size: int, hub: int, x: int) -> tuple[int, int, int]:
        """far, slack and closer of a set that differs from its hub in x elements.

        Linked sets a and b differ in at most r (|a| + |b|) elements, r = (den - num) / (den + num), so their differences
        from the hub share at least (f_a + f_b) / 2, where f = x - r |set|; far is f * (den + num). A set is linked with
        the hub just if f <= r |hub|. One of a and b is not, so by the triangle inequality each shares at least
        x - differ(size) of its elements, a linked one more than (x + r (|hub| - size)) / 2, and the one with the smaller
        f (closer) at least f. Of t shared elements one at least is not among a set's last t - 1, the most frequent.
        """
        num, den = self.num, self.den
        far = x * (den + num) - (den - num) * size
        shared = max(1, x - self.differ(size))
        if far <= (den - num) * hub:
            shared = max(shared, (x * (den + num) + (den - num) * (hub - size)) // (2 * (den + num)) + 1)
        return far, shared - 1, max(shared, -(-far // (den + num))) - 1


def _set_sizes(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n)


def class_ids(shingles: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit digest of each row's set, whatever its order; 0 for an empty set."""
    out, size = np.zeros(n, U), _set_sizes(row, n)
    some = np.flatnonzero(size)
    if len(some):
        first = np.searchsorted(row, some)
        out[some] = tk.mix(np.add.reduceat(tk.mix(shingles ^ _BLOCK), first) + size[some].astype(U) * _BAND)
    return out


def block_tokens(shingles: np.ndarray, row: np.ndarray, blocks: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, row) of the blocks that have shingles; blocks and band are given by row. The low 6 bits hold the band."""
    if not len(shingles):
        return np.zeros(0, U), np.zeros(0, np.int64)
    block = ((shingles >> U(32)) * blocks[row].astype(U)) >> U(32)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(tk.mix(shingles), at)
    owner = row[at]
    return _token(parity, block[at], band[owner]), owner


def _token(parity, block, band) -> np.ndarray:
    return (tk.mix(parity + block * _BLOCK + band.astype(U) * _BAND) & ~U(63)) | band.astype(U)


def empty_tokens(shingles: np.ndarray, blocks: int, band: int, wanted: int) -> list[int]:
    """Tokens of the first empty blocks, for the rare set that has too few others."""
    taken = np.unique(((shingles >> U(32)) * U(blocks)) >> U(32)).astype(np.int64)
    free = np.setdiff1d(np.arange(blocks), taken)[:wanted].astype(U)
    return _token(np.zeros(len(free), U), free, np.full(len(free), band)).astype(np.int64).tolist()


def folded_sketch(shingles: np.ndarray) -> np.ndarray:
    """The sketch folded to 16 to 32 bits per shingle: bit (hash mod bits) flips with each shingle."""
    bits = max(64, 16 << int(len(shingles)).bit_length())
    odd = np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two folded sketches; the longer is folded further."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def shingled(batch: pa.RecordBatch, text: str, n: int):
    """(first row, rows, shingles, row) per run of a batch."""
    for first, data, offsets in tk.runs(batch.column(text)):
        sh, row = tk.shingle_sets(data, offsets, n)
        yield first, len(offsets) - 1, sh, row


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def document_classes(rows: DataFrame, n: int, bands: Bands) -> DataFrame:
    """k, class, size, the number of filled blocks, and tokens of the empty blocks it needs."""
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cls, size, blocks, more = [], [], [], []
            for _, count, sh, row in shingled(batch, "t", n):
                s = _set_sizes(row, count)
                band = np.maximum(bands.of(np.maximum(s, 1)), 0)
                down = bands.reaches_down(s, band)
                filled = np.zeros((2, count), np.int64)  # in its own band and the one below
                extra: list[list[int]] = [[] for _ in range(count)]
                for below in (0, 1):
                    b, use = band - below, (down if below else s > 0)
                    mask = use[row]
                    _, owner = block_tokens(sh[mask], row[mask], bands.blocks(np.maximum(b, 0)), b)
                    filled[below] = np.bincount(owner, minlength=count)
                    need = bands.needed(s, b)
                    for r in np.flatnonzero(use & (filled[below] < need)).tolist():
                        extra[r] += empty_tokens(sh[row == r], int(bands.blocks(int(b[r]))), int(b[r]), int(need[r] - filled[below][r]))
                cls.append(_signed(class_ids(sh, row, count)))
                size.append(s)
                blocks.append(filled.sum(0))
                more += extra
            if cls:
                cls, size, blocks = (np.concatenate(x) for x in (cls, size, blocks))
                columns = [batch.column("k"), pa.array(cls, mask=size == 0), pa.array(size), pa.array(blocks), pa.array(more, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "class", "size", "blocks", "empties"])

    return rows.mapInArrow(run, f"k {kind}, class long, size long, blocks long, empties array<long>")


def _entries(kind: np.dtype, **columns) -> np.ndarray:
    e = np.empty(len(columns["token"]), kind)
    for name, values in columns.items():
        e[name] = values
    return e


def _once(e: np.ndarray) -> np.ndarray:
    """Entries by token and class, each once."""
    e = e[np.lexsort((e["class"], e["token"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["class"][1:] != e["class"][:-1])
    return e[new]


def shared_tokens(rows: DataFrame, entries, kind: np.dtype, reducers: int) -> DataFrame:
    """Entries, as longs, whose tokens at least two classes share, and freq, which stops counting at GROUP + 1.

    entries(batch) yields arrays of kind. Mappers deal packed arrays to the reducers, each (token, class) once per mapper
    batch, so copies and very common tokens are merged before they travel.
    """

    def deal(batches):
        held, count = [], 0

        def flush():
            e = _once(np.concatenate(held))
            target = ((e["token"] >> U(32)) * U(reducers)) >> U(32)  # entries are sorted by token, so targets are
            cuts = np.searchsorted(target, np.arange(reducers + 1, dtype=U))
            filled = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([e[cuts[t] : cuts[t + 1]].tobytes() for t in filled], pa.binary())], ["target", "entries"])

        for batch in batches:
            for e in entries(batch):
                held.append(e)
                count += len(e)
                if count > MAPPER_ROWS:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    def gather(batches):
        held = [np.frombuffer(blob.as_buffer(), kind) for batch in batches for blob in batch.column("entries")]
        if not held:
            return
        e = _once(np.concatenate(held))
        del held
        at = np.flatnonzero(np.append(True, e["token"][1:] != e["token"][:-1]))
        sizes = np.diff(np.append(at, len(e)))
        freq = np.repeat(sizes, sizes)
        e, freq = e[freq > 1], np.minimum(freq[freq > 1], GROUP + 1)
        for a in range(0, len(e), 1 << 16):
            part = e[a : a + (1 << 16)]
            columns = [part[name].astype(np.int64) for name in kind.names] + [freq[a : a + (1 << 16)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*kind.names, "freq"])

    dealt = rows.mapInArrow(deal, "target int, entries binary").repartitionById(reducers, "target").select("entries")
    return dealt.mapInArrow(gather, ", ".join(f"{name} long" for name in (*kind.names, "freq")))


def _rarest(shared: DataFrame, *owner) -> DataFrame:
    """Each owner's tokens but for the slack most frequent ones; nth counts from the most frequent one."""
    rank = Window.partitionBy(*owner).orderBy(F.desc("freq"), F.desc("token"))
    return shared.withColumn("nth", F.row_number().over(rank)).where("nth > slack")


def first_blocks(rows: DataFrame, n: int, bands: Bands, reducers: int) -> DataFrame:
    """token, class, size of the rarest blocks of each class and band that linked classes must agree on, if shared."""

    def entries(batch):
        for _, count, sh, row in shingled(batch, "t", n):
            s = _set_sizes(row, count)
            cls, band = class_ids(sh, row, count), np.maximum(bands.of(np.maximum(s, 1)), 0)
            down = bands.reaches_down(s, band)
            for below in (0, 1):
                mask, b = (down if below else s > 0)[row], band - below
                token, owner = block_tokens(sh[mask], row[mask], bands.blocks(np.maximum(b, 0)), b)
                slack = np.maximum(np.bincount(owner, minlength=count) - bands.needed(s, b), 0)
                yield _entries(_PLAIN, token=token, size=s[owner], slack=slack[owner], **{"class": cls[owner]})

    shared = shared_tokens(rows.select("t"), entries, _PLAIN, reducers)
    return _rarest(shared, "class", F.col("token").bitwiseAND(63)).select("token", "class", "size")


def class_sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, shingles (sorted 64-bit hashes) and folded sketch of each wanted class; wanted has class and its rep id.

    A second scan rebuilds only the sets of texts whose id passes the filter; no text is shuffled.
    """
    spark = rows.sparkSession
    hashed = F.xxhash64("k")
    table, bits = bit_filter(wanted.select(F.xxhash64("rep").alias("h")))
    shared_table = spark.sparkContext.broadcast(table)

    def run(batches):
        bit = shared_table.value
        for batch in batches:
            chosen = batch.filter(pa.array(passes(bit, bits, batch.column("h").to_numpy())))
            if not chosen.num_rows:
                continue
            for _, count, sh, row in shingled(chosen, "t", n):
                cls, bounds = _signed(class_ids(sh, row, count)), np.searchsorted(row, np.arange(count + 1))
                sets = [sh[bounds[r] : bounds[r + 1]] for r in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([folded_sketch(x).tobytes() for x in sets], pa.binary())], ["class", "shingles", "sketch"])

    found = rows.select(hashed.alias("h"), "t").mapInArrow(run, "class long, shingles binary, sketch binary")
    return found.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))


def _fits(bands: Bands):
    return (F.least("size_a", "size_b") * bands.den >= F.greatest("size_a", "size_b") * bands.num) & (F.col("a") != F.col("b"))


def _verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sets are linked: sketches first, then whole sets."""
    num, den = bands.num, bands.den
    side = lambda c, what: sets.select(F.col("class").alias(c), F.col(what).alias(f"{what}_{c}"))
    near = pairs.select("a", "b", F.least("size_a", "size_b").alias("smaller")).join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")

    def sketched(batches):
        for batch in batches:
            keep = [
                hamming(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) <= (den - num) * s // num
                for x, y, s in zip(batch.column("sketch_a"), batch.column("sketch_b"), batch.column("smaller").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = near.mapInArrow(sketched, "a long, b long").join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")

    def exact(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), bands) for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.mapInArrow(exact, "a long, b long")


def _to_hubs(members: DataFrame, labels: DataFrame, linked: DataFrame, classes: DataFrame) -> DataFrame:
    """hub, size_hub, class and size, each once: the members of large groups with their group's hub.

    The hub is the set with most links so far in the component that is the most frequent in all large groups, of those in
    this group (any set may be a hub), so the groups of one family name the same one.
    """
    degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    centres = labels.join(degree, "node").groupBy(F.col("component").alias("label")).agg(F.max_by("node", F.struct("degree", "node")).alias("centre"))
    inside = members.select("token", "label").distinct()
    main = inside.join(members.groupBy("label").agg(F.count("*").alias("n")), "label").groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    hubs = main.join(centres, "label", "left").select("token", F.coalesce("centre", "label").alias("hub"))
    pairs = members.select("token", "class", "size").join(hubs, "token").where("class <> hub").select("hub", "class", "size").distinct()
    return pairs.join(classes.select(F.col("class").alias("hub"), F.col("size").alias("size_hub")), "hub")


def _differences(spread: DataFrame, sets: DataFrame, bands: Bands, reducers: int) -> DataFrame:
    """token, class, size, far and probe of the elements in which sets differ from their hub that linked sets share.

    A probe token need not be looked at for partners that are farther from the hub.
    """
    whole = spread.join(sets.select("class", "shingles"), "class").join(sets.select(F.col("class").alias("hub"), F.col("shingles").alias("shingles_hub")), "hub")

    def entries(batch):
        for cls, hub, x, h in zip(*(batch.column(c) for c in ("class", "hub", "shingles", "shingles_hub")), strict=True):
            x, h = np.frombuffer(x.as_buffer(), U), np.frombuffer(h.as_buffer(), U)
            other, hub = np.setxor1d(x, h, assume_unique=True), np.array([hub.as_py()]).view(U)
            far, slack, closer = bands.difference_slack(len(x), len(h), len(other))
            yield _entries(_XORED, token=tk.mix(other ^ tk.mix(hub + _BAND)), size=len(x), slack=slack, hub=hub, far=far, closer=closer, **{"class": np.array([cls.as_py()]).view(U)})

    shared = shared_tokens(whole.select("class", "hub", "shingles", "shingles_hub"), entries, _XORED, reducers)
    return _rarest(shared, "hub", "class").select("token", "class", "size", "far", (F.col("nth") <= F.col("closer")).alias("probe"))


def _linked(x: np.ndarray, y: np.ndarray, bands: Bands) -> bool:
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return bands.den * common >= bands.num * (len(x) + len(y) - common)


def _links_in_tiles(members: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """a, b: links between different components of a group, as many as it takes to unite them tile by tile.

    Members that are no probes meet all members of their group; either side of a tile has about TILE_BYTES of sets.
    """
    num, den = bands.num, bands.den
    tiles = lambda c: F.ceil(F.col(c) * 12 / F.lit(TILE_BYTES)).cast("int")  # noqa: E731  12 bytes an element with its sketch
    known = members.join(sets, "class").withColumn("tiles_a", tiles("size_a")).withColumn("tiles_b", tiles("size_all"))
    hashed, columns = F.xxhash64("class"), ("class", "label", "size", "far", "sketch", "shingles")
    side = lambda a, b, i, j: (F.pmod(hashed, F.col(a)).cast("int").alias(i), F.explode(F.sequence(F.lit(0), F.col(b) - 1)).alias(j))
    left = known.where(~F.col("probe")).select("token", F.lit(True).alias("left"), *side("tiles_a", "tiles_b", "i", "j"), *columns)
    right = known.select("token", F.lit(False).alias("left"), *side("tiles_b", "tiles_a", "j", "i"), *columns)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["left"]], pdf[~pdf["left"]]
        out, up = [], {}

        def root(n: int) -> int:
            while n in up:
                n = up[n]
            return n

        ids, labels, sizes, fars = (y[c].to_numpy() for c in ("class", "label", "size", "far"))
        sketches, sets_y = ([np.frombuffer(s, U) for s in y[c]] for c in ("sketch", "shingles"))
        by_length = {n: np.flatnonzero([len(s) == n for s in sketches]) for n in {len(s) for s in sketches}}
        stacked = {n: np.stack([sketches[i] for i in at]) for n, at in by_length.items()}
        for cls, label, size, far, sketch, shingles in zip(*(x[c] for c in columns), strict=True):
            sketch, shingles = np.frombuffer(sketch, U), np.frombuffer(shingles, U)
            for n, at in by_length.items():
                a, b = sketch, stacked[n]
                while len(a) > n:
                    a = a[: len(a) // 2] ^ a[len(a) // 2 :]
                while b.shape[1] > len(a):
                    b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                small, large = np.minimum(size, sizes[at]), np.maximum(size, sizes[at])
                hit = (labels[at] != label) & (den * small >= num * large) & ((fars[at] > far) | ((fars[at] == far) & (ids[at] > cls)))
                if not hit.any():
                    continue
                passed = np.bitwise_count(a ^ b[hit]).sum(axis=1) <= (den - num) * small[hit] // num
                for k in at[hit][passed].tolist():
                    ends = root(label), root(labels[k])
                    if ends[0] != ends[1] and _linked(shingles, sets_y[k], bands):
                        up[max(ends)] = min(ends)
                        out.append((cls, ids[k]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.unionByName(right).groupBy("token", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """key, n_shingles and component_id (smallest key reachable by links) of every row."""
    spark, bands = df.sparkSession, Bands(share)
    rows = df.select(named(key).alias("k"), named(text).alias("t"))
    per_row = materialise(document_classes(rows, n, bands), "rows")
    classes = per_row.where("size > 0").groupBy("class").agg(F.min("k").alias("rep"), F.min("size").alias("size"), F.first("empties").alias("empties"))
    classes = materialise(classes, "classes")
    tokens = per_row.agg(F.sum("blocks")).first()[0] or 0
    width = shuffle_width(spark)
    reducers = max(width, -(-tokens * _PLAIN.itemsize // REDUCER_BYTES))
    first = first_blocks(rows, n, bands, reducers).unionByName(classes.select(F.explode("empties").alias("token"), "class", "size"))
    first = materialise(first, "blocks")

    # Groups are written, so that Spark can split the partition of a token that very many classes have when it joins.
    groups = first.groupBy("token").agg(F.count("*").alias("m"), F.min("class").alias("hub"), F.min_by("size", "class").alias("size_hub")).where("m > 1")
    groups = materialise(groups, "groups")
    stars = first.join(groups, "token").select(F.col("hub").alias("a"), F.col("size_hub").alias("size_a"), F.col("class").alias("b"), F.col("size").alias("size_b")).where(_fits(bands)).distinct()
    wanted = first.join(groups, "token", "left_semi").select("class").distinct().join(classes.select("class", "rep"), "class")
    sets = materialise(class_sets(rows, materialise(wanted, "wanted"), n), "sets")
    links = [materialise(_verified(stars, sets, bands), "links")]

    def apart(members: DataFrame, *group: str) -> DataFrame:
        """Members of the groups that still hold several components, with their number and elements (of no probes: _a)."""
        found = members.join(labels.withColumnRenamed("node", "class"), "class", "left")
        found = materialise(found.withColumn("label", F.coalesce("component", "class")).drop("component"), "labelled")
        first, size = ~F.col("probe"), F.col("size") + 8
        sums = [F.count("*").alias("m"), F.count_if(first).alias("m_a"), F.sum(size).alias("size_all"), F.sum(F.when(first, size)).alias("size_a")]
        mixed = found.groupBy(*group).agg(*sums, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi and m_a > 0").drop("lo", "hi")
        return found.join(materialise(mixed, "mixed"), list(group))

    def components() -> DataFrame:
        return connected_components(functools.reduce(DataFrame.unionByName, links).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def add(found: DataFrame) -> DataFrame:
        """Components once these links are added."""
        found = materialise(found, "links")
        if found.isEmpty():
            return labels
        links.append(found)
        return components()

    labels = components()
    members = materialise(apart(first.withColumn("probe", F.lit(False)), "token"), "apart")
    few, many = members.where(F.col("m") <= GROUP), members.where(F.col("m") > GROUP)
    left, right = (few.select("token", *(F.col(x).alias(y) for x, y in (("class", c), ("size", f"size_{c}"), ("label", f"label_{c}")))) for c in ("a", "b"))
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))).select("a", "size_a", "b", "size_b")
    to_hubs = materialise(_to_hubs(many, labels, links[0], classes), "hubs")
    pairs = pairs.unionByName(to_hubs.select(F.col("hub").alias("a"), F.col("size_hub").alias("size_a"), F.col("class").alias("b"), F.col("size").alias("size_b")))
    labels = add(_verified(pairs.where(_fits(bands)).distinct(), sets, bands))
    # Small groups are settled; large ones go on by what their members do not have in common with the hub.
    spread = materialise(apart(to_hubs.withColumn("probe", F.lit(False)), "hub").select("hub", "class", "size", "size_hub"), "spread")
    elements = spread.agg(F.sum(F.col("size") + F.col("size_hub"))).first()[0]
    if elements:
        reducers = max(width, -(-elements * _XORED.itemsize // REDUCER_BYTES))
        members = apart(materialise(_differences(spread, sets, bands, reducers), "differences"), "token")
        labels = add(_links_in_tiles(members, sets, bands))

    known = classes.select("class", "rep").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = known.join(smallest, "component").select("class", "component_id")
    out = per_row.select("k", "class", "size").join(of_class, "class", "left")
    return out.select(F.col("k").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


#: Every pair that shares a shingle, counted; components by reachability.
OP5_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), sh as (
  select distinct doc_id, list_aggregate(ws[p:p + 4], 'string_agg', ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as p from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select u, v from common join n nu on nu.doc_id = u join n nv on nv.doc_id = v where 100 * c >= 80 * (nu.n + nv.n - c)
), reach(u, v) as (select doc_id, doc_id from n union select r.u, l.v from reach r join links l on r.v = l.u),
comp as (select u, min(v) as c from reach group by u)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.c, d.doc_id)::bigint as component_id
from documents d left join n on n.doc_id = d.doc_id left join comp on comp.u = d.doc_id
"""
