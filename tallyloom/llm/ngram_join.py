"""Near duplicates: n-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word n-grams. Its parity sketch
is the vector of bits that each element toggles at a place of its own, so the
Hamming distance of two sketches never exceeds the symmetric difference of the
sets. Sets of a and b elements with Jaccard similarity t or more differ in at
most (a + b)(1 - t)/(1 + t) elements.

Joining. Sizes fall in bands that double; a set that may link into the next band
is present there too. In a band the (virtual, one bit for every hash) sketch is
cut into p equal parts, and a part's content is told by the XOR of its elements'
hashes. A link touches at most D parts, so of the parts that are not empty all
but D are equal on either side: with D + l parts each, in the order of the parts,
two linked sets share l of them or more (the pigeonhole, as a prefix filter).
Keys shared by more than ``hot`` sets are hot and give no pairs; a link can only
be lost if all parts shared are hot, thus only between two sets that each have l
hot keys or more. Those are compared in the end, see below. A pair is a candidate
if its sizes allow a link and the keys that it shares, with the hot keys that both
have at most, are l or more.

Verifying. Candidate pairs are first held against the Hamming distance of real
sketches of 2n bits or more (folded to the shorter's length), then the sets are
compared themselves, made again from the two texts. The texts of all classes that
any candidate pair or hot key names are written once, one of each class, and all
rounds read them there; the joins on them are merge joins at every size, so that
what is shuffled follows the input. As components are asked for, first only one pair of each
set is compared, that with its least partner; then the pairs that join two
components. Sets with many hot keys are treated alike: each is compared to the
hot key's least set; where a key's sets are still in several components, first
each set is compared to the nearest (by sketch) of the key's sets elsewhere, then
all pairs that their sketches allow, told once at the least key that they share.

Equal sets are one class throughout, known by a 64-bit hash; copies multiply
nothing. All tables are written to the shared folder; the driver sees counts only.

Defined results: null, empty and wordless texts have the empty set, which links
with nothing; fewer than ``n`` words are one shingle of all of them; rows that
repeat an id are one node; a null id gets the least id of its component, if any;
an empty table gives an empty one. Ids must be whole numbers (others raise an error).
Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as tx
from .components import components
from .scratch import Scratch, partitions

N = 5
#: The threshold in hundredths.
PERCENT = 75
HOT = 32
#: Entries that a bucket takes in at once.
CHUNK = 4 << 20
SMALL_BAND = 64

DIGEST = "key long, id long, n int, set_id long, w0 int, w1 int, sketch binary"
ENTRIES = "bucket int, codes binary, owners binary, sets binary, next binary"
#: kind 0: a pair and how many keys it shares; 1: a hot key, a set, and whether in the next band.
FOUND = "kind int, a long, b long, next int"


# -- sets of one slice of texts ------------------------------------------------


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and len+1 offsets."""
    buf, off = tx.buffers(texts)
    buf = tx.LOWER[buf]
    starts, ends, word_off = tx.words(buf, off, tx.SPACE)
    codes = tx.span_hashes(buf, starts, ends)
    counts = np.diff(word_off)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(at[-1], np.uint64)
    grams = tx.ngram_hashes(codes, n)
    long = counts >= n
    if long.any():
        reps = size[long]
        flat[np.repeat(at[:-1][long] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())] = grams[tx.inside(word_off, n)]
    for i in np.flatnonzero((counts > 0) & ~long):
        flat[at[i]] = tx.ngram_hashes(codes[word_off[i] : word_off[i + 1]], int(counts[i]), salt=int(counts[i]))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][size > 0]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[at]


def set_ids(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tx.mix(flat ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)])
    return tx.mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)


def sketches(flat: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parity bits of every set, 2n of them or more, a power of two from 64."""
    counts = np.diff(off)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * counts, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    place = (tx.mix(flat + np.uint64(0xD6E8FEB86659FD93)) & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], counts)
    packed = np.packbits(np.bincount(place, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def most_differing(a, b, percent: int):
    """Elements in which linked sets of a and b elements differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


class Band:
    """Part keys of every set, in its own band (0) or the next (1)."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, which: int, percent: int):
        counts = np.diff(off).astype(np.int64)
        own = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
        largest = counts * 100 // percent
        band = own + which
        cap = np.int64(1) << band
        self.here = (counts > 0) & ((which == 0) | (largest > (np.int64(1) << own)))
        parts = np.where(cap > SMALL_BAND, cap // 2, 1 << 20)
        self.spare = np.ceil(0.06 * cap).astype(np.int64) + 1
        self.differ = most_differing(counts, np.minimum(cap, largest), percent)
        rows = np.repeat(np.arange(len(counts)), counts)
        chosen = self.here[rows]
        rows, elements = rows[chosen], flat[chosen]
        part = (elements >> np.uint64(32)) * parts[rows].astype(np.uint64) >> np.uint64(32)
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        content = np.bitwise_xor.reduceat(tx.mix(elements + np.uint64(0x8CB92BA72F3D8DD7)), at) if len(at) else np.zeros(0, np.uint64)
        self.rows = rows[at]
        self.filled = np.bincount(self.rows, minlength=len(counts))
        nth = np.arange(len(at)) - np.concatenate([[0], np.cumsum(self.filled)])[self.rows]
        self.codes = tx.mix(content ^ tx.mix(part[at] * np.uint64(64) + band[self.rows].astype(np.uint64)))
        keep = nth < (self.differ + self.spare)[self.rows]
        self.rows, self.codes = self.rows[keep], self.codes[keep]

    def weak_at(self) -> np.ndarray:
        """Hot keys from which on a set's links may be lost."""
        return np.minimum(self.spare, self.filled - self.differ)


# -- tasks ---------------------------------------------------------------------


def _digests(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.let_go()
        for batch in tx.slices(batches, "text"):
            flat, off = shingle_sets(batch.column("text"), n)
            weak = [Band(flat, off, which, percent).weak_at() for which in (0, 1)]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("id"), pa.array(np.diff(off), pa.int32()), pa.array(set_ids(flat, off)),
                pa.array(weak[0], pa.int32()), pa.array(weak[1], pa.int32()), pa.array(sketches(flat, off), pa.binary())], names=["key", "id", "n", "set_id", "w0", "w1", "sketch"])

    return run


def _entries(n: int, percent: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.let_go()
        for batch in tx.slices(batches, "text", 2 * tx.SLICE):
            flat, off = shingle_sets(batch.column("text"), n)
            ids = set_ids(flat, off)
            # Of equal sets in a slice, one sends its keys.
            once = np.zeros(len(ids), bool)
            once[np.unique(ids, return_index=True)[1]] = True
            codes, owners, after = [], [], []
            for which in (0, 1):
                band = Band(flat, off, which, percent)
                keep = once[band.rows]
                codes.append(band.codes[keep])
                owners.append(band.rows[keep])
                after.append(np.full(keep.sum(), which, np.uint8))
            codes, owners, after = map(np.concatenate, (codes, owners, after))
            bucket = (codes >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            bucket, codes, owners, after = bucket[order], codes[order], owners[order], after[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            rows: list[list] = [[], [], [], [], []]
            for a, b in zip(starts, [*starts[1:], len(bucket)]):
                # A bucket gets the ids of the sets that it meets, and numbers into them.
                present, number = np.unique(owners[a:b] * 2 + after[a:b], return_inverse=True)
                kind = np.uint16 if len(present) <= 1 << 16 else np.uint32
                low = (codes[a:b] >> np.uint64(32 - bits)).astype(np.uint32)
                for column, value in zip(rows, (int(bucket[a]), low.tobytes(), number.astype(kind).tobytes(), ids[present // 2].tobytes(), np.packbits(present % 2 == 1).tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "codes", "owners", "sets", "next"])

    return run


class Bucket:
    """Pairs and hot keys of one bucket, chunk by chunk; kept are at most hot + 1 sets of a key."""

    def __init__(self, number: int, hot: int = HOT):
        self.number, self.hot = number, hot
        self.kept = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def take(self, codes: np.ndarray, sets: np.ndarray, after: np.ndarray):
        """(a, b, keys shared) of new pairs; (key, set, next) of memberships of hot keys."""
        old = len(self.kept[0])
        codes, sets, after = (np.concatenate([x, y]) for x, y in zip(self.kept, (codes, sets, after)))
        fresh = np.arange(len(codes)) >= old
        order = np.lexsort((fresh, sets, codes))
        codes, sets, after, fresh = codes[order], sets[order], after[order], fresh[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (sets[1:] != sets[:-1])
        codes, sets, after, fresh = codes[new], sets[new], after[new], fresh[new]
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(codes)))
        group = np.cumsum(first) - 1
        held = np.bincount(group, weights=~fresh, minlength=len(size)) if len(size) else size
        hot = size > self.hot
        pairs_a, pairs_b = [], []
        warm = np.flatnonzero((size > 1) & ~hot)
        inner = np.repeat(start[warm], size[warm]) + (np.arange(size[warm].sum()) - np.repeat(np.cumsum(size[warm]) - size[warm], size[warm]))
        for step in range(1, int(size[warm].max()) if len(warm) else 0):
            i = inner[inner + step < len(codes)]
            i = i[group[i] == group[i + step]]
            i = i[fresh[i] | fresh[i + step]]
            pairs_a.append(sets[i])
            pairs_b.append(sets[i + step])
        told = hot[group] & (fresh | (held <= self.hot)[group]) if len(group) else first
        at = np.flatnonzero(told)
        # A hot key's least set stands for it.
        pivot = sets[start][group[at]]
        pairs_a.append(np.minimum(pivot, sets[at])[pivot != sets[at]])
        pairs_b.append(np.maximum(pivot, sets[at])[pivot != sets[at]])
        nth = np.arange(len(codes)) - start[group] if len(codes) else np.zeros(0, np.int64)
        keep = nth <= self.hot
        self.kept = (codes[keep], sets[keep], after[keep])
        key = codes[at].astype(np.int64) | np.int64(self.number) << np.int64(32)
        one, two = (np.concatenate(x).astype(np.int64) for x in (pairs_a, pairs_b))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)
        pairs = np.stack([one[begin], two[begin], np.diff(np.append(begin, len(one)))], axis=1)
        return pairs, (key, sets[at], after[at])


def _search(hot: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.let_go()
        bucket, waiting, size = None, [], 0

        def flush():
            nonlocal waiting, size
            if not waiting:
                return
            pairs, (key, sets, after) = bucket.take(*(np.concatenate(x) for x in zip(*waiting)))
            waiting, size = [], 0
            for a in range(0, len(pairs), 65536):
                part = pairs[a : a + 65536]
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(part)), pa.int32()), "a": pa.array(part[:, 0]), "b": pa.array(part[:, 1]), "next": pa.array(part[:, 2], pa.int32())})
            for a in range(0, len(key), 65536):
                z = slice(a, a + 65536)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(key[z])), pa.int32()), "a": pa.array(key[z]), "b": pa.array(sets[z]), "next": pa.array(after[z], pa.int32())})

        for batch in batches:
            for number, codes, owners, sets, after in zip(*(batch.column(c).to_pylist() for c in ("bucket", "codes", "owners", "sets", "next"))):
                if bucket is None or bucket.number != number:
                    yield from flush()
                    bucket = Bucket(number, hot)
                codes = np.frombuffer(codes, np.uint32)
                owners = np.frombuffer(owners, np.uint16 if len(owners) == 2 * len(codes) else np.uint32).astype(np.int64)
                sets = np.frombuffer(sets, np.int64)
                after = np.unpackbits(np.frombuffer(after, np.uint8), count=len(sets))
                waiting.append((codes, sets[owners], after[owners]))
                size += len(codes)
                if size >= chunk:
                    yield from flush()
        yield from flush()

    return run


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Distance of two sketches, the longer folded to the length of the shorter."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near(percent: int):
    """Keeps the pairs whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            most = most_differing(na, nb, percent)
            sketch = [[np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("sa", "sb")]
            ok = np.array([hamming(x, y) <= m for x, y, m in zip(*sketch, most)], bool)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def _equal_enough(n: int, percent: int):
    """Keeps the pairs whose texts have similar enough sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "ta"):
            m = batch.num_rows
            flat, off = shingle_sets(pa.concat_arrays([batch.column("ta"), batch.column("tb")]), n)
            ok = []
            for i in range(m):
                both = np.concatenate([flat[off[i] : off[i + 1]], flat[off[m + i] : off[m + i + 1]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            kept = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("a", "b")], names=["a", "b"])

    return run


def _across(percent: int, nearest: bool):
    """Pairs of one hot key's sets in different components that their sketches allow.

    ``nearest``: of each set the nearest other alone. Otherwise all, each pair at
    the least of the hot keys that both have, so that no pair is told twice.
    """

    def run(key, table):
        sets, comp, n = (table.column(c).to_numpy() for c in ("set_id", "component", "n"))
        n = n.astype(np.int64)
        raw = [np.frombuffer(s, np.uint64) for s in table.column("sketch").to_pylist()]
        width = min(map(len, raw))
        folded = []
        for s in raw:
            while len(s) > width:
                s = s[: len(s) // 2] ^ s[len(s) // 2 :]
            folded.append(s)
        order = np.argsort(n, kind="stable")
        sets, comp, n, grid = sets[order], comp[order], n[order], np.stack(folded)[order]
        if not nearest:
            lists = table.column("keys").combine_chunks()
            keys, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            early = keys < key[0].as_py()
            places, column = np.unique(keys[early], return_inverse=True)
            place = np.argsort(order)  # of the rows as they came
            owner = place[np.repeat(np.arange(len(n)), np.diff(at))[early]]
            by_row = np.argsort(owner, kind="stable")
            owner, column = owner[by_row], column[by_row]
            row_at = np.searchsorted(owner, np.arange(len(n) + 1))

        out_a, out_b = [], []
        step = max(1, (1 << 21) // max(1, grid.size))
        for a in range(0, len(n), step):
            z = slice(a, a + step)
            stop = int(np.searchsorted(n, n[z][-1] * 100 // percent, "right"))
            rest = slice(0 if nearest else a, stop)
            apart = np.bitwise_count(grid[z][:, None, :] ^ grid[rest][None, :, :]).sum(axis=2, dtype=np.int64)
            least, most = np.minimum(n[z][:, None], n[rest][None, :]), np.maximum(n[z][:, None], n[rest][None, :])
            near = (apart <= most_differing(least, most, percent)) & (comp[z][:, None] != comp[rest][None, :]) & (least * 100 >= percent * most)
            if nearest:
                i = np.flatnonzero(near.any(axis=1))
                j = np.where(near[i], apart[i], 1 << 60).argmin(axis=1) if len(i) else i
            else:
                i, j = np.nonzero(near)
                i, j = i[i < j], j[i < j]
                if len(i) and len(places):
                    rows, back = np.unique(np.concatenate([a + i, rest.start + j]), return_inverse=True)
                    told = np.zeros(len(i), bool)
                    sets_of = [set(column[row_at[r] : row_at[r + 1]].tolist()) for r in rows.tolist()]
                    for k, (x, y) in enumerate(zip(back[: len(i)].tolist(), back[len(i) :].tolist())):
                        told[k] = not sets_of[x].isdisjoint(sets_of[y])
                    i, j = i[~told], j[~told]
            x, y = sets[a + i], sets[rest.start + j]
            out_a.append(np.minimum(x, y))
            out_b.append(np.maximum(x, y))
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})

    return run


# -- the join ------------------------------------------------------------------


class Join:
    """The steps of the join over one table; ``result`` has them all."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, hot: int = HOT, chunk: int = CHUNK, label: str = "ngram-join"):
        self.spark, self.n, self.percent, self.hot, self.chunk = docs.sparkSession, n, percent, hot, chunk
        self.scratch = Scratch(self.spark, label)
        text = F.col(text_col)
        self.docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("key"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
        self.bits = max(1, (partitions(self.spark) - 1).bit_length())

    def _texts_of(self, wanted: DataFrame) -> DataFrame:
        """set_id and text of the wanted classes (set_id, key), each from its least row."""
        # Rows that repeat an id may have other texts: only those of the class count.
        rows = self.docs.select("key", "text").hint("merge").join(wanted.select("key", F.col("set_id").alias("wanted")), "key")
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tx.slices(batches, "text"):
                ids = set_ids(*shingle_sets(batch.column("text"), n))
                mine = pa.array(ids == batch.column("wanted").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(mine) for c in ("wanted", "text")], names=["set_id", "text"])

        return rows.select("wanted", "text").mapInArrow(run, "set_id long, text string").dropDuplicates(["set_id"])

    def _near(self, found: DataFrame, hot: DataFrame, name: str) -> DataFrame:
        """Pairs that sizes, shared keys and sketches allow."""
        # The keys that linked sets share at least: of a set that is not in the next band too, w1 says nothing.
        least = F.when(F.col("w1") > 0, F.least("w0", "w1")).otherwise(F.col("w0"))
        counts = hot.groupBy("set_id").agg(F.count("*").cast("int").alias("h"))
        sizes = self.sets.select("set_id", "n", least.alias("w")).join(counts, "set_id", "left").fillna(0, ["h"])
        side = lambda df, x, *c: df.select(F.col("set_id").alias(x), *[F.col(k).alias(k + x) for k in c])
        pairs = found.groupBy("a", "b").agg(F.sum("next").alias("c"))
        for x in "ab":
            pairs = pairs.join(side(sizes, x, "n", "w", "h"), x)
        pairs = pairs.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent) & (F.col("c") + F.least("ha", "hb") >= F.least("wa", "wb")))
        pairs = pairs.select("a", "b", "na", "nb")
        for x in "ab":
            pairs = pairs.join(side(self.sets.select("set_id", F.col("sketch").alias("s")), x, "s"), x)
        return self.scratch.keep(pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(self.percent), "a long, b long"), name)

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        text = lambda x: self.texts.select(F.col("set_id").alias(x), F.col("text").alias(f"t{x}")).hint("merge")
        rows = pairs.join(text("a"), "a").join(text("b"), "b")
        return self.scratch.keep(rows.select("a", "b", "ta", "tb").mapInArrow(_equal_enough(self.n, self.percent), "a long, b long"), name)

    @staticmethod
    def _labelled(rows: DataFrame, nodes: DataFrame, column: str, name: str) -> DataFrame:
        labels = nodes.select(F.col("node").alias(column), F.col("component").alias("__c"))
        return rows.join(labels, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Enough verified links between classes to connect all linked ones, and each class's component."""
        s = self.scratch
        digests = s.keep(self.docs.mapInArrow(_digests(self.n, self.percent), DIGEST), "digests")
        self.digests = digests
        self.sets = s.keep(digests.where("n > 0").groupBy("set_id").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.first("sketch").alias("sketch")), "sets")
        entries = self.docs.select("text").mapInArrow(_entries(self.n, self.percent, self.bits), ENTRIES)
        found = s.keep(entries.repartition(partitions(self.spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_search(self.hot, self.chunk), FOUND), "found")

        hot = found.where("kind = 1").select(F.col("a").alias("hot"), F.col("b").alias("set_id"), "next")
        near = self._near(found.where("kind = 0"), hot, "near")
        # Sets with so many hot keys that a link may have no other.
        counts = hot.groupBy("set_id", "next").agg(F.count("*").alias("c")).join(self.sets.select("set_id", "w0", "w1"), "set_id")
        weak = counts.where(F.col("c") >= F.when(F.col("next") == 0, F.col("w0")).otherwise(F.col("w1"))).select("set_id", "next")
        hot = s.keep(hot.join(weak, ["set_id", "next"], "left_semi").select("hot", "set_id"), "hot")
        s.drop("found")
        named = near.select(F.col("a").alias("set_id")).unionAll(near.select(F.col("b").alias("set_id"))).unionAll(hot.select("set_id"))
        wanted = self.sets.select("set_id", "key").join(named.distinct(), "set_id", "left_semi")
        self.texts = s.keep(self._texts_of(wanted), "texts")

        # One pair for each set, to its least partner; then what still joins two components.
        least = near.groupBy("b").agg(F.min("a").alias("a")).unionAll(near.groupBy("a").agg(F.min("b").alias("b")).select("b", "a")).distinct()
        edges = self._verified(least.select("a", "b"), "first")
        nodes = components(edges, s, "first-components")
        rest = self._labelled(self._labelled(near, nodes, "a", "ca"), nodes, "b", "cb").where("ca <> cb").select("a", "b").join(least.select("a", "b"), ["a", "b"], "left_anti")
        rest = s.keep(rest, "rest")
        if not rest.isEmpty():
            edges = s.keep(edges.unionAll(self._verified(rest, "second")), "edges-2")
            nodes = components(edges, s, "second-components")

        done = least.select("a", "b")
        for k, nearest in enumerate((True, False)):
            # First each set's nearest one, which joins most components; then all pairs that are still apart.
            member = self._labelled(hot, nodes, "set_id", "component")
            split = member.groupBy("hot").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("hot")
            open_ = s.keep(member.join(split, "hot"), f"open-{k}")
            if open_.isEmpty():
                break
            sets = self.sets.select("set_id", "n", "sketch")
            if not nearest:  # a pair is told once, at the least hot key that both have; these are at most a set's own keys
                sets = sets.join(open_.groupBy("set_id").agg(F.sort_array(F.collect_set("hot")).alias("keys")), "set_id")
            rows = open_.join(sets, "set_id")
            pairs = rows.groupBy("hot").applyInArrow(_across(self.percent, nearest), "a long, b long").distinct()
            pairs = s.keep(pairs.join(done, ["a", "b"], "left_anti"), f"across-{k}")
            if not pairs.isEmpty():
                edges = s.keep(edges.unionAll(self._verified(pairs, f"third-{k}")), f"edges-3-{k}")
                nodes = components(edges, s, f"third-components-{k}")
                done = done.unionAll(pairs)
        s.drop("near", "rest", "hot", "open-0", "open-1", "across-0", "across-1", "texts", "sets")
        return edges, nodes

    def result(self) -> DataFrame:
        """id, n_shingles and component_id of every row."""
        _, nodes = self.links()
        # Only linked classes need a label; a class alone is its own.
        sets = self._labelled(self.digests.where("n > 0").groupBy("set_id").agg(F.min("id").alias("least")), nodes, "set_id", "component")
        # Rows that repeat an id tie their classes together.
        ids = self.digests.where("n > 0 and id is not null").groupBy("id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a <> b")
        ties = self.digests.where("n > 0").join(ids.select("id"), "id").select("id", F.col("set_id").alias("b")).join(ids.select("id", "a"), "id").where("a <> b").select("a", "b")
        ties = self.scratch.keep(ties, "ties")
        if not ties.isEmpty():
            nodes = components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(ties), self.scratch, "tied-components")
            sets = self._labelled(sets.select("set_id", "least"), nodes, "set_id", "component")
        least = sets.groupBy("component").agg(F.min("least").alias("component_id"))
        sets = sets.join(least, "component").select("set_id", "component_id")
        rows = self.digests.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
        full = rows.where("set_id is not null").join(sets, "set_id").select("id", "n_shingles", "component_id")
        return full.unionAll(rows.where("set_id is null").select("id", "n_shingles", F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles, component_id (the least id that links lead to) of every row."""
    return Join(docs, id_col, text_col, n, percent).result().withColumnRenamed("id", id_col)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
