"""N-gram Jaccard join: candidates share prefix tokens under several global orders; then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, lean, mix64, pieces, table, tidied, without

#: Words of a shingle, and the least similarity of a link as a fraction.
WORDS, LEAST = 4, (85, 100)
#: The same for the pipeline's stage: what counts as a near copy there.
STAGE_WORDS, STAGE_LEAST = 5, (80, 100)
#: Cells of the table of counts that orders the shingles, rare cells first: at least and at most; and the bytes of text for each between.
CELLS, MOST_CELLS, CELL_BYTES = 1 << 20, 1 << 24, 256
_PARTS = 16
#: Global orders: within a level of frequency each has its own pseudo-random sequence.
SEEDS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Buckets of document ids by which the sets of candidates are read.
BUCKETS = 1 << 20
#: Bits for each shared token by which other tokens' rows are told, and bytes of them that are sent at most.
BITS_A_TOKEN, BITS_BYTES = 16, 32 << 20
#: Sets that share a token are paired directly up to so many; larger groups are compared by what sets them apart.
LARGE = 48
_MOST = 120_000
_MIX = [np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Shingler:
    """Sets of shingles as sorted unsigned 64-bit hashes. Words are split at ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int = WORDS):
        self.words, self.seen = words, {}
        self.mix = [mix64(_MIX[k % 4] + np.uint64(k)) | np.uint64(1) for k in range(words)]

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] alone
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(tokens) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), len(tokens))], np.uint64)
        seen = self.seen
        if len(seen) > _MOST:
            seen.clear()
        for t in set(tokens).difference(seen):
            seen[t] = xxhash.xxh3_64_intdigest(t)
        h = np.array([seen[t] for t in tokens], np.uint64)
        n = len(h) - self.words + 1
        with np.errstate(over="ignore"):
            total = h[:n] * self.mix[0]
            for k in range(1, self.words):
                total += h[k : n + k] * self.mix[k]
        return np.unique(mix64(total))


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def _ceil(a, b):
    return -(-a // b)


def _texts(documents: DataFrame) -> DataFrame:
    return lean(documents).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def _table_size(documents: DataFrame) -> int:
    """Cells for these documents: in a table too small for them all cells look alike, and common shingles come first as often as rare ones."""
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MOST_CELLS, max(CELLS, 1 << (size // CELL_BYTES).bit_length()))


def _planes(counts: np.ndarray) -> bytes:
    """The counts bit by bit, lowest bits first: those of high bits are nearly all 0 and take no room once compressed."""
    return b"".join(np.packbits((counts >> k & 1).astype(np.uint8)).tobytes() for k in range(int(counts.max(initial=0)).bit_length()))


def _counts(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, bits in enumerate(np.frombuffer(planes, np.uint8).reshape(-1, n // 8)):
        out += np.unpackbits(bits).astype(np.int64) << k
    return out


def frequency_levels(documents: DataFrame, words: int = WORDS) -> np.ndarray:
    """For each cell of hashes, the number of binary digits of how many documents' shingles fall into it.

    Counts of all documents are summed in two steps over parts of the table, by groups whose size follows
    the number of tasks; the driver gets at most MOST_CELLS small numbers.
    """
    cells = _table_size(documents)
    size = cells // _PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, seen = Shingler(words), np.zeros(cells, np.uint32)
        for batch in batches:
            for b in pieces(batch):
                found = [shingler.of(t) for t in b.column(0).to_pylist()]
                if found:
                    np.add.at(seen, _cells(np.concatenate(found), cells), np.uint32(1))
        if seen.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % 64] * _PARTS, pa.int32()), pa.array(range(_PARTS), pa.int32()), pa.array([_planes(p) for p in np.split(seen, _PARTS)], pa.binary())],
                ["salt", "part", "counts"],
            )

    def add(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                total += _counts(x, size)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([key[-1].as_py()], pa.int32()), pa.array([_planes(total)], pa.binary())], ["salt", "part", "counts"])

    schema = "salt int, part int, counts binary"
    parts = lean(documents).selectExpr("cast(text as string) text").mapInArrow(tidied(count), schema)
    sums = parts.groupBy("salt", "part").applyInArrow(_grouped(add), schema).groupBy("part").applyInArrow(_grouped(add), schema).collect()
    levels = np.zeros(cells, np.uint8)
    for r in sums:
        levels[r.part * size : (r.part + 1) * size] = np.frexp(_counts(r.counts, size).astype(np.float64))[1]
    return levels


def _grouped(add):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _marks(documents: DataFrame, levels: np.ndarray, least: tuple[int, int], words: int) -> DataFrame:
    """(doc_id, n, c1, c2, p1, p2, p3): size and digest of each set, and its prefixes under each order.

    The prefixes come once for each digest and task; equal sets are one class from here on.
    """
    a, b = least
    sent = documents.sparkSession.sparkContext.broadcast(levels)  # at most MOST_CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known, level = Shingler(words), set(), sent.value
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    h = shingler.of(text)
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    c1, c2 = (int(x) - (1 << 63) for x in (d & 0xFFFFFFFFFFFFFFFF, d >> 64))
                    prefixes = [None] * len(SEEDS)
                    if doc is not None and len(h) and d not in known:
                        known.add(d)
                        if len(known) > _MOST:
                            known.clear()
                        top = level[_cells(h, len(level))].astype(np.uint64) << np.uint64(58)
                        keep = len(h) - _ceil(a * len(h), b) + 1
                        for k, seed in enumerate(SEEDS):
                            own = h if not seed else mix64(h ^ np.uint64(seed))
                            first = np.argsort(top | (own >> np.uint64(6)), kind="stable")[:keep]
                            prefixes[k] = h[first].view(np.int64) if not k else own[first].astype(np.uint32).view(np.int32)
                    out.append((doc, len(h), c1, c2, *prefixes))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * (len(SEEDS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n", "c1", "c2", "p1", "p2", "p3"])

    return _texts(documents).mapInArrow(tidied(run), "doc_id bigint, n bigint, c1 bigint, c2 bigint, p1 array<bigint>, p2 array<int>, p3 array<int>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, token, k): how many of the sets of each g hold a token, once for each slice."""
    for batch in batches:
        for p in pieces(batch):
            of: dict[int, list] = {}
            for g, s in zip(p.column("g").to_pylist(), p.column("s").to_pylist(), strict=True):
                of.setdefault(g, []).append(np.frombuffer(s, np.int64))
            for g, sets in of.items():
                token, k = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), g, np.int64)), pa.array(token), pa.array(k.astype(np.int64))], ["g", "token", "k"])


def _up(x: Column, y: int) -> Column:
    """x / y, rounded up, in whole numbers."""
    return F.floor((x + F.lit(y - 1)) / F.lit(y)).cast("bigint")


class Join:
    """The steps of the join; see ngram_components()."""

    def __init__(self, documents: DataFrame, least: tuple[int, int] = LEAST, words: int = WORDS, large: int = LARGE):
        self.documents, self.least, self.words, self.large, self.temporary = documents, least, words, large, []
        self.levels = frequency_levels(documents, words)
        self.marks = self.save(_marks(documents, self.levels, least, words), "ngram-marks")
        marked = F.when(F.col("p1").isNotNull(), F.col("doc_id"))  # v stands for its class: the least of the documents whose prefixes are here
        self.reps = self.save(self.marks.where("doc_id is not null and n > 0").groupBy("c1", "c2").agg(F.min(marked).alias("v"), F.min("doc_id").alias("least")), "ngram-classes")

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        self.temporary.append(Saved(df, tag))
        return self.temporary[-1].df

    def postings(self) -> DataFrame:
        """(token, v, n, pos) of the prefixes under the first order, of tokens that two documents share."""
        marked = self.marks.where("p1 is not null")
        again = marked.select("doc_id", "c1", "c2").join(self.reps, ["c1", "c2"]).where("doc_id <> v").select("doc_id").distinct()  # a class that several tasks met
        own = without(marked, self.save(again, "ngram-again")).select(F.col("doc_id").alias("v"), "n", "p1")
        shared = own.select(F.explode("p1").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
        shared = self.save(shared, "ngram-shared")
        return self.near(own, shared).join(shared, "token", "left_semi")

    def near(self, own: DataFrame, shared: DataFrame) -> DataFrame:
        """(token, v, n, pos) of the prefixes: of all tokens that are shared, and few of the others.

        A bit for each cell of hashes that holds a shared token tells most others where they are, so they aren't
        shuffled. There are about BITS_A_TOKEN bits for each shared token, sent up to BITS_BYTES; else all rows go on.
        """
        bits = 1 << max(10, int(shared.count() * BITS_A_TOKEN).bit_length())
        if bits > 8 * BITS_BYTES:
            return own.select("v", "n", F.posexplode("p1").alias("pos", "token")).select("token", "v", "n", "pos")
        cell = shared.select(F.pmod("token", F.lit(bits)).alias("cell"))
        words = cell.select(F.shiftright("cell", 6).alias("word"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        held = np.zeros(bits >> 6, np.int64)
        for b in words.toArrow().to_batches():  # at most BITS_BYTES / 8 numbers
            held[b.column(0).to_numpy()] = b.column(1).to_numpy()
        sent = own.sparkSession.sparkContext.broadcast(held)

        def probable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in batches:
                for b in pieces(batch):
                    tokens = b.column("p1").flatten().to_numpy()
                    many = np.diff(b.column("p1").offsets.to_numpy())
                    row = np.repeat(np.arange(len(many)), many)
                    cell = tokens & (bits - 1)
                    at = np.flatnonzero((held[cell >> 6] >> (cell & 63)) & 1)
                    first = (np.cumsum(many) - many)[row[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[at]), b.column("v").take(row[at]), b.column("n").take(row[at]), pa.array((at - first).astype(np.int32))], ["token", "v", "n", "pos"])

        return own.mapInArrow(tidied(probable), "token bigint, v bigint, n bigint, pos int")

    def indexed(self, n: Column, pos: Column) -> Column:
        """Whether the smaller set of a linking pair must hold a shared token at such a place at the latest."""
        a, b = self.least
        return pos <= n - _up(n * (2 * a), a + b)

    def may_link(self, nx: Column, px: Column, ny: Column, py: Column) -> Column:
        """Bounds on size, and on what can be shared from the first shared token on."""
        a, b = self.least
        need = _up((nx + ny) * a, a + b)
        return (F.least(nx, ny) * b >= F.greatest(nx, ny) * a) & (F.least(nx - px, ny - py) >= need)

    def orders(self, pairs: DataFrame) -> DataFrame:
        """The pairs that share prefix tokens under every further order."""
        ids = pairs.selectExpr("explode(array(x, y)) v").distinct()
        classes = self.reps.join(ids, "v", "left_semi")
        bucket = F.pmod("c1", F.lit(BUCKETS))
        wanted = classes.select(bucket.alias("bucket")).distinct()  # at most BUCKETS numbers
        marked = self.marks.where("p1 is not null").select("c1", "c2", "p2", "p3", bucket.alias("bucket")).join(F.broadcast(wanted), "bucket", "left_semi")
        own = marked.join(classes, ["c1", "c2"]).select("v", "p2", "p3").dropDuplicates(["v"])
        side = lambda c: own.select(F.col("v").alias(c), F.col("p2").alias(f"{c}2"), F.col("p3").alias(f"{c}3"))
        both = pairs.join(side("x"), "x").join(side("y"), "y")
        return both.where(F.arrays_overlap("x2", "y2") & F.arrays_overlap("x3", "y3")).select("x", "y")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(v, text): the whole text of each v of ids; of several rows of one id, one."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
        wanted = ids.select(F.pmod(F.xxhash64("v"), F.lit(BUCKETS)).alias("bucket")).distinct()
        rows = _texts(self.documents).where("doc_id is not null").withColumn("bucket", bucket).join(F.broadcast(wanted), "bucket", "left_semi")  # at most BUCKETS numbers
        return rows.select(F.col("doc_id").alias("v"), "text").join(ids, "v", "left_semi")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(v, s): the whole set of each v of ids, as sorted hashes."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            for batch in batches:
                for p in pieces(batch):
                    yield pa.RecordBatch.from_arrays([p.column(0), pa.array([shingler.of(t).tobytes() for t in p.column(1).to_pylist()], pa.binary())], ["v", "s"])

        return self.texts(ids).mapInArrow(tidied(run), "v bigint, s binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose whole sets reach the similarity."""
        a, b = self.least
        before = len(self.temporary)
        left = self.save(self.orders(pairs), "ngram-candidates")
        held = self.save(self.texts(left.selectExpr("explode(array(x, y)) v").distinct()), "ngram-texts")
        side = lambda c: held.withColumnsRenamed({"v": c, "text": f"t{c}"})
        words = self.words

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            for batch in batches:
                for p in pieces(batch):
                    ok, x = [], None
                    for v, s, t in zip(p.column("x").to_pylist(), p.column("tx").to_pylist(), p.column("ty").to_pylist(), strict=True):
                        if v != x:  # rows come sorted by x or y, so a centre's set is often the one before
                            x, own = v, shingler.of(s)
                        other = shingler.of(t)
                        shared = len(np.intersect1d(own, other, assume_unique=True))
                        ok.append(shared * b >= a * (len(own) + len(other) - shared))
                    mask = pa.array(ok, pa.bool_())
                    yield pa.RecordBatch.from_arrays([p.column("x").filter(mask), p.column("y").filter(mask)], ["x", "y"])

        links = left.join(side("y"), "y").join(side("x"), "x").select("x", "y", "tx", "ty").mapInArrow(tidied(check), "x bigint, y bigint").distinct()
        links = self.save(links, "ngram-links")
        self.drop(before, 1)
        return links

    def drop(self, first: int, last: int) -> None:
        """Removes the temporary tables from the first on, but for so many last ones."""
        at = len(self.temporary) - last
        for x in self.temporary[first:at]:
            x.drop()
        del self.temporary[first:at]

    def components(self, links: DataFrame) -> DataFrame:
        """(v, c): the least v reachable by links from each v that has one. Labels meet their neighbours', then jump."""
        both = self.save(links.unionByName(links.selectExpr("y as x", "x as y")).distinct(), "ngram-links")
        labels = self.save(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("c")).withColumnRenamed("x", "v"), "ngram-labels")
        while True:
            near = both.join(labels.withColumnsRenamed({"v": "y", "c": "near"}), "y").groupBy("x").agg(F.min("near").alias("near"))
            met = labels.join(near, labels.v == near.x).select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
            far = labels.selectExpr("v as c", "c as far")
            new = self.save(met.join(far, "c", "left").select("v", "old", F.least("c", F.coalesce("far", "c")).alias("c")), "ngram-labels")
            labels = new.select("v", "c")
            if new.where("c < old").isEmpty():
                return labels

    def directly(self, known: DataFrame, own: DataFrame) -> DataFrame:
        """Pairs of different components that share a token within the bounds."""
        known = known.join(own, "v", "left").withColumn("c", F.coalesce("c", "v"))
        small = known.where(self.indexed(F.col("n"), F.col("pos"))).select("token", F.col("v").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("c").alias("cx"))
        large = known.select("token", F.col("v").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("c").alias("cy"))
        apart = (F.col("cx") != F.col("cy")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
        met = small.join(large, (small.token == large.token) & apart & self.may_link(F.col("nx"), F.col("px"), F.col("ny"), F.col("py")))
        return met.selectExpr("least(x, y) x", "greatest(x, y) y")

    def families(self, groups: DataFrame) -> DataFrame:
        """(g, v, n, d, w, home): what sets v apart from the centre of each family g that it is compared in.

        A centre are the tokens that half of some sets hold: first of a group's, then of those that choose it as
        their home, which is the largest one they are like. A group is compared by the centre of the home that
        most of its members have, so that a group in which families meet is told apart by a centre of one of them.
        """
        sets = self.save(self.sets(groups.select("v").distinct()), "ngram-family-sets")
        first = self.save(self.homes(self.differences(groups, sets, self.centres(groups, sets)), groups), "ngram-homes")
        ones = groups.select("v", "n").distinct()
        kept = self.save(ones.join(first, "v").select(F.col("home").alias("g"), "v", "n"), "ngram-kept")
        most = groups.join(first, "v").groupBy("g", "home").count().groupBy("g").agg((-F.max(F.struct("count", (-F.col("home")).alias("h"))).h).alias("by"))
        compared = groups.join(most, "g").select(F.col("by").alias("g"), "v", "n").unionByName(kept).distinct()
        apart = self.save(self.differences(compared, sets, self.centres(kept, sets)), "ngram-apart")
        return apart.join(self.homes(apart, kept), "v")

    def centres(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(g, centre): the tokens that half the members of g hold; at most twice as many as they hold on average."""
        size = members.groupBy("g").agg(F.count("*").alias("size"))
        tokens = members.join(sets, "v").select("g", "s").mapInArrow(tidied(_counted), "g bigint, token bigint, k bigint").groupBy("g", "token").agg(F.sum("k").alias("k"))
        return self.save(tokens.join(size, "g").where("2 * k >= size").groupBy("g").agg(F.collect_list("token").alias("centre")), "ngram-centres")

    def homes(self, apart: DataFrame, members: DataFrame) -> DataFrame:
        """(v, home): of what v is compared in, the g of most members that v differs from by half at most; else the nearest."""
        size = members.groupBy("g").agg(F.count("*").alias("size"))
        near = apart.select("g", "v", F.size("d").alias("far"), (2 * F.size("d") <= F.col("n")).alias("like")).join(size, "g")
        best = F.struct("like", F.when(F.col("like"), F.col("size")).otherwise(-F.col("far")), (-F.col("g")).alias("g"))
        return near.groupBy("v").agg((-F.max(best).g).alias("home"))

    def differences(self, members: DataFrame, sets: DataFrame, centre: DataFrame) -> DataFrame:
        """(g, v, n, d, w): d is the symmetric difference D to the centre of g, rare tokens first.

        Whatever the centre, two sets link exactly if 2 (a + b) |D1 & D2| >= w1 + w2 with w = (a + b) |D| - (b - a) n.
        """
        a, b = self.least
        sent = members.sparkSession.sparkContext.broadcast(self.levels)  # at most MOST_CELLS bytes

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = sent.value
            for batch in batches:
                for p in pieces(batch):
                    out = []
                    for s, c in zip(p.column("s").to_pylist(), p.column("centre").to_pylist(), strict=True):
                        d = np.setxor1d(np.frombuffer(s, np.uint64), np.array(c or [], np.int64).view(np.uint64))
                        top = level[_cells(d, len(level))].astype(np.uint64) << np.uint64(58)
                        out.append(d[np.argsort(top | (d >> np.uint64(6)), kind="stable")].view(np.int64))
                    yield pa.RecordBatch.from_arrays([p.column("g"), p.column("v"), p.column("n"), pa.array(out, pa.list_(pa.int64()))], ["g", "v", "n", "d"])

        found = members.join(sets, "v").join(centre, "g", "left").select("g", "v", "n", "s", "centre").mapInArrow(tidied(apart), "g bigint, v bigint, n bigint, d array<bigint>")
        return found.withColumn("w", F.size("d").cast("bigint") * (a + b) - F.col("n") * (b - a))

    def by_differences(self, apart: DataFrame, centre: DataFrame, own: DataFrame) -> DataFrame:
        """Pairs of different components of a family that share enough of what sets them apart from its centre.

        The member of least w, m, has been compared with all others. If w1 + w2 <= 0, both link with m and are
        in one component. All other pairs that link share a token of their differences, and of the prefixes of these.
        Pairs of one home are compared there alone.
        """
        a, b = self.least
        rows = apart.join(centre, "g").join(own, "v", "left").withColumn("c", F.coalesce("c", "v"))
        cut = lambda need: F.slice("d", 1, F.size("d") + 1 - F.least(F.size("d") + 1, F.greatest(F.lit(1), need)).cast("int"))
        side = lambda v, need: rows.select("g", F.col("v").alias(v), F.col("n").alias(f"n{v}"), F.col("w").alias(f"w{v}"), F.col("c").alias(f"c{v}"), F.col("home").alias(f"h{v}"), F.size("d").alias(f"d{v}"), F.posexplode(cut(need)).alias(f"p{v}", "token"))
        x, y = side("x", _up(F.col("w"), a + b)), side("y", _up(F.col("w") + F.col("wm"), 2 * (a + b)))
        later = (F.col("wx") < F.col("wy")) | ((F.col("wx") == F.col("wy")) & (F.col("x") < F.col("y")))
        sized = F.least("nx", "ny") * b >= F.greatest("nx", "ny") * a
        enough = F.least(F.col("dx") - F.col("px"), F.col("dy") - F.col("py")) * (2 * (a + b)) >= F.col("wx") + F.col("wy")  # from the first shared token on
        here = (F.col("hx") != F.col("hy")) | (F.col("hx") == F.col("g"))
        met = x.join(y, ["g", "token"]).where((F.col("cx") != F.col("cy")) & later & sized & enough & here)
        return met.selectExpr("least(x, y) x", "greatest(x, y) y")

    def run(self) -> DataFrame:
        live = self.save(self.postings(), "ngram-postings")
        #: First each set meets one leader of each token it holds: the one least changed, which joins most of a family of copies.
        leader = live.where(self.indexed(F.col("n"), F.col("pos"))).groupBy("token").agg(F.min(F.struct("pos", "v", "n")).alias("lead"))
        star = live.join(leader, "token").select(F.col("v").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("lead.v").alias("x"), F.col("lead.n").alias("nx"), F.col("lead.pos").alias("px"))
        star = star.where("x <> y").where(self.may_link(F.col("nx"), F.col("px"), F.col("ny"), F.col("py")))
        star = self.save(star.selectExpr("least(x, y) x", "greatest(x, y) y").distinct(), "ngram-star")
        links = self.verified(star)
        own = self.components(links)
        #: Then all pairs that these links leave apart: those of large groups by their differences, others directly.
        known = live.join(own, "v", "left").withColumn("c", F.coalesce("c", "v"))
        open_ = known.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("size"), F.min("v").alias("g")).where("a < b").select("token", "size", "g")
        known = self.save(known.join(open_, "token").select("token", "v", "n", "pos", "size", "g"), "ngram-open")
        groups = self.save(known.where(F.col("size") > self.large).select("g", "v", "n").distinct(), "ngram-groups")
        tried, met = star, None
        if not groups.isEmpty():
            before = len(self.temporary)
            apart = self.save(self.families(groups), "ngram-differences")
            self.drop(before, 1)
            centre = apart.groupBy("g").agg(F.min(F.struct("w", "v")).alias("m")).select("g", F.col("m.w").alias("wm"), F.col("m.v").alias("m"))
            spokes = apart.join(centre, "g").where("v <> m").selectExpr("least(v, m) x", "greatest(v, m) y").distinct()
            spokes = self.save(spokes.join(star, ["x", "y"], "left_anti"), "ngram-spokes")
            tried = star.unionByName(spokes)
            links = links.unionByName(self.verified(spokes))
            own = self.components(links)
            met = self.by_differences(apart, centre, own)
        direct = self.directly(known.where(F.col("size") <= self.large), own)
        rest = (direct if met is None else direct.unionByName(met)).distinct().join(tried, ["x", "y"], "left_anti")
        more = self.verified(self.save(rest, "ngram-rest"))
        self.links = links.unionByName(more)
        final = own if more.isEmpty() else self.components(self.links)
        return self.save(final, "ngram-components")


def ngram_components(documents: DataFrame, *, least: tuple[int, int] = LEAST, words: int = WORDS, large: int = LARGE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document.

    A document's set are its distinct shingles of so many words (all its words as one shingle if it has
    fewer). Two documents link when least[1] * intersection >= least[0] * union; component_id is the
    smallest doc_id reachable by links.

    Equal sets become one class by a 128-bit digest. Every class's shingles are put in several global
    orders, rare ones first, by counts over all documents. A linking pair shares a token in its prefixes
    under each order: pairs come from the postings of the first order, within bounds of size and position,
    must share tokens in the prefixes of all others, and are then verified over whole sets. Pairs that
    earlier links already join aren't made, so a family of copies costs about one pair for each member.
    Members of large families that don't link are told apart by their differences from the family's centre:
    only those that share some of these differences become pairs. `large` decides which way a group goes,
    never what is found.

    Null and empty texts, and those of white space alone, have 0 shingles and link with nothing. A row
    without doc_id takes no part; its component_id is null. Rows of one doc_id are one document. Very long
    texts count whole; ties go to the smallest doc_id; empty tables give no rows; other columns are not read.
    """
    join = Join(documents, least, words, large)
    found = join.run()
    classes = join.reps.join(found, "v", "left").select("c1", "c2", "least", F.coalesce("c", "v").alias("component"))
    names = classes.groupBy("component").agg(F.min("least").alias("c"))
    classes = classes.join(names, "component").select("c1", "c2", "c")
    out = join.marks.select("doc_id", "n", "c1", "c2").join(classes, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("c"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("bigint").alias("component_id"))
    kept = Saved(result, "ngram-result").df
    for x in join.temporary:
        x.drop()
    return kept


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
u AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (STAGE_WORDS, STAGE_LEAST): the one with the smallest doc_id. Rows without doc_id stay."""
    gone = ngram_components(docs, words=STAGE_WORDS, least=STAGE_LEAST).where("component_id <> doc_id").select("doc_id").distinct()
    return without(docs, gone)
