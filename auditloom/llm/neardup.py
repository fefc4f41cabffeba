"""MinHash near-duplicates with sequential Bayesian verification.

1. Sets. A text's words are lower-cased (A-Z) and hashed; the set holds the 64-bit hashes of its distinct 5-word shingles
   (with fewer words: of the whole sequence). A signature is kept for each set: BANDS * ROWS minima of 16 bits, and EXTRA
   of 8 bits that let the sequential test tell 0.75 from 0.68.
   Texts with equal sets form a class, which has an id of its own; only one text of a class goes on.
2. Candidates. Classes that share a band lie in one bucket. Each is paired with the least of its bucket (partial minima,
   so no bucket is gathered anywhere), which is linear in the bucket's size.
3. Sequential verification. Signatures of a pair are compared BATCH minima at a time; with m of n equal, the posterior of
   the similarity under a uniform prior is Beta(m + 1, n - m + 1). As soon as P(similarity >= threshold) falls below
   `miss`, the pair is pruned.
4. Exact verification. Survivors are confirmed on their full sets: 100 * |A and B| >= 75 * |A or B|.
5. Rest. Buckets whose members are not one component by now are finished exactly: every member outside the component of
   the bucket's least is compared with all members of other components, in blocks of at most BLOCK by BLOCK signatures,
   by the same two verifications. For ROUNDS rounds (one is enough in practice) only the partner whose signature agrees most is verified, which joins
   nearly all members of a group to it; the last round verifies every pair of different components that is left.
   Members of the least's component are not compared with one another again, so a group of copies costs no more than its
   size. No partner and no bucket is capped.
   A bucket in which that would be more than `crowd` comparisons is dealt anew first, by the exact prefix filter: with
   shingles in order of their number in all such buckets, rare ones first, two sets at the threshold share one of the first
   |A| - ceil(0.75 |A|) + 1 of each. So texts that share a template, and little else, meet only where they share a rare shingle.
6. Components by alternating large and small stars on tables of links. A doc_id with several texts links their classes.

A pair at the threshold shares no band with probability (1 - threshold**ROWS)**BANDS, about 5e-8, and is pruned with at
most `miss` a batch. Links, components and sets stay on the executors throughout.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; rows that repeat a
doc_id are one document, linked by each of its texts, and each row reports its own text's set size; a row with a null doc_id is
kept, linked with nothing, its component_id null; very long texts are hashed whole, one at a time; an empty table gives no rows;
further columns are ignored, and `keep_one` hands them on untouched whatever their names.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Seen, WorkDir, column, first_copies, named_texts, row_struct, slices, table, text_bytes, text_id

WORDS = 5
THRESHOLD = 75
BANDS, ROWS = 44, 4
BATCH = 22
#: Further minima, 8 bits each, that only the sequential test reads.
EXTRA, EXTRA_BATCH = 528, 66
MISS = 1e-6
ROUNDS = 1
BLOCK = 512
#: Comparisons within a bucket from which it is dealt anew by the prefix filter.
CROWD = 64_000_000

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, BANDS * ROWS + EXTRA, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, BANDS * ROWS + EXTRA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _rng.integers(0, 2**63, (BANDS, 1), dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row end to end, and n + 1 offsets."""
    n = len(offsets) - 1
    words, _, _, row = K.word_hashes(data, offsets, lower=True)
    grams, at = K.ngram_hashes(words, row, WORDS)
    owner = row[at]
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        extra = [K.mix(K.ngram_hashes(words[first[i] : first[i + 1]], row[first[i] : first[i + 1]], int(count[i]))[0] + np.uint64(count[i])) for i in short]
        grams, owner = np.concatenate([grams, *extra]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


class Signatures:
    """BANDS * ROWS minima of 16 bits and EXTRA of 8 bits for each set, as rows of two matrices."""

    width = 2 * BANDS * ROWS + EXTRA

    def __init__(self, wide: np.ndarray, narrow: np.ndarray):
        self.wide, self.narrow = wide, narrow

    @classmethod
    def of(cls, sets: np.ndarray, at: np.ndarray) -> Signatures:
        """Minima of each non-empty set under as many hash functions; only mixed bits of them are kept."""
        full = np.flatnonzero(np.diff(at))
        low = (sets >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(at) - 1, BANDS * ROWS + EXTRA), np.uint32)
        for k in range(out.shape[1]):
            out[full, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], at[full])
        out *= np.uint32(0x9E3779B1)
        return cls((out[:, : BANDS * ROWS] >> np.uint32(16)).astype(np.uint16), (out[:, BANDS * ROWS :] >> np.uint32(24)).astype(np.uint8))

    @classmethod
    def read(cls, raw: list[bytes]) -> Signatures:
        grid = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), cls.width)
        return cls(np.ascontiguousarray(grid[:, : 2 * BANDS * ROWS]).view(np.uint16), grid[:, 2 * BANDS * ROWS :])

    def rows(self) -> list[bytes]:
        grid = np.concatenate([self.wide.view(np.uint8), self.narrow], axis=1)
        return [x.tobytes() for x in grid]

    def take(self, at) -> Signatures:
        return Signatures(self.wide[at], self.narrow[at])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (rows: documents)."""
    grid = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    packed = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        packed = (packed << np.uint64(16)) | grid[:, :, k]
    return K.mix(packed ^ _BAND.T)


def prune_below(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, least m) after each batch: with fewer than m of n minima equal, the posterior that the similarity reaches the
    threshold is below `miss`. P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)."""
    out, wide = [], BANDS * ROWS
    for n in [*range(BATCH, wide + 1, BATCH), *range(wide + EXTRA_BATCH, wide + EXTRA + 1, EXTRA_BATCH)]:
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def similar_enough(a: Signatures, b: Signatures, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signatures (row by row; one row of `a` goes with all) survive every batch, and their equal minima."""
    one, wide, done = len(a.wide) == 1, BANDS * ROWS, 0
    alive, equal = np.arange(len(b.wide)), np.zeros(len(b.wide), np.int64)
    for n, least in steps:
        x, y, lo, hi = (a.wide, b.wide, done, n) if n <= wide else (a.narrow, b.narrow, done - wide, n - wide)
        equal[alive] += ((x[:, lo:hi] if one else x[alive, lo:hi]) == y[alive, lo:hi]).sum(axis=1)
        alive = alive[equal[alive] >= least]
        done = n
        if not len(alive):
            break
    return alive, equal[alive]


def doc_sets(docs: DataFrame) -> DataFrame:
    """doc_id, tid, n_shingles, two hashes of the set, and its signature."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            for i, j, part, at in slices(data, offsets):
                sets, where = shingle_sets(part, at)
                n, sig = np.diff(where), Signatures.of(sets, where)
                mixed = [np.concatenate([[np.uint64(0)], np.cumsum(K.mix(sets ^ np.uint64(salt)))]) for salt in (0x5BF0_3635, 0x27D4_EB2F_1656_67C5)]
                hashes = [(m[where[1:]] - m[where[:-1]]).view(np.int64) for m in mixed]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, c).slice(i, j - i) for c in ("doc_id", "tid")] + [pa.array(n), pa.array(hashes[0]), pa.array(hashes[1]), pa.array(sig.rows(), pa.binary())],
                    ["doc_id", "tid", "n_shingles", "h1", "h2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid"), "text").mapInArrow(run, "doc_id long, tid binary, n_shingles long, h1 long, h2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, id) for each class and band."""

    def run(batches):
        for batch in batches:
            ids = column(batch, "id").to_numpy(zero_copy_only=False)
            keys = band_keys(Signatures.read(column(batch, "sig").to_pylist()).wide) if len(ids) else np.zeros((0, BANDS), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["bucket", "id"])

    return classes.select("id", "sig").mapInArrow(run, "bucket long, id long")


def _survivors(pairs: DataFrame, classes: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """pairs (a, b) whose signatures pass the sequential test."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep, _ = similar_enough(*(Signatures.read(column(batch, c).to_pylist()) for c in ("sa", "sb")), steps)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    sig = classes.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


#: Partners that one copy of a set is compared with; beyond that, the set is sent again.
FAN = 256


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, work: WorkDir) -> DataFrame:
    """Pairs (a, b) of classes linked on their full sets. pairs is a table; docs: tid, text. Sets are sent to the pairs' first
    ids, and stream past that one's set in sorted partitions; the list of uses is a table, so Spark knows its size."""
    roles = pairs.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / FAN).cast("int"))).alias("salt"), F.col("a"), F.lit(None).cast("long").alias("b"))
    ways = pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / FAN) + 1).cast("int").alias("ways"))
    others = pairs.join(ways, "a").select(F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("salt"), "a", "b")
    wanted = roles.select("id", "salt", "a", "b").unionByName(others)
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("a", "salt", "b")).alias("uses"))  # at most a role for each bucket of a class, and n / FAN as the first of a pair
    wanted = work.cut(wanted.join(classes.select("id", "tid"), "id").select("tid", "uses"), "uses")

    def build(batches):
        schema = pa.schema([("a", pa.int64()), ("salt", pa.int32()), ("b", pa.int64()), ("shingles", pa.binary())])
        seen = Seen()
        for batch in batches:
            batch = batch.filter(seen(column(batch, "tid")))
            uses = column(batch, "uses")
            data, offsets = text_bytes(column(batch, "text"))
            for i, j, part, at in slices(data, offsets):
                sets, where = shingle_sets(part, at)
                out, size = [], 0
                for k in range(i, j):
                    raw = sets[where[k - i] : where[k - i + 1]].tobytes()
                    for u in uses[k].as_py():
                        out.append({"a": u["a"], "salt": u["salt"], "b": u["b"], "shingles": raw})
                        size += len(raw)
                        if size > 16_000_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    def compare(batches):
        now, mine = None, None
        for batch in batches:
            out = {"a": [], "b": []}
            for a, salt, b, raw in zip(*(column(batch, c) for c in ("a", "salt", "b", "shingles"))):
                got = np.frombuffer(raw.as_buffer(), np.uint64)
                if not b.is_valid:
                    now, mine = (a.as_py(), salt.as_py()), got.copy()
                elif now == (a.as_py(), salt.as_py()):
                    at = np.searchsorted(mine, got)
                    both = int((mine[np.minimum(at, len(mine) - 1)] == got).sum()) if len(mine) else 0
                    if 100 * both >= percent * (len(mine) + len(got) - both):
                        out["a"].append(now[0])
                        out["b"].append(b.as_py())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    sets = first_copies(docs).join(wanted.hint("merge"), "tid").select("tid", "text", "uses").mapInArrow(build, "a long, salt int, b long, shingles binary")
    sets = sets.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return sets.mapInArrow(compare, "a long, b long")


def components(links: DataFrame, work: WorkDir) -> DataFrame:
    """(id, root) for every id that has a link, root being the least id of its component. Alternating stars: each round
    leaves a table, and large neighbourhoods are only ever reduced by partial minima and joined back."""
    edges = work.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are tables, so that the joins that follow are plain and a star with many links is split
        least = work.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = work.cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = work.cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, work.cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        work.free(before, least, large, low)
        was, state = state, _digest(edges)
        if state == was:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _sides(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members (bucket, id, least) with their root, and whether that is the root of the bucket's least."""
    root = roots.select("id", "root")
    of = members.join(root, "id", "left").select("bucket", "id", "least", F.coalesce("root", "id").alias("root"))
    head = root.select(F.col("id").alias("least"), F.col("root").alias("head"))
    return of.join(head, "least", "left").select("bucket", "id", "root", (F.col("root") == F.coalesce("head", "least")).alias("main"))


def _sizes(of: DataFrame) -> DataFrame:
    """Members of each unfinished bucket within and outside its first component."""
    return of.groupBy("bucket").agg(F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest")).where("n_rest > 0")


def _prefixes(docs: DataFrame, classes: DataFrame, crowded: DataFrame, percent: int, work: WorkDir) -> DataFrame:
    """(bucket, id, least) of the classes of crowded buckets, dealt by the shingles of their prefixes."""
    ids = crowded.select("id").distinct().join(classes.select("id", "tid"), "id").select("tid", "id")

    def run(batches):
        seen = Seen()
        for batch in batches:
            batch = batch.filter(seen(column(batch, "tid")))
            data, offsets = text_bytes(column(batch, "text"))
            for i, j, part, at in slices(data, offsets):
                sets, where = shingle_sets(part, at)
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), np.diff(where)))), pa.array(sets.view(np.int64))], ["id", "shingle"])

    shingles = work.cut(first_copies(docs).join(work.cut(ids, "crowd").hint("merge"), "tid").select("tid", "id", "text").mapInArrow(run, "id long, shingle long"), "shingles")
    often = work.cut(shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # those that one class alone has come first and meet nothing: they only use up places
    ranked = shingles.join(often, "shingle", "left").groupBy("id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("n", "shingle")))).alias("all"))  # bounded by the text's length
    alone = F.col("size") - F.size("all")
    room = F.greatest(F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone, F.lit(0)).cast("int")
    dealt = work.cut(ranked.select("id", F.explode(F.slice("all", F.lit(1), room)).alias("s")).select(F.col("s.shingle").alias("bucket"), "id"), "prefixes")
    least = dealt.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("bucket", "least")
    return work.cut(dealt.join(work.cut(least, "heads"), "bucket").select("bucket", "id", "least"), "dealt")


def _rest(of: DataFrame, sizes: DataFrame, classes: DataFrame, steps: list[tuple[int, int]], block: int, best: bool, bands: bool = True) -> DataFrame:
    """Pairs (a, b) of different components within a bucket that pass the sequential test; with `best`, for each member
    outside its bucket's first component only the partner whose signature agrees most. bands: buckets are bands."""
    blocks = sizes.select("bucket", *(((F.col(c) + block - 1) / block).cast("int").alias(k) for c, k in (("n_main", "mains"), ("n_rest", "rests"))))
    of = of.join(blocks, "bucket").join(classes.select("id", "sig"), "id")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    of = of.withColumn("own", own)
    # a block of the rest meets every block of the main component, and every block of the rest once
    tasks = F.when(F.col("main"), F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.struct(r.alias("r"), F.col("own").alias("o")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda o: F.struct(F.col("own").alias("r"), o.alias("o"))),
            F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda o: F.struct(F.least("own", o).alias("r"), (F.col("mains") + F.greatest("own", o)).alias("o"))),
        )
    )
    dealt = of.select("bucket", "id", "root", "sig", "main", F.explode(tasks).alias("t")).select("bucket", "t.r", "t.o", "id", "root", "sig", "main")

    def solve(rows: list[dict]):
        rows = list({x["id"]: x for x in rows}.values())
        ids, root, main = (np.array([x[k] for x in rows]) for k in ("id", "root", "main"))
        sig = Signatures.read([x["sig"] for x in rows])
        keys = band_keys(sig.wide)
        bucket = np.int64(rows[0]["bucket"]).view(np.uint64)
        for i in np.flatnonzero(~main):
            js = np.flatnonzero((root != root[i]) & (best | main | (np.arange(len(rows)) > i)))
            # a pair belongs to the first bucket that it shares; both its members are in there, one of them outside the main component
            js = js[keys[i][(keys[js] == keys[i]).argmax(axis=1)] == bucket] if bands else js
            if len(js):
                keep, equal = similar_enough(sig.take([i]), sig.take(js), steps)
                if best and len(keep) > 1:
                    keep = keep[[equal.argmax()]]
                for j in js[keep]:
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(batches):
        now, held = None, []

        def flush():
            got = list(solve(held)) if held else []
            return pa.RecordBatch.from_pydict({"a": [int(x) for x, _ in got], "b": [int(y) for _, y in got]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for batch in batches:
            for x in batch.to_pylist():
                key = (x["bucket"], x["r"], x["o"])
                if key != now:
                    yield flush()
                    now, held = key, []
                held.append(x)
        yield flush()

    return dealt.repartition("bucket", "r", "o").sortWithinPartitions("bucket", "r", "o").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD, miss: float = MISS, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (doc_id = component_id)."""
    work = WorkDir(docs.sparkSession, "neardup")
    steps = prune_below(percent / 100, miss)
    of_set = ["h1", "h2", "n_shingles"]
    sets = work.cut(doc_sets(docs), "sets")
    some = sets.where("n_shingles > 0 and doc_id is not null")
    one = some.groupBy(*of_set).agg(F.min("tid").alias("tid"), F.first("sig").alias("sig"))  # equal sets have equal signatures
    classes = work.cut(one.withColumn("id", F.monotonically_increasing_id()), "classes")
    owned = work.cut(some.select("doc_id", *of_set).join(classes.select("id", *of_set), of_set).select("doc_id", "id"), "owned")
    # texts that share a doc_id are one document
    several = work.cut(owned.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most").select("doc_id", "a"), "several")
    same = owned.join(several, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()

    named = classes.select("id", "sig")
    buckets = _bands(named).groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("bucket", "least")
    members = work.cut(_bands(named).join(work.cut(buckets, "buckets"), "bucket"), "members")
    stars = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    near = work.cut(_survivors(stars, named, steps), "near")
    texts = named_texts(docs)
    links = work.cut(_confirmed(texts, classes, near, percent, work).unionByName(same), "links")
    roots = work.cut(components(links, work), "roots")
    tested = near
    for left in range(ROUNDS, -1, -1):  # rounds of best partners, then one of all pairs that no round has tested
        of = work.cut(_sides(members, roots), "sides")
        sizes = work.cut(_sizes(of), "sizes")
        light = F.col("n_rest") * (F.col("n_main") + F.col("n_rest")) <= crowd
        more = _rest(of, sizes.where(light), classes, steps, block, best=left > 0)
        crowded = sizes.where(~light)
        if not left and crowded.take(1):
            dealt = _prefixes(texts, classes, of.join(crowded.select("bucket"), "bucket"), percent, work)
            again = work.cut(_sides(dealt, roots), "sides")
            more = more.unionByName(_rest(again, work.cut(_sizes(again), "sizes"), classes, steps, block, best=False, bands=False))
        more = work.cut(more.distinct().join(tested, ["a", "b"], "left_anti"), "more")
        work.free(of)
        if not more.take(1):
            continue
        found = work.cut(_confirmed(texts, classes, more, percent, work), "links")
        tested = tested.unionByName(more)
        if found.take(1):
            links = links.unionByName(found)
            roots = work.cut(components(links, work), "roots")
    # a component is named by the least doc_id that any of its classes has
    placed = work.cut(owned.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")), "placed")
    name = work.cut(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    final = work.cut(placed.distinct().join(name, "root").select(F.col("doc_id").alias("_doc"), "component_id"), "final")
    out = sets.select("doc_id", "n_shingles").join(final.hint("merge"), F.col("doc_id") == F.col("_doc"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the least doc_id stays, with all its rows. Documents without
    words and rows without a doc_id stay; an empty table stays empty; columns, whatever their names, are untouched."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(row_struct(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    left = rows.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * n_both >= 75 * (sa.n + sb.n - n_both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
