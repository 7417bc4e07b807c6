"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

Every document becomes a set of hashed 5-word shingles.  Equal word sequences
form one class, so that copies cost one row each.  Each class gets MinHash
values, cut into bands, and an odd sketch: its MinHash samples folded into a
parity bitmap, where the population count of the XOR of two bitmaps estimates
the similarity of the two sets, the more precisely the higher it is.

Classes that agree in a band are candidates.  A first round takes for each
class the earlier class of highest estimate among all its bands, and confirms
these pairs on the full sets.  In a second round, candidates that are not
connected yet are put into clusters by their estimates alone, with a margin of
four standard deviations.  Within a cluster the full sets of every two members
of different components are compared, block against block, as a matrix
product.  So tight groups take about one confirmation a member, loose ones are
compared in full where they are held, no pair but the merging ones is ever
emitted, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, small_batches
from .components import components, reached

SHINGLE = 5
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch: large against SAMPLES times the share that differs.
BITS = 512
#: Pairs below this estimate are not confirmed: over four standard deviations under 0.75.
LEAST_ESTIMATE = 0.60
#: Members of a bucket whose sketches are compared in one unit, about, and members of a cluster whose sets are.
BLOCK, SETS = 1024, 64
#: Rows of small buckets that share a unit, about, and partners of a class that are confirmed in one group of rows.
SHARED, PARTNERS = 1024, 256
#: Pairs, and shingles, that are held at once.
PIECE, TERMS = 1 << 18, 1 << 13
#: Buckets up to this size share units.
SMALL = 64
_M64 = np.uint64(0xFF51AFD7ED558CCD)
_KNOWN: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M64
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; bytes.lower and bytes.split know ASCII alone, as the definition asks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    if len(_KNOWN) > 100_000:
        _KNOWN.clear()
    known, out = _KNOWN, []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) <= 64:  # so that the memory of what is known is bounded
                known[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes; one for the whole if it is short."""
    if len(h) == 0:
        return h
    with np.errstate(over="ignore"):
        if len(h) < SHINGLE:
            acc = np.uint64(len(h))
            for x in h:
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + x
            return _mix(np.array([acc], dtype=np.uint64))
        n = len(h) - SHINGLE + 1
        acc = np.full(n, np.uint64(SHINGLE), dtype=np.uint64)
        for j in range(SHINGLE):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        return np.unique(_mix(acc))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    return rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def _minima(sets: list[np.ndarray], mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each set (none empty), in bounded pieces."""
    out = np.full((len(sets), SAMPLES), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    owner = np.repeat(np.arange(len(sets)), sizes)
    step = 16384
    for at in range(0, len(flat), step):
        x, o = flat[at : at + step], owner[at : at + step]
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        rows = o[starts]
        for k in range(SAMPLES):
            v = x * mul[k]
            v += add[k]
            v ^= v >> np.uint32(15)
            got = np.minimum.reduceat(v, starts)
            out[rows, k] = np.minimum(out[rows, k], got)
    return out


def _sketches(minima: np.ndarray) -> np.ndarray:
    """Odd sketches as rows of BITS / 64 words."""
    with np.errstate(over="ignore"):
        key = _mix(minima.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    bit = (key % np.uint64(BITS)).astype(np.int64)
    flat = (np.arange(len(minima))[:, None] * BITS + bit).ravel()
    odd = (np.bincount(flat, minlength=len(minima) * BITS) & 1).astype(np.uint8).reshape(len(minima), BITS)
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def estimate(odd_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    left = np.maximum(1 - 2 * odd_bits / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(left)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(minima), BANDS)).copy()
        for r in range(ROWS):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS].astype(np.uint64))
    return acc.view(np.int64)


SIGNATURE = "_id long, n_shingles long, same binary, sketch binary, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mul, add = _constants()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sets, same = [], []
            for text in batch.column(1).to_pylist():
                words = _words(text)
                sets.append(shingle_set(_hashes(words)))
                same.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            full = [i for i, s in enumerate(sets) if len(s)]
            sketch: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            if full:
                minima = _minima([sets[i] for i in full], mul, add)
                for i, s, b in zip(full, _sketches(minima), _band_keys(minima), strict=True):
                    sketch[i], bands[i] = s.tobytes(), b
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(same, pa.binary()),
                    pa.array(sketch, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["_id", "n_shingles", "same", "sketch", "bands"],
            )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)


def _bucket_pairs(key: np.ndarray, sk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (row, earlier row, odd bits) of equal key, in bounded pieces that end with a row; key is sorted."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    first = np.repeat(starts, np.diff(np.r_[starts, n]))
    count = np.arange(n) - first
    upto = np.r_[0, np.cumsum(count)]
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + PIECE, side="right")) - 1)
        c = count[at:end]
        row = np.repeat(np.arange(at, end), c)
        other = np.repeat(first[at:end], c) + np.arange(len(row)) - np.repeat(upto[at:end] - upto[at], c)
        odd = np.zeros(len(row), dtype=np.int64)
        for w in range(sk.shape[1]):
            odd += np.bitwise_count(sk[row, w] ^ sk[other, w])
        yield row, other, odd
        at = end


PAIRS = "a long, b long, est double"


def _best_earlier(t: pa.Table) -> pa.Table:
    """For each member of a bucket, the member of smaller id with the highest estimate, if that suffices."""
    t = t.sort_by([("key", "ascending"), ("id", "ascending")])
    ids = t["id"].to_numpy()
    got = []
    for row, other, odd in _bucket_pairs(t["key"].to_numpy(), _matrix(t["sketch"])):
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat((odd << 40) | other, starts)
            est = estimate(least >> 40)
            ok = est >= LEAST_ESTIMATE
            got.append((ids[(least & ((1 << 40) - 1))[ok]], ids[row[starts][ok]], est[ok]))
    a, b, e = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.array([]),) * 3
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "est": pa.array(e, pa.float64())})


MERGES = "a long, b long"


def _merges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    a, b = reached(a, b)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _alike(t: pa.Table) -> pa.Table:
    """Merges of components by the estimates between members of a bucket, or of two blocks of one."""
    t = t.sort_by([("key", "ascending"), ("id", "ascending")])
    comp, side = t["comp"].to_numpy(), t["side"].to_numpy()
    found = []
    for row, other, odd in _bucket_pairs(t["key"].to_numpy(), _matrix(t["sketch"])):
        ok = (comp[row] != comp[other]) & (side[row] * side[other] <= 0)
        ok[ok] = estimate(odd[ok]) >= LEAST_ESTIMATE
        if ok.any():
            found.append(reached(comp[row[ok]], comp[other[ok]]))
    return _merges(found)


def _compared(t: pa.Table) -> pa.Table:
    """Merges of components by the full sets of the members of a block, or of two blocks."""
    comp, side = t["comp"].to_numpy(), t["side"].to_numpy()
    sets = [shingle_set(_hashes(_words(x))) for x in t["text"].to_pylist()]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    term = np.cumsum(new) - 1
    often = np.bincount(term)[term] > 1  # a shingle of one document is in no intersection
    owner, term = owner[often], term[often]
    term = np.cumsum(np.r_[True, term[1:] != term[:-1]]) - 1 if len(term) else term
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    common = np.zeros((len(left), len(right)))
    for at in range(0, int(term[-1]) + 1 if len(term) else 0, TERMS):
        lo, hi = np.searchsorted(term, [at, at + TERMS])
        m = np.zeros((len(sets), TERMS), dtype=np.float32)
        m[owner[lo:hi], term[lo:hi] - at] = 1
        common += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    close = (100 * common >= 75 * union) & (common > 0) & (comp[left][:, None] != comp[right][None, :])
    i, j = np.nonzero(close)
    return _merges([(comp[left[i]], comp[right[j]])])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full sets have 100 * intersection >= 75 * union."""
    last: tuple[str | None, np.ndarray | None] = (None, None)
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            ta, tb = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            if last[0] is None or ta != last[0]:
                last = (ta, shingle_set(_hashes(_words(ta))))
            sa, sb = last[1], shingle_set(_hashes(_words(tb)))
            common = len(np.intersect1d(sa, sb, assume_unique=True))
            if common and 100 * common >= 75 * (len(sa) + len(sb) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"]
        )


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose _id is among ids (one column), chosen before anything is shuffled where ids are few."""
    asked = cut(ids.toDF("_e").distinct(), "mh-asked")
    return texts.join(broadcast_if_small(asked, 2_000_000, 32 << 20), F.col("_id") == F.col("_e"), "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """pairs (a, b), b different in all, that hold on the full sets; the partners of a class a are dealt out in parts."""
    mine = _texts_of(texts, pairs.select("a").union(pairs.select("b")))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    ta = mine.join(parts, F.col("_id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("_text").alias("ta"))
    tb = mine.select(F.col("_id").alias("b"), F.col("_text").alias("tb"))
    dealt = pairs.join(broadcast_if_small(cut(parts.where("parts > 1"), name + "-many"), 1_000_000), "a", "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    full = dealt.join(tb, "b").join(ta, ["a", "part"]).select("a", "b", "ta", "tb")
    return cut(full.mapInArrow(_confirm, "a long, b long"), name + "-links")


def _within_clusters(clusters: DataFrame, comp: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Merges of components by full comparison within clusters.

    clusters: (id, component) of components; comp: (id, component) of classes.
    Members are put into blocks by component, so that blocks that hold one
    component alone are never compared with each other: a component of more
    than SETS members has blocks of its own, others share blocks, dealt by hash.
    """
    ids = reps.select(F.col("id").alias("rid")).distinct()
    named = ids.join(comp, F.col("rid") == F.col("id"), "left").select("rid", F.coalesce("component", "rid").alias("comp"))
    named = named.join(clusters.select(F.col("id").alias("c"), F.col("component").alias("cluster")), F.col("comp") == F.col("c")).drop("c")
    named = cut(named, "mh-clusters")
    sizes = cut(named.groupBy("cluster", "comp").agg(F.count("*").alias("m")), "mh-sizes")
    large = F.col("m") > SETS
    totals = sizes.groupBy(F.col("cluster").alias("k")).agg(F.ceil(F.sum(F.when(~large, F.col("m")).otherwise(0)) / SETS).alias("few"))
    many = broadcast_if_small(cut(sizes.where(large).select(F.col("comp").alias("c2"), "m"), "mh-large"), 1_000_000)
    totals = broadcast_if_small(cut(totals, "mh-totals"), 1_000_000)
    # Components have ids of their own, so a hash of the component and the part tells the block of a large one.
    own = F.xxhash64("comp", F.pmod(F.xxhash64("rid"), F.ceil(F.col("m") / SETS)))
    placed = named.join(many, F.col("comp") == F.col("c2"), "left").join(totals, F.col("cluster") == F.col("k"))
    placed = placed.withColumn("block", F.when(F.col("m").isNotNull(), own).otherwise(F.pmod(F.xxhash64("comp", F.lit(5)), F.greatest(F.col("few"), F.lit(1)))))
    placed = cut(placed.select("rid", "comp", "cluster", "block"), "mh-placed")
    blocks = placed.groupBy("cluster", "block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    blocks = cut(blocks, "mh-blocks")
    others = blocks.select(F.col("cluster").alias("k"), F.col("block").alias("block2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    torn = (F.col("c0") < F.col("c1")) | (F.col("d0") < F.col("d1")) | (F.col("c0") != F.col("d0"))
    units = blocks.join(others, (F.col("cluster") == F.col("k")) & (F.col("block") <= F.col("block2")) & torn)
    units = cut(units.select("cluster", F.col("block").alias("u0"), F.col("block2").alias("u1")), "mh-units")
    sides = units.select("cluster", "u0", "u1", F.when(F.col("u0") == F.col("u1"), 0).otherwise(-1).alias("side"), F.col("u0").alias("block"))
    sides = sides.union(units.where("u0 < u1").select("cluster", "u0", "u1", F.lit(1), "u1"))
    work = placed.join(sides, ["cluster", "block"])
    mine = _texts_of(texts, placed.select("rid"))
    work = work.join(mine.select(F.col("_id"), F.col("_text").alias("text")), F.col("rid") == F.col("_id"))
    work = work.select("cluster", "u0", "u1", "side", "comp", "text")
    return cut(work.groupBy("cluster", "u0", "u1").applyInArrow(_compared, MERGES), "mh-more")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Ids are of type long, anywhere in its range (others are cast; an id that is
    no number counts as null).  Equal sketches are taken in the order of ids.
    Whole texts of any length count.  Other columns of docs are not looked at,
    whatever their names.  Texts that are null, empty or without words have an
    empty set and are linked with nothing.  Texts of fewer words than a shingle
    are one shingle.  Rows of one id are one node: their links are joined.  A
    null id is linked with nothing, has a null component_id and is kept.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sigs = cut(slim.mapInArrow(_signatures, SIGNATURE), "mh-signatures")
    sets = sigs.where("same is not null and _id is not null")
    classes = cut(sets.groupBy("same").agg(F.min("_id").alias("rep")), "mh-classes")
    # One row for each class; an id that stands for several texts appears with each of them.
    firsts = sets.select("_id", F.col("same").alias("s2"), "sketch", "bands")
    reps = classes.join(firsts, (F.col("rep") == F.col("_id")) & (F.col("same") == F.col("s2")))
    reps = cut(reps.select(F.col("_id").alias("id"), "sketch", "bands").dropDuplicates(["id", "sketch"]), "mh-reps")

    banded = reps.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    shared = cut(shared, "mh-keys")
    members = cut(banded.join(shared, "key").select("key", "id"), "mh-members")
    drawn = reps.select(F.col("id").alias("sid"), "sketch")

    # Small buckets share units; large ones are dealt out over several by a hash of the id.
    counts = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    wide = broadcast_if_small(cut(counts.where(F.col("n") > SMALL), "mh-wide"))
    placed = members.join(wide, "key", "left")
    shared_units = max(1, members.count() // SHARED)
    placed = placed.select(
        F.coalesce(F.when(F.col("n").isNotNull(), F.col("key")), F.pmod(F.xxhash64("key"), F.lit(shared_units))).alias("g"),
        F.coalesce(F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n") / BLOCK)), F.lit(-1)).cast("long").alias("unit"),
        "key",
        "id",
    )
    # The smallest id of a wide bucket joins every unit, so that units hang together.
    heads = placed.where("unit >= 0").select("g", "unit", "key").distinct().join(wide, "key")
    heads = heads.where(F.col("unit") != F.pmod(F.xxhash64("lo", F.lit(3)), F.ceil(F.col("n") / BLOCK)))
    placed = placed.union(heads.select("g", "unit", "key", F.col("lo").alias("id")))
    loaded = placed.join(drawn, F.col("id") == F.col("sid")).drop("sid")
    best = loaded.groupBy("g", "unit").applyInArrow(_best_earlier, PAIRS)
    best = best.groupBy("b").agg(F.max(F.struct("est", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    first = cut(best, "mh-first")

    texts = slim.where("_id is not null")
    links = _confirmed(first, texts, "mh-first")
    comp = cut(components(links), "mh-comp")

    named = members.join(comp.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left")
    named = cut(named.select("key", "id", F.coalesce("component", "id").alias("comp")), "mh-named")
    torn = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"))
    torn = cut(torn.where("c0 < c1").select("key", "n"), "mh-torn")
    open_ = named.join(torn, "key")
    open_rows = torn.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = F.ceil(F.col("n") / BLOCK)
    place = F.pmod(F.xxhash64("id", F.lit(3)), blocks)
    # A unit is a pair of blocks; side tells the one of a member, 0 within one block.
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    open_ = open_.select("key", "n", "id", "comp", place.alias("at"), other.alias("with"))
    small = F.col("n") <= SMALL
    open_ = open_.select(
        F.when(small, F.pmod(F.xxhash64("key"), F.lit(max(1, open_rows // SHARED)))).otherwise(F.col("key")).alias("g"),
        F.when(small, -1).otherwise(F.least("at", "with")).alias("u0"),
        F.greatest("at", "with").alias("u1"),
        F.signum(F.col("at") - F.col("with")).cast("int").alias("side"),
        "key",
        "id",
        "comp",
    )
    loaded = open_.join(drawn, F.col("id") == F.col("sid")).drop("sid")
    alike = cut(loaded.groupBy("g", "u0", "u1").applyInArrow(_alike, MERGES), "mh-alike")
    if not alike.isEmpty():
        more = _within_clusters(components(alike), comp, reps, texts)
        if not more.isEmpty():
            base = comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
            comp = cut(components(base.union(more)), "mh-comp")

    # Ids with several texts tie the classes of these texts together.
    tied = sets.select("_id", "same").distinct().groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_id").alias("tid"))
    tied = cut(tied, "mh-tied")
    if not tied.isEmpty():
        bound = sets.join(tied, F.col("_id") == F.col("tid"), "left_semi").select("_id", "same").distinct()
        extra = bound.join(classes, "same").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
        base = comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
        comp = cut(components(base.union(extra)), "mh-comp")

    out = sigs.select("_id", "n_shingles", "same").join(classes, "same", "left")
    node = F.when(F.col("same").isNull(), F.col("_id")).otherwise(F.coalesce("rep", "_id"))
    out = out.withColumn("_node", node)
    small = broadcast_if_small(comp, 2_000_000, 48 << 20)
    out = out.join(small, F.col("_node") == F.col("id"), "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_node"))
    kept = F.coalesce(F.col("_id") == component, F.lit(True))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"), kept.alias("kept"))
