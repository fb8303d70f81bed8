"""Near-copy groups: MinHash signatures, a multi-index Hamming join, links confirmed on full shingle sets, connected components.

Words: runs of anything but space and ASCII white space, A-Z lower-cased. A document's set: its distinct runs of five words (fewer words: the whole as one; none: the
empty set, linked with nothing), as 64-bit hashes. Documents with equal sets are one class, named by a 128-bit hash of the set.

Two sets are linked if 100 * intersection >= share * union; share is SHARE for op5 and SHINGLE_SHARE for the pipeline's stage.

Signature: MinHash values of BITS bits, their number, chunks and distance from SHAPES by share. Two sets of similarity s differ in a symbol with probability 1 - s. The signature is
split into chunks; two signatures at a distance of at most `distance` differ in at most distance // chunks symbols of some chunk (pigeonhole), so they share a key made of one of
its ways to leave that many symbols out. With 20 symbols, 4 chunks and distance 11, each class has 40 keys, and a pair at similarity 0.85 is over the distance
with probability 5e-6; with 25, 5 and 14 it has 50 keys, and a pair at 0.80 is over it with probability 1.4e-5. A pair over the distance may still share a key: all chunks
miss with probability 5e-7 and 7e-7.

Classes that share a key form a bucket. No bucket is spelled out in pairs:
1. each class is compared with its bucket's first class (a star), once for each such pair, on the full sets;
2. connected components of the confirmed links are taken;
3. buckets that still hold several components go to workers with their members' sets, which compare all members by a product of membership matrices and return at most a
   spanning forest of links. A bucket over BLOCK members, or sets of over BLOCK_ITEMS shingles, is dealt into blocks, and each pair of blocks is one group of its own, so that groups stay bounded;
4. the components of both kinds of links are the result.
So every pair in a bucket is either confirmed or refused on full sets, or joined through others.

Defined cases: null text, empty text and text of white space have no shingles and are their own component; component_id is null only if all
ids of the component are null; repeated rows are in one class; rows with a null id keep it; kept compares doc_id with component_id, null is not kept unless its component has no id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parts, schema_of

SIZE = 5
SHARE = 85
SHINGLE_SHARE = 80
#: Symbols, chunks and distance by the least share that they are made for.
SHAPES = {85: (20, 4, 11), 80: (25, 5, 14)}
BITS = 32
BLOCK = 2000
BLOCK_ITEMS = 4_000_000
BROADCAST = 2_000_000
#: Word hashes and names of sets that a worker remembers; beyond, they are made again.
CACHE = 200_000

_RANDOM = np.random.default_rng(20)
FACTORS = _RANDOM.integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEEDS = _RANDOM.integers(0, 2**63, max(symbols for symbols, _, _ in SHAPES.values()), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, made as needed."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, words: Words, size: int = SIZE) -> np.ndarray:
    """The sorted set of shingle hashes."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(words) > CACHE:
        words.clear()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(h) < size:
        # Shorter sequences are one item each; their length keeps them apart from runs of five.
        return mixed(np.array([(h * FACTORS[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * FACTORS[k]
    return np.unique(mixed(total))


def shape(share: int) -> tuple[int, int, int]:
    """Symbols, chunks and distance for links of that share or more."""
    fit = [s for s in SHAPES if s <= share]
    if not fit:
        raise ValueError(f"no signature is made for a share of {share}")
    return SHAPES[max(fit)]


def subsets(share: int = SHARE) -> list[tuple[int, ...]]:
    """Places of the symbols of each key: in one chunk, all but the errors that the chunk is allowed."""
    symbols, chunks, distance = shape(share)
    width = symbols // chunks
    return [c for k in range(chunks) for c in combinations(range(k * width, (k + 1) * width), width - distance // chunks)]


def signature(items: np.ndarray, symbols: int) -> np.ndarray:
    """The MinHash values, BITS bits each."""
    return np.array([mixed(items ^ s).min() for s in SEEDS[:symbols]]) >> np.uint64(64 - BITS)


def keys(sig: np.ndarray, places: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.copy()
    for column in places.T:
        h = mixed(h ^ sig[column]) * np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def described(docs: DataFrame, carry: list[str], share: int = SHARE) -> DataFrame:
    """carry columns, _h (name of the class, null for the empty set), _n (size of the set), _t (hash of the text), _keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, places, symbols = Words(), np.array(subsets(share)), shape(share)[0]
        salt = mixed(np.arange(1, len(places) + 1, dtype=np.uint64))
        for batch in parts(batches):
            names, n, out = [], [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                items = shingles(text, words)
                n.append(len(items))
                names.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                out.append(keys(signature(items, symbols), places, salt) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "_h", "_n", "_keys"],
            )

    text = docs["text"].cast("string")
    source = docs.select(*carry, F.xxhash64(text).alias("_t"), text.alias("_text"))
    return source.mapInArrow(run, schema_of(source.schema.fields[:-1], "_h binary, _n bigint, _keys array<bigint>"))


def sets_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """_h, _set for the texts whose hash is in needed(_t): computed again from the text, for these only."""
    text = docs.select(docs["text"].cast("string").alias("_text")).withColumn("_t", F.xxhash64("_text"))
    small = needed.count() <= BROADCAST
    picked = text.join(F.broadcast(needed) if small else needed, "_t", "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, done = Words(), set()
        for batch in parts(batches):
            names, out = [], []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                items = shingles(t, words)
                name = xxhash.xxh3_128_digest(items.tobytes())
                if name not in done:
                    if len(done) < CACHE:
                        done.add(name)
                    names.append(name)
                    out.append(items.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["_h", "_set"])

    return picked.mapInArrow(run, "_h binary, _set array<bigint>").dropDuplicates(["_h"])


def components(links: DataFrame) -> DataFrame:
    """_h, _c: the smallest name in each node's component, by least neighbours and pointer jumps; each round is written."""
    both = checkpointed(links.select(F.col("_a").alias("_h"), F.col("_b").alias("_o")).union(links.select("_b", "_a")).distinct())
    label = checkpointed(both.groupBy("_h").agg(F.min("_o").alias("_c")).select("_h", F.least("_h", "_c").alias("_c")))
    while True:
        near = both.join(label.withColumnRenamed("_h", "_o"), "_o").groupBy("_h").agg(F.min("_c").alias("_m"))
        least = label.join(near, "_h").select("_h", F.least("_c", "_m").alias("_d"), "_c")
        jump = label.select(F.col("_h").alias("_d"), F.col("_c").alias("_e"))
        new = checkpointed(least.join(jump, "_d", "left").select("_h", F.least("_d", F.coalesce("_e", "_d")).alias("_d"), "_c"))
        changed = new.where(F.col("_d") != F.col("_c")).limit(1).count()
        label = new.select("_h", F.col("_d").alias("_c"))
        if not changed:
            return label


def forest(names: list[bytes], groups: list[bytes], sets: list[np.ndarray], share: int = SHARE) -> list[tuple[bytes, bytes]]:
    """Links with 100 * intersection >= share * union that join different groups, as a spanning forest."""
    root = {g: g for g in groups}

    def find(g: bytes) -> bytes:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    out = []
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    # Shingles of one member only are in no intersection.
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[often[column]], place[column[often[column]]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(1, 16_000_000 // len(sets))
    for at in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), min(step, int(often.sum()) - at)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        both += m @ m.T
    for i in range(len(sets)):
        inter = both[i, i + 1 :].astype(np.int64)
        for j in np.flatnonzero(100 * inter >= share * (sizes[i] + sizes[i + 1 :] - inter)) + i + 1:
            a, b = find(groups[i]), find(groups[j])
            if a != b:
                root[a] = b
                out.append((names[i], names[j]))
    return out


def near_copies(docs: DataFrame, carry: list[str], block: int = BLOCK, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """The described rows, and _h, _c of the classes that are linked with another class."""
    rows = checkpointed(described(docs, carry, share))
    whole = rows.where(F.col("_h").isNotNull()).groupBy("_h")
    entries = whole.agg(F.min("_keys").alias("_keys")).select(F.explode("_keys").alias("_key"), "_h")
    # Keys alone are counted first; only entries of shared keys are kept, and a bucket's first class is found among these.
    shared = entries.select("_key").groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1).select("_key")
    sizes = whole.agg(F.min("_t").alias("_t"), F.min("_n").alias("_n"))
    members = checkpointed(entries.join(shared, "_key").join(sizes, "_h").select("_key", "_h", "_t", "_n"))
    sets = checkpointed(sets_of(docs, members.select("_t").distinct()))

    # 1. The star of each bucket; sizes alone refuse many pairs.
    fits = 100 * F.least("_n", "_p._n") >= share * F.greatest("_n", "_p._n")
    pivots = members.groupBy("_key").agg(F.min(F.struct("_h", "_n")).alias("_p"))
    star = members.join(pivots, "_key").where(fits & (F.col("_h") != F.col("_p._h"))).select(F.col("_h").alias("_a"), F.col("_p._h").alias("_b")).distinct()
    with_sets = star.join(sets.select(F.col("_h").alias("_a"), F.col("_set").alias("_x")), "_a").join(sets.select(F.col("_h").alias("_b"), F.col("_set").alias("_y")), "_b")
    inter = F.size(F.array_intersect("_x", "_y"))
    links = checkpointed(with_sets.where(100 * inter >= share * (F.size("_x") + F.size("_y") - inter)).select("_a", "_b"))
    # 2.
    first = components(links)
    # 3. Buckets of several components; of buckets with the same members one is enough.
    grouped = members.join(first, "_h", "left").select("_key", "_h", "_n", F.coalesce("_c", "_h").alias("_c"))
    mixed_up = grouped.groupBy("_key").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_items"), F.sum(F.xxhash64("_h").cast("decimal(38,0)")).alias("_who"))
    mixed_up = mixed_up.where("_lo <> _hi").groupBy("_m", "_who").agg(F.min("_key").alias("_key"), F.min("_items").alias("_items"))
    mixed_up = mixed_up.select("_key", F.ceil(F.greatest(F.col("_m") / block, F.col("_items") / BLOCK_ITEMS)).cast("int").alias("_blocks"))
    dealt = grouped.join(mixed_up, "_key").withColumn("_i", F.pmod(F.xxhash64("_h"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("_key", F.least("_i", "_j").alias("_u"), F.greatest("_i", "_j").alias("_v"), "_h", "_c").join(sets, "_h")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = forest(pdf["_h"].tolist(), pdf["_c"].tolist(), [np.asarray(s) for s in pdf["_set"]], share)
        return pd.DataFrame(found, columns=["_a", "_b"])

    more = dealt.groupBy("_key", "_u", "_v").applyInPandas(compare, "_a binary, _b binary").distinct()
    # 4. Components of the components.
    more = checkpointed(more)
    joined = more.join(first.select(F.col("_h").alias("_a"), F.col("_c").alias("_x")), "_a", "left").join(first.select(F.col("_h").alias("_b"), F.col("_c").alias("_y")), "_b", "left")
    upper = components(joined.select(F.coalesce("_x", "_a").alias("_a"), F.coalesce("_y", "_b").alias("_b")))
    lower = first.union(upper.select("_h", F.col("_h").alias("_c"))).distinct()
    return rows, lower.join(upper.select(F.col("_h").alias("_c"), F.col("_c").alias("_d")), "_c", "left").select("_h", F.coalesce("_d", "_c").alias("_c"))


def with_components(docs: DataFrame, carry: list[str], block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """carry columns (doc_id among them), _t, n_shingles, component_id, _h, _c."""
    rows, linked = near_copies(docs, carry, block, share)
    least = rows.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.min("doc_id").alias("_id"))
    least = least.join(linked, "_h", "left").withColumn("_c", F.coalesce("_c", "_h"))
    smallest = least.groupBy("_c").agg(F.min("_id").alias("component_id"))
    found = least.join(smallest, "_c").select("_h", "_c", "component_id")
    out = rows.join(found, "_h", "left")
    return out.select(*carry, "_t", F.col("_n").alias("n_shingles"), F.when(F.col("_h").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "_h", "_c")


def report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return with_components(docs, ["doc_id"], block).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """docs with one row of each component, that of its smallest id (of repeated rows and ids, one); rows without shingles all stay.

    Only ids and hashes of texts are shuffled; the texts meet the rows to drop, which are fewer, in one anti-join."""
    columns = docs.columns
    # All columns as one, so that none clashes with those made here.
    docs = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = checkpointed(with_components(docs, ["doc_id"], share=share).where(F.col("_h").isNotNull()).select("doc_id", "_t", "_c", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("_kept")))
    gone = found.where(~F.col("_kept")).select("doc_id", "_t")
    several = found.where("_kept").groupBy("_c").agg(F.min("_t").alias("_first"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    again = None
    if several.limit(1).count():
        # An id that stands on several rows of one component: one row of one text stays.
        kept = checkpointed(found.where("_kept").join(several, "_c").select("doc_id", "_t", "_first"))
        again = kept.where(F.col("_t") == F.col("_first")).select("doc_id", "_t").distinct()
        gone = gone.unionByName(kept.select("doc_id", "_t"))
    gone = gone.distinct().select(F.col("doc_id").alias("_id"), F.col("_t").alias("_text"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    text = F.xxhash64(docs["text"])
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_id")) & (text == F.col("_text")), "left_anti")
    if again is None:
        return out.select("_row.*")
    back = docs.join(again.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_text")), docs["doc_id"].eqNullSafe(F.col("_id")) & (text == F.col("_text")))
    return out.unionByName(back.dropDuplicates(["_id", "_text"]).drop("_id", "_text")).select("_row.*")
