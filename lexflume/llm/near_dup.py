"""Near-duplicate records by anchor-point covering.

Fingerprints. Every record gets 128 min-hashes of its distinct word shingles. They form `BLOCKS` fingerprints of two
*wide* symbols (a whole min-hash each) and seven *narrow* ones (one bit of a min-hash each).

Anchors. The covering code of a fingerprint space is the direct sum of the trivial code over the wide symbols (every
value is a codeword, covering radius 0) and the perfect [7,4] Hamming code over the narrow ones (covering radius
1): each fingerprint lies within radius 1 of exactly one anchor, its home. A fingerprint is replicated to every anchor
within the covering radius plus the threshold (1 + 1 = 2), that is to 3.6 anchors on average. Two fingerprints that
agree in the wide symbols and differ in at most one bit then meet for certain at the home of either; most that differ
in two or three bits do too. As wide symbols are drawn from the collection's own shingles, the number of anchors grows
with the collection.

Comparison. At each anchor the records at home are compared with all records there, by one bit of each of 128 min-hashes
(differing bits estimate the similarity). The pairs that stay are compared by three bits of each, and what stays then
is checked exactly on the shingle sets. Both thresholds lie three standard deviations below the similarity asked for.
Records at home are counted first: the comparisons of an anchor with more than SPLIT of them are cut into a grid of
blocks that go to different tasks.

Exact copies are one class from the start, so a hot group of copies is one record to everything between.

What is lost: pairs that meet at no anchor, and the few that a sketch filter rejects. `recall` draws pairs of a given
similarity and puts them through the very same symbols, anchors and filters (symbols of different blocks share
min-hashes, which it takes into account); the tests hold its figures and the recall on made pairs against the promise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflume.functions.arrow import text_slices
from lexflume.functions.words import WordHashes, mix64, shingle_hashes
from lexflume.session import materialize, maybe_broadcast

BLOCKS = 30
WIDE, NARROW = 2, 7
SKETCH_BITS = 128
RADIUS, THRESHOLD = 1, 1
SIGMAS = 3
SPLIT = 2_000
COPY_SALTS = 16


def _popcount(x: int) -> int:
    return bin(x).count("1")


def _anchors_of_words() -> np.ndarray:
    """For each 7-bit word the codewords within RADIUS + THRESHOLD, nearest first, padded with -1."""
    # A word is a codeword if the XOR of the (1-based) places of its one-bits is 0.
    def syndrome(word: int) -> int:
        value = 0
        for place in range(NARROW):
            if word >> place & 1:
                value ^= place + 1
        return value

    code = [w for w in range(1 << NARROW) if syndrome(w) == 0]
    rows = []
    for w in range(1 << NARROW):
        near = sorted((_popcount(w ^ c), c) for c in code if _popcount(w ^ c) <= RADIUS + THRESHOLD)
        assert near[0][0] <= RADIUS, "not a covering code"
        rows.append([c for _, c in near])
    width = max(map(len, rows))
    return np.array([r + [-1] * (width - len(r)) for r in rows], np.int64)


_NEAR = _anchors_of_words()
_SKETCH = ["s0", "s1", "s2", "s3", "s4", "s5"]
_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 1 << 32, SKETCH_BITS, np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SKETCH_BITS, np.uint64).astype(np.uint32)


def recall(similarity: float, asked: float | None = None, draws: int = 20_000, seed: int = 1) -> float:
    """The share of drawn pairs of this similarity that meet at an anchor and pass both filters of `asked` (by default the
    same similarity). A min-hash of a pair is equal with the similarity as probability; bits of unequal ones are random."""
    rng = np.random.default_rng(seed)
    asked = similarity if asked is None else asked
    equal = rng.random((draws, SKETCH_BITS)) < similarity
    unlike = [~equal & (rng.random(equal.shape) < 0.5) for _ in range(4)]
    first = rng.random(equal.shape) < 0.5
    met = np.zeros(draws, bool)
    for block in range(BLOCKS):
        wide, narrow = _symbols(block)
        weights = 1 << np.arange(NARROW)
        a = first[:, narrow] @ weights
        b = (first[:, narrow] ^ unlike[1][:, narrow]) @ weights
        meet = (_NEAR[b] == _NEAR[a][:, :1]).any(axis=1) | (_NEAR[a] == _NEAR[b][:, :1]).any(axis=1)
        met |= equal[:, wide].all(axis=1) & meet
    one = unlike[0].sum(axis=1) <= _most_unlike(asked, 1)
    three = (unlike[0] | unlike[2] | unlike[3]).sum(axis=1) <= _most_unlike(asked, 3)
    return float((met & one & three).mean())


def _symbols(block: int) -> tuple[list[int], list[int]]:
    """The min-hashes of a block's wide and narrow symbols."""
    return [WIDE * block + i for i in range(WIDE)], [(BLOCKS * WIDE + block * NARROW + i) % SKETCH_BITS for i in range(NARROW)]


def _fingerprints(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor keys flat, their offsets, is-home flat, sketches n x 6) of texts that all have shingles.

    Sketch columns: for each half of the 128 min-hashes one bit, then a second, then a third.
    """
    n = len(offsets) - 1
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.empty((SKETCH_BITS, n), np.uint32)
    buffer = np.empty_like(low)
    for k in range(SKETCH_BITS):
        np.multiply(low, _MULTIPLY[k], out=buffer)
        np.add(buffer, _ADD[k], out=buffer)
        least[k] = np.minimum.reduceat(buffer, offsets[:-1])
    ranks = np.arange(SKETCH_BITS, dtype=np.uint64)[:, None] << np.uint64(32)
    mixed = mix64(least.astype(np.uint64) | ranks)
    sketch = np.column_stack([np.ascontiguousarray(np.packbits((mixed >> np.uint64(bit) & np.uint64(1)).astype(np.uint8).T, axis=1)).view(np.int64) for bit in (0, 2, 3)])
    second = (mixed >> np.uint64(1) & np.uint64(1)).astype(np.int64)
    keys, counts, homes = [], [], []
    width = _NEAR.shape[1]
    for b in range(BLOCKS):
        (one, two), narrow = _symbols(b)
        wide = mix64(mixed[one] * np.uint64(0x9E3779B97F4A7C15) + mixed[two] + np.uint64(b))
        word = sum(second[at] << i for i, at in enumerate(narrow))
        near = _NEAR[word]
        keys.append(mix64((wide[:, None] + (near + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
        counts.append(near >= 0)
        homes.append(np.broadcast_to(np.arange(width) == 0, near.shape))
    keep = np.concatenate(counts, axis=1)
    flat = np.concatenate(keys, axis=1)[keep].view(np.int64)
    return flat, np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), np.concatenate(homes, axis=1)[keep], sketch


def _fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows, texts in text_slices(batch):
                shingles, offsets = shingle_hashes(texts, size, hashes)
                some = np.flatnonzero(np.diff(offsets))
                if len(some):
                    flat, bounds, homes, sketch = _fingerprints(shingles, np.append(offsets[some], offsets[-1]))
                    anchors = pa.StructArray.from_arrays([pa.array(flat), pa.array(homes)], ["anchor", "home"])
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(some)), *(pa.array(sketch[:, k]) for k in range(6)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), anchors)],
                        ["id", *_SKETCH, "anchors"],
                    )

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rows, texts in text_slices(batch):
                shingles, offsets = shingle_hashes(texts, size, hashes)
                low = (shingles >> np.uint64(32)).astype(np.uint32)
                sets = [np.unique(low[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _check_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            value = np.empty(len(left))
            for i, (x, y) in enumerate(zip(left, right)):
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                value[i] = shared / (len(a) + len(b) - shared)
            keep = pa.array(np.flatnonzero(value >= similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(value).take(keep)], ["a", "b", "similarity"])

    return run


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, members): near-duplicate pairs of class representatives, and the class of every record.

    links: a, b, similarity (a < b; ids of representatives whose distinct `shingle`-word sets have a Jaccard
    similarity of at least `similarity`). members: id, class_id, n; records of exactly equal text are one class of n
    records, represented by the smallest id.

    Nulls, empty and blank texts, and texts of fewer than `shingle` words have no shingles: they appear in neither
    result. Rows with a null id are ignored. A repeated id must repeat its text. Other columns are not read, so names
    can't clash. Very long texts are processed whole.

    Exact checks compare 32-bit shingle hashes; for sets of n shingles a similarity is off by at most about n / 2^32.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & _shingled("text", shingle))
    kind = base.schema["id"].dataType.simpleString()
    members = materialize(_classes(base.select("id", F.unhex(F.md5("text")).alias("copy"))))
    copies = maybe_broadcast(members.where("id <> class_id").select("id"))
    prints = materialize(base.join(copies, "id", "left_anti").mapInArrow(_fingerprint_batches(shingle), f"id {kind}, {', '.join(c + ' long' for c in _SKETCH)}, anchors array<struct<anchor:long,home:boolean>>"))
    pairs = _met(prints, _most_unlike(similarity, 1))
    for side, name in (("a", "l"), ("b", "r")):
        pairs = pairs.join(prints.select(F.col("id").alias(side), F.struct(*_SKETCH).alias(name)), side)

    def differ(first: int) -> F.Column:
        """Min-hashes of one half that differ in any of their three bits."""
        xors = [F.col(f"l.s{k}").bitwiseXOR(F.col(f"r.s{k}")) for k in (first, first + 2, first + 4)]
        return F.bit_count(xors[0].bitwiseOR(xors[1]).bitwiseOR(xors[2]))

    pairs = materialize(pairs.where(differ(0) + differ(1) <= _most_unlike(similarity, 3)).select("a", "b"))
    named = maybe_broadcast(materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    sets = base.join(named, "id", "left_semi").mapInArrow(_set_batches(shingle), f"id {kind}, shingles binary")
    sets = materialize(sets.where("octet_length(shingles) > 0"))
    both = (
        pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a")
        .join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
        .select("a", "b", "x", "y")
    )
    links = both.mapInArrow(_check_batches(similarity), f"a {kind}, b {kind}, similarity double").distinct()
    return links, members


def _classes(keyed: DataFrame) -> DataFrame:
    """(id, class_id, n) from (id, copy): records of the same copy are a class, named by the smallest id. Only digests of
    several records are joined back, broadcast or, where there are too many, by digest and salt."""
    several = materialize(keyed.distinct().groupBy("copy").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1"))
    small = maybe_broadcast(several)
    if small is several:
        small = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int")).join(small, ["copy", "salt"], "left")
    else:
        joined = keyed.join(small, "copy", "left")
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n")).distinct()


def _met(prints: DataFrame, most_unlike: int) -> DataFrame:
    """(a, b), a < b: the pairs of which one is at home at an anchor of the other, with at most so many unlike bits."""
    at = prints.select("id", "s0", "s1", F.inline("anchors"))
    homes = at.where("home").groupBy("anchor").agg(F.count("*").alias("n"))
    hot = maybe_broadcast(materialize(homes.where(F.col("n") > SPLIT).select("anchor", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))))
    found = None
    if hot.take(1):
        at = at.join(hot, "anchor", "left")
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        grid = at.where("parts IS NOT NULL")
        left = grid.where("home").withColumn("row", own).withColumn("column", every)
        right = grid.withColumn("column", own).withColumn("row", every)
        found = _compared(left, right, ["anchor", "row", "column"], most_unlike)
        at = at.where("parts IS NULL")
    light = _compared(at.where("home"), at, ["anchor"], most_unlike)
    return (light if found is None else light.unionByName(found)).distinct()


def _compared(homes: DataFrame, all_: DataFrame, on: list[str], most_unlike: int) -> DataFrame:
    """(a, b) of the pairs at the same anchor with few unlike bits; pairs that are both at home are taken once."""
    left = homes.select(*on, "id", "s0", "s1").withColumnsRenamed({"id": "a", "s0": "a0", "s1": "a1"})
    right = all_.select(*on, "id", "s0", "s1", "home").withColumnsRenamed({"id": "b", "s0": "b0", "s1": "b1"})
    unlike = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    pairs = left.join(right, on).where((F.col("a") < F.col("b")) | (~F.col("home") & (F.col("a") > F.col("b")))).where(unlike <= most_unlike)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _most_unlike(similarity: float, bits: int) -> int:
    """Of 128 min-hashes, how many may differ in `bits` bits: the expectation at this similarity and SIGMAS standard deviations."""
    p = (1 - similarity) * (1 - 0.5**bits)
    return int(SKETCH_BITS * p + SIGMAS * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _shingled(text_col: str, size: int):
    """Whether the text has at least `size` words; anchored and possessive, so linear in the text."""
    word, gap = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
    return F.lower(text_col).rlike(f"^{gap}*+(?:{word}++{gap}++){{{size - 1}}}{word}")


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records (page_a < page_b) from class links and members: links between members of linked classes and
    within classes. The output is as large as the number of near-duplicate pairs; use the links and members as they
    are where that may be large."""
    several = members.where("n > 1").select("class_id", "id")
    wide = (
        links.select("a", "b")
        .join(several.withColumnsRenamed({"class_id": "a", "id": "x"}), "a", "left")
        .join(several.withColumnsRenamed({"class_id": "b", "id": "y"}), "b", "left")
        .select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    )
    within = several.alias("l").join(several.alias("r"), (F.col("l.class_id") == F.col("r.class_id")) & (F.col("l.id") < F.col("r.id")))
    return wide.unionByName(within.select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))).select(F.least("x", "y").alias("page_a"), F.greatest("x", "y").alias("page_b"))
