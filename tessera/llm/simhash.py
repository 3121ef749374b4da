"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within ``radius / 2`` bits of both.
So every distinct fingerprint takes all its variants in that ball (2,081 for 64 bits and
radius 4), variants are shuffled, and fingerprints that meet at a variant are candidates.

The shuffle is on a code of the variant: bit j of the code is the parity of the bits j, j + k,
j + 2k, ... of the variant, so one flip changes one code bit, and a fingerprint's variants go
to the few parts whose code differs from its own by half the radius at most. The rows that carry
one fingerprint's variants to one part are folded into one row, from which the reducer rebuilds
them: the same variants meet in the same place, each made once. The number of parts follows
from what a part holds, so that its memory has a bound whatever the number of fingerprints.

Similar texts whose fingerprints are farther apart than any such radius are found by the same
means with several short fingerprints (``similar_documents``).
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, connected_components, materialize, numbered, sketched, small

SEED = 42
BITS = 64
#: Fingerprints that a part holds at most, copies of those at home in other parts included.
PART_VALUES = 1 << 22
LEAST_CODE_BITS = 6
#: Variants that a reducer holds at once.
ROUND_VARIANTS = 1 << 20
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included.

    A text of fewer words is one shingle; a null text or one without words has fingerprint 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n], ends[min(words, len(parts)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        spans = zip(first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        hashes = b"".join([digest(whole[i:j], SEED) for i, j in spans])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, row, fp): the fingerprint of each row as a signed long, and a number of the row. Other columns aren't read."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "row", "fp"])

    return source.mapInArrow(run, "id long, row long, fp long")


def flips(radius: int, width: int = BITS) -> np.ndarray:
    """Every mask of at most so many of the lowest width bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in itertools.combinations(range(width), k)], np.uint64)


def ball(radius: int, width: int) -> int:
    """The number of those masks."""
    return sum(math.comb(width, k) for k in range(radius + 1))


def code_masks(bits: int, width: int = BITS) -> np.ndarray:
    """One mask for each bit of the code; the code's bit is the parity of the masked fingerprint. No bit is in two masks."""
    return np.array([sum(1 << b for b in range(j, width, bits)) for j in range(bits)], np.uint64)


def round_masks(bits: int) -> np.ndarray:
    """Masks of a second code, which deals a part's variants to rounds."""
    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, 48, dtype=np.uint64)[:bits]


def code(values: np.ndarray, masks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for j, mask in enumerate(masks):
        out |= (np.bitwise_count(values & mask) & 1).astype(np.int64) << j
    return out


def enough_bits(n: int, radius: int, width: int, least: int) -> int:
    """Bits of the code with which a part holds at most PART_VALUES of n fingerprints: each goes to the parts of a ball."""
    return next((k for k in range(least, width) if n * ball(radius // 2, k) <= PART_VALUES << k), width)


def stars(place: np.ndarray, own: np.ndarray, near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of positions that share a place (sorted by place, then position): each place's first with all near it.

    Those that aren't near their first go on among themselves until no place has two of them.
    """
    pairs = []
    while len(place):
        lead = np.concatenate(([True], place[1:] != place[:-1]))
        hub = own[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        good = ~lead
        good[good] = near(hub[good], own[good])
        pairs.append((hub[good], own[good]))
        rest = ~lead & ~good
        place, own = place[rest], own[rest]
        alone = np.concatenate(([True], place[1:] != place[:-1])) & np.concatenate((place[1:] != place[:-1], [True])) if len(place) else np.zeros(0, bool)
        place, own = place[~alone], own[~alone]
    return pairs


def meet(values: np.ndarray, part: int, part_bits: int, radius: int, width: int = BITS, near=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in values (fingerprints) that meet at a variant of this part, verified.

    Fingerprints that share a variant get a star around the first of them, not all pairs: two
    that meet are within the radius, as each is within half of it of the variant. near(a, b)
    tells which of the pairs may be similar, if that is more than to be within the radius.
    """
    errors = flips(radius // 2, width)
    extra = 0
    while len(values) * len(errors) >> (part_bits + extra) > ROUND_VARIANTS and extra < 24:
        extra += 1
    masks = np.concatenate((code_masks(part_bits, width), round_masks(extra)))
    of_error, of_value = code(errors, masks), code(values, masks)
    by_error, by_value = np.argsort(of_error, kind="stable"), np.argsort(of_value, kind="stable")
    errors, of_error = errors[by_error], of_error[by_error]
    keys, begins = np.unique(of_value[by_value], return_index=True)
    groups = list(zip(keys.tolist(), np.split(by_value, begins[1:]), strict=True)) if len(values) else []
    within = lambda a, b: np.bitwise_count(values[a] ^ values[b]) <= radius
    pairs: list[np.ndarray] = []
    for more in range(1 << extra):
        target = part | more << part_bits
        made, owners = [], []
        low = np.searchsorted(of_error, keys ^ target, "left")
        high = np.searchsorted(of_error, keys ^ target, "right")
        for (_, own), i, j in zip(groups, low.tolist(), high.tolist(), strict=True):
            if j > i:
                made.append((values[own][:, None] ^ errors[i:j][None, :]).ravel())
                owners.append(np.repeat(own.astype(np.int32), j - i))
        if not made:
            continue
        variants, owner = np.concatenate(made), np.concatenate(owners)
        ordered = np.sort(variants)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        # A table of hashes lets most variants pass by cheaply; the search after it is exact.
        spread, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 20)
        table = np.zeros(1 << 20, bool)
        table[(shared * spread) >> shift] = True
        hit = np.flatnonzero(table[(variants * spread) >> shift])
        place = np.minimum(np.searchsorted(shared, variants[hit]), len(shared) - 1)
        same = shared[place] == variants[hit]
        own, place = owner[hit[same]], place[same]
        order = np.lexsort((own, place))
        found = stars(place[order], own[order].astype(np.int64), near or within)
        pairs += [np.unique(a * len(values) + b) for a, b in found]
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.divmod(np.unique(np.concatenate(pairs)), len(values))
    good = within(a, b)
    return a[good], b[good]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the pairs connect it with."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, above := root[root]):
            root = above


def dealt(prints: DataFrame, value: str, part_bits: int, radius: int, width: int = BITS) -> DataFrame:
    """prints with column part, a row for each part that holds a variant of the value."""
    masks = code_masks(part_bits, width)
    reach = flips(radius // 2, part_bits).astype(np.int64).tolist()
    own = F.lit(0)
    for j, mask in enumerate(masks.view(np.int64).tolist()):
        own = own.bitwiseOR(F.shiftleft(F.bit_count(F.col(value).bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), j))
    sent = prints.select("*", own.alias("own_"), F.explode(F.array(*(F.lit(x).cast("int") for x in reach))).alias("step_"))
    return sent.withColumn("part", F.col("own_").bitwiseXOR(F.col("step_"))).drop("own_", "step_")


def columns(batches) -> list[np.ndarray]:
    """The columns of all batches."""
    some = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in some]) for i in range(some[0].num_columns)] if some else []


def links(prints: DataFrame, radius: int = 4, least_bits: int = LEAST_CODE_BITS) -> DataFrame:
    """(a, b): links that connect the distinct values of column fp wherever a chain of fingerprints within the radius does.

    Every link is between two fingerprints of one component, at most one for each fingerprint
    and part; the pairs under them are verified bit by bit. A part is one task's, and holds
    PART_VALUES fingerprints at most if the code deals them evenly.
    """
    if radius % 2:
        raise ValueError("the radius must be even: both sides go half of it")
    part_bits = enough_bits(prints.count(), radius, BITS, least_bits)
    sent = dealt(prints.select("fp"), "fp", part_bits, radius).select("part", "fp")

    def run(batches):
        found = columns(batches)
        if found:
            # repartitionById gives each part a task of its own.
            key, values = int(found[0][0]), np.sort(found[1]).view(np.uint64)
            root = forest(len(values), *meet(values, key, part_bits, radius))
            child = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[root[child]].view(np.int64)), pa.array(values[child].view(np.int64))], names=["a", "b"])

    return sent.repartitionById(1 << part_bits, F.col("part")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, row, fingerprint, component_id, kept): each row with its component. An empty table gives no rows.

    component_id is the smallest id that links of at most ``radius`` differing bits reach.
    kept marks one row of each component: one with that id. Null and empty texts have
    fingerprint zero, linked like any other. Null ids come last; a component of null ids only
    has a null component_id. Repeated rows stay, all in one component. row only tells the rows
    of this result apart. Extra columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    prints = materialize(rows.groupBy("fp").agg(first.alias("least")), "prints")
    roots = connected_components(links(prints, radius))
    led = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    led = materialize(led, "roots")
    named = led.groupBy("root").agg(F.min("least").alias("least"))
    classes = led.select("fp", "root").join(named, "root").select(F.col("fp").alias("fp_"), "least")
    joined = rows.join(classes, F.col("fp") == F.col("fp_"))
    return joined.select("id", "row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))


# --- similar texts: several short fingerprints of shingle sets, then the sets themselves ----------

#: Least bits of a short fingerprint, their radius, and fingerprints at that width.
WIDTH, RADIUS, COPIES = 32, 4, 24
#: Chance fellows that a fingerprint may meet; a longer one meets fewer.
FELLOWS = 4.0
#: Of 128 other bits of two texts that meet, so many may differ. At similarity 0.8 some 19 do, 46 with a chance of 1e-9.
CHECK_BITS, CHECK_MOST = 128, 46
#: Texts and shingles of a block of texts whose sets are compared with those of another block.
BLOCK_TEXTS, BLOCK_SHINGLES, CELLS = 2048, 1 << 20, 1 << 21
#: Shingles and texts that are signed at once, rows of a segment, segments of a batch.
SIGNED, SIGNED_TEXTS, SEGMENT, SEGMENTS = 1 << 18, 2048, 256, 128
#: Words whose hashes a task keeps.
KNOWN_WORDS = 1 << 18
#: Rows of fingerprints that a text sends to parts at once; with more of them fingerprints go in turns.
ROWS_A_TEXT = 48


class Hashes(dict):
    """64-bit hashes of words, made when they are asked for. A full one starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return found


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_mark(text: str | None) -> bytes:
    """Digest of a text's word sequence, A-Z lower-cased."""
    return xxhash.xxh3_128_digest(b" ".join(split(text)))


def shingle_set(text: str | None, words: int, known: Hashes | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, in order. A text of fewer words is one shingle."""
    parts, known = split(text), Hashes() if known is None else known
    own = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n, k = max(1, len(own) - words + 1), min(words, len(own))
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ own[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def planes(rows: np.ndarray) -> list[np.ndarray]:
    """Bit counts of rows[segment, time, lane] over time: plane p holds bit p of each count. Carry-save addition."""
    held: list[np.ndarray | None] = []
    total: list[np.ndarray] = []

    def add(x: np.ndarray, p: int) -> None:
        while True:
            if p == len(total):
                total.append(np.zeros_like(x))
                held.append(None)
            if held[p] is None:
                held[p] = x
                return
            a, b, held[p] = total[p], held[p], None
            either = a ^ b
            total[p], x, p = either ^ x, (a & b) | (either & x), p + 1

    for i in range(rows.shape[1]):
        add(rows[:, i], 0)
    for p in itertools.count():
        if p == len(total):
            return total
        if held[p] is not None:
            x, held[p] = held[p], None
            carry = total[p] & x
            total[p] = total[p] ^ x
            if carry.any():
                add(carry, p + 1)


def signatures(sets: list[np.ndarray], copies: int, width: int) -> np.ndarray:
    """(sets, copies) SimHash values of so many bits of each set of hashes; every bit is that of an independent hash."""
    lanes = -(-copies * width // 64)
    salts = mixed(np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    pieces = np.maximum(1, -(-sizes // SEGMENT))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    first = np.repeat(np.cumsum(sizes) - sizes, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(SEGMENT, np.repeat(np.cumsum(sizes), pieces) - first)
    ones = np.zeros((len(first), lanes * 64), np.uint16)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), SEGMENTS):
        some = order[at : at + SEGMENTS]
        longest = int(length[some[-1]])
        if not longest:
            continue
        take = first[some][:, None] + np.arange(longest)
        real = np.arange(longest) < length[some][:, None]
        rows = mixed(flat[np.where(real, take, 0)][:, :, None] ^ salts)
        rows[~real] = 0
        for p, plane in enumerate(planes(rows)):
            bits = np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little")
            ones[some] += bits.astype(np.uint16) << np.uint16(p)
    begins = np.cumsum(pieces) - pieces
    counts = np.add.reduceat(ones, begins, axis=0, dtype=np.int64) if len(sets) else np.zeros((0, lanes * 64), np.int64)
    bits = (counts * 2 > sizes[:, None])[:, : copies * width].reshape(len(sets), copies, width)
    out = np.zeros((len(sets), copies, 64), bool)
    out[:, :, :width] = bits
    return np.packbits(out, axis=2, bitorder="little").view("<u8")[:, :, 0]


def similarity_angle(similarity: float) -> float:
    """Share of SimHash bits in which two sets of equal size and of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float, width: int = WIDTH, radius: int = RADIUS, copies: int = COPIES) -> tuple[int, int]:
    """(copies, width) of the short fingerprints of n texts.

    A fingerprint is so wide that it has FELLOWS others within the radius by chance at most,
    and there are so many of them that no more similar pairs are missed than with ``copies`` of
    the least width: two texts of the similarity are within the radius in one of 24 fingerprints
    of 32 bits but for a chance of 2e-7.
    """

    def apart(bits: int) -> float:
        p = similarity_angle(similarity)
        return 1 - sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1))

    missed = copies * math.log(apart(width))
    wide = next((w for w in range(width, 64) if n * ball(radius, w) <= FELLOWS * 2**w), 64)
    return max(copies, math.ceil(missed / math.log(apart(wide)))), wide


def signed(texts: DataFrame, words: int, copies: int, width: int) -> DataFrame:
    """(id, row, mark, signature) for texts (id, row, text): the word sequence's digest and the short fingerprints of the shingle set."""
    kind = "<u4" if width <= 32 else "<u8"

    def run(batches):
        known = Hashes()
        for batch in batches:
            held, marks, at, n = [], [], 0, 0
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                marks.append(word_mark(text))
                held.append(shingle_set(text, words, known))
                n += len(held[-1])
                if n >= SIGNED or len(held) == SIGNED_TEXTS or i == batch.num_rows - 1:
                    found = [x.tobytes() for x in signatures(held, copies, width).astype(kind)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held)), pa.array(marks, pa.binary()), pa.array(found, pa.binary())], names=["id", "row", "mark", "signature"])
                    held, marks, at, n = [], [], i + 1, 0

    return texts.mapInArrow(run, "id long, row long, mark binary, signature binary")


def turns(copies: int, part_bits: int, radius: int = RADIUS) -> list[range]:
    """The fingerprints of each turn: what a text sends in one stays within ROWS_A_TEXT rows, or is one fingerprint's, however many texts there are."""
    each = max(1, ROWS_A_TEXT // ball(radius // 2, part_bits))
    return [range(at, min(at + each, copies)) for at in range(0, copies, each)]


def fellows(classes: DataFrame, copies: int, width: int, part_bits: int, radius: int = RADIUS, only: range | None = None) -> DataFrame:
    """(a, b): links that connect texts wherever a chain of candidates does; candidates meet in some short fingerprint's ball.

    only names the fingerprints that meet; by default all do.

    Of the bits of the next fingerprints, CHECK_BITS go along: candidates that differ in too
    many of them are no pair. A task has the balls of one fingerprint that one part holds, and
    hands on at most one link for each text.
    """
    kinds = "part int, value long, x long, y long, c long"
    reach = flips(radius // 2, part_bits).astype(np.int64)
    masks, low = code_masks(part_bits, width), np.uint64(0xFFFFFFFF)
    own_turn = range(copies) if only is None else only

    def deal(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4" if width <= 32 else "<u8").astype(np.uint64).reshape(-1, copies)
            c = batch.column(0).to_numpy()
            for turn, k in enumerate(own_turn):
                own = values[:, k]
                others = [values[:, (k + j) % copies] & low for j in range(1, 5)]
                x, y = others[0] | others[1] << np.uint64(32), others[2] | others[3] << np.uint64(32)
                part = (code(own, masks)[:, None] ^ reach[None, :]).ravel() | turn << part_bits
                long = lambda v: pa.array(np.repeat(v, len(reach)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), long(own), long(x), long(y), long(c)], names=["part", "value", "x", "y", "c"])

    def run(batches):
        found = columns(batches)
        if not found:
            return
        order = np.argsort(found[4], kind="stable")
        part, (value, x, y, c) = int(found[0][0]), (f[order] for f in found[1:])
        value, x, y = value.view(np.uint64), x.view(np.uint64), y.view(np.uint64)
        near = lambda a, b: np.bitwise_count(x[a] ^ x[b]).astype(np.int64) + np.bitwise_count(y[a] ^ y[b]) <= CHECK_MOST
        root = forest(len(c), *meet(value, part & ((1 << part_bits) - 1), part_bits, radius, width, near))
        child = np.flatnonzero(root != np.arange(len(c)))
        yield pa.RecordBatch.from_arrays([pa.array(c[root[child]]), pa.array(c[child])], names=["a", "b"])

    return classes.select("c", "signature").mapInArrow(deal, kinds).repartitionById(len(own_turn) << part_bits, F.col("part")).mapInArrow(run, "a long, b long")


def linked_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions, one of left and one of right, whose sets have the similarity. Exact: shared members are counted by matrix products."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, member, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    often = times[member] > 1
    member, owner = rank[member[often]], owner[often]
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    wide = max(1, CELLS // len(sets))
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(member[-1]) + 1 if len(member) else 0, wide):
        i, j = np.searchsorted(member, [at, at + wide])
        has = np.zeros((len(sets), min(wide, int(member[-1]) + 1 - at)), np.float32)
        has[owner[i:j], member[i:j] - at] = 1
        shared += has[left] @ has[right].T
    found = []
    for rows in np.array_split(np.arange(len(left)), max(1, len(left) * len(right) >> 18)):
        both = shared[rows].astype(np.float64)  # whole numbers up to 2**24 are exact in single precision
        a, b = np.nonzero(both >= similarity * (sizes[left[rows]][:, None] + sizes[right][None, :] - both) - 1e-9)
        found.append((left[rows[a]], right[b]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a[a != b], b[a != b]


def groups(batches, keys: int):
    """Runs of rows of equal keys (the first columns, not null) of sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in itertools.pairwise([0, *change.tolist(), batch.num_rows]):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def compared(units: DataFrame, similarity: float) -> DataFrame:
    """(a, b) for units (root, lo, hi, side, c, set): links that connect what similar sets of the two sides of a unit connect.

    side is 0 for the block lo, 1 for hi. A unit of one block compares it with itself.
    """

    def run(batches):
        for unit in groups(batches, 3):
            c, side = unit["c"].to_numpy(), unit["side"].to_numpy()
            lists = unit["set"].combine_chunks()
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            flat = lists.flatten().to_numpy()
            sets = [flat[i:j] for i, j in itertools.pairwise(bounds.tolist())]
            every = np.arange(len(c))
            same = unit["lo"][0].as_py() == unit["hi"][0].as_py()
            left, right = (every, every) if same else (every[side == 0], every[side == 1])
            root = forest(len(c), *linked_sets(sets, left, right, similarity)) if len(c) > 1 and len(left) and len(right) else every
            child = np.flatnonzero(root != every)
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(c[root[child]]), pa.array(c[child])], names=["a", "b"])

    key = ["root", "lo", "hi"]
    return units.select(*key, "c", "side", "set").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def joined_sets(sets: DataFrame, similarity: float, texts: int = BLOCK_TEXTS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): links between texts of sets (root, c, set) with which texts of equal root hang together as all their similar pairs make them.

    The texts of a root are cut into blocks. Each block is compared with itself and with the
    first, which joins most of what belongs together. Then texts are cut anew, those of a large
    component into blocks of their own, and all blocks meet but those of the same component.
    """
    size = sets.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / texts, F.sum(F.size("set")) / shingles)).cast("int").alias("k"))
    large = materialize(size.where("k > 1"), "large")
    spread = F.pmod(F.xxhash64("c"), F.coalesce("k", F.lit(1))).cast("int")
    cut = sets.join(large.withColumnRenamed("root", "root_"), F.col("root") == F.col("root_"), "left").withColumn("own", spread).withColumn("k", F.coalesce("k", F.lit(1)))
    firsts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.lit(0).alias("lo"), j.alias("hi"), F.lit(0).alias("side")))
    others = F.array(F.struct(F.col("own").alias("lo"), F.col("own").alias("hi"), F.lit(0).alias("side")), F.struct(F.lit(0).alias("lo"), F.col("own").alias("hi"), F.lit(1).alias("side")))
    units = cut.withColumn("u", F.explode(F.when(F.col("own") == 0, firsts).otherwise(others))).select("root", "u.*", "c", "set")
    found = Table(compared(units, similarity), "links").df
    if large.isEmpty():
        return found
    # What the first comparison has left apart in the large ones.
    rest = sets.join(large.select("root"), "root")
    roots = connected_components(found).withColumnRenamed("root", "part")
    parts = rest.join(roots, F.col("c") == F.col("node"), "left").select("root", "c", "set", F.coalesce("part", "c").alias("part"))
    weight = F.ceil(F.greatest(F.count("*") / texts, F.sum(F.size("set")) / shingles)).cast("int")
    sized = parts.groupBy("root", "part").agg(weight.alias("k"), F.count("*").alias("n"), F.sum(F.size("set")).alias("m"))
    # A part is large if it fills half a block; the small ones of a root share blocks.
    sized = materialize(sized.withColumn("own", (F.col("n") * 2 >= texts) | (F.col("m") * 2 >= shingles)), "sized")
    shares = sized.where("not own").groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / texts, F.sum("m") / shingles)).cast("int").alias("share"))
    sized = sized.join(shares, "root", "left").select(F.col("root").alias("root_"), F.col("part").alias("part_"), F.when(F.col("own"), F.col("part")).alias("whole"), F.when(F.col("own"), F.col("k")).otherwise(F.col("share")).alias("k"))
    placed = parts.join(sized, (F.col("root") == F.col("root_")) & (F.col("part") == F.col("part_"))).select("root", "c", "set", "whole", F.pmod(F.xxhash64("c"), F.col("k")).cast("int").alias("turn"))
    placed = materialize(placed.withColumn("at", F.xxhash64("whole", "turn")), "placed")
    every = materialize(placed.select("root", "whole", "turn", "at").distinct(), "blocks")
    x, y = every.alias("x"), every.alias("y")
    # Blocks are some hundreds of texts each, so that their pairs are few next to those of texts.
    pairs = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.at") <= F.col("y.at"))).where("x.whole is null or y.whole is null or x.whole <> y.whole")
    pairs = materialize(pairs.select(F.col("x.root").alias("root"), F.col("x.at").alias("lo"), F.col("y.at").alias("hi")), "meetings")
    sides = pairs.select("root", "lo", "hi", F.col("lo").alias("at"), F.lit(0).alias("side")).union(pairs.where("lo <> hi").select("root", "lo", "hi", "hi", F.lit(1)))
    again = placed.select("root", "at", "c", "set").join(sides, ["root", "at"])
    return found.union(Table(compared(again, similarity), "links").df)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, row_col: str | None = None, texts: int = BLOCK_TEXTS) -> DataFrame:
    """(id, row, component_id, kept): components of texts whose Jaccard similarity of word shingles is at least ``similarity``.

    One fingerprint of 64 bits and a small radius only links texts that are nearly equal. Here a
    text has several short fingerprints, each of independent bits of its set of shingles, and
    candidates are texts that ball hashing brings together in any of them (``plan``: no more than
    2e-7 of the pairs at similarity 0.8 never meet; of texts of some five shingles, whose sums
    have ties, 5e-4). Texts that candidates connect are then compared by the sets of their
    distinct 64-bit shingle hashes, all of them but those that are known to belong together:
    no link is made or refused by an estimate.
    Texts of equal word sequences (A-Z lower-cased) are one class before that, also those
    without words. row_col names a column of unique longs that tell the rows apart; without
    it docs are numbered once, in a table. Columns and odd rows are as in near_duplicates.
    """
    if row_col is None:
        docs, row_col = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        id_col, text_col = "id", "text"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    n = source.count()
    copies, width = plan(n, similarity)
    part_bits = enough_bits(n, RADIUS, width, 0)
    rows = Table(signed(source, words, copies, width), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"), F.col("signature")))
    classes = rows.df.groupBy("mark").agg(first.alias("first")).select("mark", F.struct("first.none", "first.id", "first.row").alias("least"), F.col("first.row").alias("c"), "first.signature")
    classes = Table(classes, "classes")
    met = [Table(fellows(classes.df, copies, width, part_bits, only=some), "met") for some in turns(copies, part_bits)]
    families = materialize(connected_components(functools.reduce(DataFrame.union, [m.df for m in met])).select("root", F.col("node").alias("c_")), "families")
    for table in met:
        table.drop()

    def shingle(batches):
        known = Hashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, known).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["root", "c", "set"])

    near, likely = sketched(source, "row", families.select("c_"))
    member = near.where(likely).join(small(families), F.col("row") == F.col("c_"))
    sets = Table(member.select("root", F.col("row").alias("c"), "text").mapInArrow(shingle, "root long, c long, set array<long>"), "shingles")
    found = joined_sets(sets.df, similarity, texts)
    roots = connected_components(found)
    sets.drop()
    led = materialize(classes.df.select("mark", "c", "least").join(roots, F.col("c") == F.col("node"), "left").select("mark", "least", F.coalesce("root", "c").alias("root")), "roots")
    named = led.groupBy("root").agg(F.min("least").alias("best"))
    known = led.select("mark", "root").join(named, "root").select(F.col("mark").alias("mark_"), "best")
    joined = rows.df.select("id", "row", "mark").join(known, F.col("mark") == F.col("mark_"))
    out = materialize(joined.select("id", "row", F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept")), "kept")
    for table in (rows, classes):
        table.drop()
    return out
