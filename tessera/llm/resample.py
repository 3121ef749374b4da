"""Importance resampling towards a target distribution over hashed word runs.

Two scans: one counts the runs of 1 to 3 words in each bucket over all texts, one weighs each text with the
logarithms of the target's and the corpus's shares, as arrays. A perturbed weight is an integer score; an exact
histogram of the scores, summed from the highest down, gives the rank at which every score begins, and so the cutoff.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sql import CRC_TABLE, crc32
from .common import Table, materialize, small

#: Runs of up to so many words; buckets; least words of a document that may be drawn; percent drawn.
RUN, BUCKETS, LEAST_WORDS, PERCENT = 3, 10_000, 20, 5
#: Bytes of text in a slice; a longer text is cut between words.
SLICE = 1 << 21
#: Words up to this length (and the blank before them) are appended to a checksum by tables.
TABLED = 48

_SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: A-Z in lower case, other ASCII but digits and letters to blanks, all else as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in _SEPARATORS)


def _zero_tables() -> np.ndarray:
    """[n][k][b]: what byte k of a CRC-32, if it is b, becomes when n zero bytes follow. A checksum of joined texts is the exclusive or of these and the checksum of the second text."""
    unit = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        unit = np.where(unit & 1, (unit >> 1) ^ np.uint32(0xEDB88320), unit >> 1)
    out = np.empty((TABLED + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, TABLED + 2):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ unit[out[n - 1] & np.uint32(255)]
    return out


ZEROS = _zero_tables()


def pieces(texts: Iterable[bytes | None], most: int = SLICE):
    """Slices [(number of the text, its words, how many of them were in the slice before)], of about most bytes each.

    A text that goes on in another slice brings its last words along, as runs reach back over them.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        data, at, back = (text or b"").translate(FOLD), 0, []
        while at < len(data):
            end = data.find(b" ", at + most) if len(data) - at > most else -1
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            held.append((i, back + words, len(back)))
            size += end - at
            back, at = (back + words)[1 - RUN :], end
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def buckets(held: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket) of every run of a slice, and the number of the text of every word."""
    words = [w for _, some, _ in held for w in some]
    place = {w: j for j, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    alone = np.fromiter(map(zlib.crc32, place), np.uint32, len(place))
    after = np.fromiter((zlib.crc32(b" " + w) for w in place), np.uint32, len(place))
    size = np.fromiter(map(len, place), np.int64, len(place)) + 1
    counts = [len(some) for _, some, _ in held]
    text = np.repeat([i for i, _, _ in held], counts).astype(np.int64)
    nth = np.arange(len(words)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)
    fresh = nth >= np.repeat([old for _, _, old in held], counts)
    out = [(text[fresh], alone[at[fresh]])]
    crc = alone[at]  # of the run that ends at each word
    for run in range(1, RUN):
        ends = np.flatnonzero(nth >= run)
        before, word = crc[ends - 1], at[ends]
        joined = after[word].copy()
        tabled = size[word] <= TABLED + 1
        n_zero, old = size[word][tabled], before[tabled]
        joined[tabled] ^= ZEROS[n_zero, 0, old & 255] ^ ZEROS[n_zero, 1, old >> 8 & 255] ^ ZEROS[n_zero, 2, old >> 16 & 255] ^ ZEROS[n_zero, 3, old >> 24]
        for j in np.flatnonzero(~tabled):
            joined[j] = zlib.crc32(b" " + words[ends[j]], int(before[j]))
        crc = np.zeros(len(words), np.uint32)
        crc[ends] = joined
        new = fresh[ends]
        out.append((text[ends][new], joined[new]))
    return np.concatenate([t for t, _ in out]), (np.concatenate([c for _, c in out]) % n).astype(np.int64), text[fresh]


def counted(rows: DataFrame, text_col: str, n: int = BUCKETS) -> DataFrame:
    """(bucket, c): how many runs of all texts fall into each bucket. A task sends a row a bucket at most."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            for held in pieces(x.as_py() for x in b["t"]):
                total += np.bincount(buckets(held, n)[1], minlength=n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "c"])

    texts = rows.select(F.col(text_col).cast("binary").alias("t")).where("t is not null")
    return texts.mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def gains(corpus: DataFrame, target: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the counts of either side: n numbers, whatever the size of the texts."""
    every = corpus.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("c", "s"), "bucket", "left").join(target.withColumnRenamed("c", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + n) / ((F.col("s") + 1) * (F.col("all_t") + n))
    out = np.zeros(n, np.int64)
    for r in both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect():  # sums is one row
        out[r["bucket"]] = r["gain"]
    return out


def weighed(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray) -> DataFrame:
    """(id, words, n_features, weight) of every row."""
    n = len(gain)

    def run(batches):
        for b in batches:
            rows = b.num_rows
            words, features, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for held in pieces(x.as_py() for x in b["t"]):
                text, bucket, of_word = buckets(held, n)
                words += np.bincount(of_word, minlength=rows)
                features += np.bincount(text, minlength=rows)
                weight += np.bincount(text, gain[bucket], minlength=rows).astype(np.int64)  # whole numbers far below 2**53
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(words), pa.array(features), pa.array(weight)], names=["id", "words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, from the digest of "seed:id"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, n: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs: rank is 1, 2, ... for the drawn, by falling score and then id, and null for the others.

    Of the documents with at least least_words words, percent of a hundred are drawn (rounded down). A null text has no words and
    weight 0; texts of any length are read whole. A null id is hashed as "null" and comes last of its score; rows that agree in id and score
    follow each other in the order of weight and n_features. Other columns are ignored; an empty table gives no rows, and without target texts
    all gains come from the corpus alone.
    """
    gain = gains(counted(docs, text_col, n), counted(target, target_col, n), n)
    found = weighed(docs, id_col, text_col, gain)
    scored = materialize(found.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    asked = scored.where(F.col("words") >= least_words)
    draw = percent * asked.count() // 100
    above, cutoff = begun(asked, draw)
    out = ["id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select(*out, none)
    # Rows that agree in everything are one row with a count until they are ranked, so that no score's window holds many copies of one id.
    same = asked.where(F.col("score") >= cutoff).groupBy(*out).agg(F.count("*").alias("c"))
    order = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "weight", "n_features")
    ranked = same.join(small(above), "score").withColumn("last", F.col("above") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranks = F.explode(F.sequence(F.col("last") - F.col("c") + 1, F.col("last")))
    drawn = ranked.select(*out, ranks.alias("rank")).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where((F.col("words") < least_words) | (F.col("score") < cutoff))
    return drawn.unionByName(rest.select(*out, none))


def begun(asked: DataFrame, draw: int) -> tuple[DataFrame | None, int | None]:
    """(score, above): how many rows have a higher score, for each score that is drawn from, and the lowest of them.

    The histogram is cut into ranges of scores by range partitioning; ranges are summed first, then the scores of each.
    """
    if draw < 1:
        return None, None
    counts = asked.groupBy("score").agg(F.count("*").alias("c")).repartitionByRange(F.desc("score"))
    counts = materialize(counts.withColumn("range", F.spark_partition_id()), "histogram")
    down = Window.orderBy(F.desc("top"))  # a row for each partition
    ranges = counts.groupBy("range").agg(F.sum("c").alias("all"), F.max("score").alias("top")).withColumn("before", F.sum("all").over(down) - F.col("all"))
    within = Window.partitionBy("range").orderBy(F.desc("score"))
    placed = counts.join(F.broadcast(ranges.select("range", "before")), "range").withColumn("above", F.col("before") + F.sum("c").over(within) - F.col("c"))
    above = Table(placed.where(F.col("above") < draw).select("score", "above"), "above").df
    return above, above.agg(F.min("score")).first()[0]


def resample_sql(percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, n: int = BUCKETS) -> str:
    """The same by a row for every run of words."""
    runs = lambda name: " UNION ALL ".join(f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS f FROM {name}" for k in range(1, RUN + 1))
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH tb AS MATERIALIZED {CRC_TABLE}, d AS (SELECT doc_id, {words('text')} AS w FROM documents), b AS (SELECT item_id AS doc_id, {words('text')} AS w FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, f, count(*) AS c FROM ({runs('d')}) GROUP BY 1, 2), bf AS MATERIALIZED (SELECT f, count(*) AS c FROM ({runs('b')}) GROUP BY 1),
u AS MATERIALIZED (SELECT f, {crc32('f')} % {n} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), tb),
s AS (SELECT bucket, sum(c) AS s FROM df JOIN u USING (f) GROUP BY 1), t AS (SELECT bucket, sum(c) AS t FROM bf JOIN u USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {n})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {n})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM df JOIN u USING (f) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS asked FROM o WHERE words >= {least_words})
SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * asked // 100 THEN rank END AS rank FROM o LEFT JOIN k USING (doc_id)"""
