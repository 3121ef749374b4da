"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a language: its emission sums the weights of its character n-grams
(with the word's edges, so that they hold its affixes), of its longer prefixes and suffixes, of
the whole word, and of lexicons of each language's frequent words; learned transitions carry
the context. Forward-backward gives each word's marginals, and a text's language is the one
with the largest sum of them, so code-switched text is labelled word by word first.

The model is fitted on a bounded sample of labelled rows, whose bound is a parameter. Word
scores are computed for the distinct words of a block of rows at once.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small

#: Runs of letters and of other numbers than decimal digits (fractions, superscripts, circled numbers); words_of parts those.
WORDS = re.compile(r"[^\W\d_]+")
#: Letters for Spark's own expressions.
LETTER = r"\p{L}"
BUCKETS = 1 << 15
#: Labelled rows of each language, windows of each row and words of each window that the fit takes; a shorter text is one window.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW = 300, 4, 24
#: Characters of a word of the sample; longer ones are learned by their beginnings.
WORD_CHARS = 64
#: Words of each language's lexicon.
LEXICON = 2000
STEPS, RATE, DECAY = 60, 0.15, 1e-4
#: Rows that are read at once, words of a block of them and cells of a padded batch that a task holds.
SLICE = 2000
BLOCK_WORDS, BATCH_CELLS = 1_000_000, 200_000
#: Scored words after which a worker forgets those it has.
SEEN_WORDS = 250_000
UNDETERMINED = "und"


@dataclass
class Model:
    """Weights of the field; langs are its labels in order."""

    langs: list[str]
    grams: np.ndarray
    lexicon: dict[str, np.ndarray]
    of_lexicon: np.ndarray
    bias: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    losses: list[float] = field(default_factory=list)
    #: Words that a worker has scored, and their scores; a worker keeps them from task to task.
    seen: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None


def mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ value >> np.uint64(29)
    return (value * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS


def gram_buckets(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, begins of each word's run) of each kind of hashed feature; every word has some of every kind.

    The kinds are the n-grams of 1, 2 and 3 characters of ^word$, its prefix and its suffix of
    four characters with the edge, and the whole word.
    """
    text = "".join([f"^{w}$" for w in words])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(chars))
    mul, found = np.uint64(0x100000001B3), []
    roll = np.zeros(len(chars), np.uint64)
    for n in (1, 2, 3):
        step = np.zeros(len(chars), np.uint64)
        step[: len(chars) - n + 1] = chars[n - 1 :]
        roll = (roll + np.uint64(n)) * mul ^ step
        found.append((mixed(roll[left >= n] if n > 1 else roll), starts - (n - 1) * np.arange(len(words))))
    each = np.arange(len(words))
    width = np.minimum(sizes, 5)
    for side, begin in ((11, starts), (13, ends - width)):
        value = np.full(len(words), side, np.uint64)
        for k in range(5):
            here = np.minimum(begin + k, len(chars) - 1)
            value = np.where(k < width, value * mul ^ chars[here], value)
        found.append((mixed(value), each))
    place = np.uint64(0x9E3779B97F4A7C15) * (np.repeat(sizes, sizes) - left + 1).astype(np.uint64)
    found.append((mixed(np.add.reduceat((chars + np.uint64(17)) * place, starts) ^ np.uint64(19)), each))
    return found


def gram_scores(grams: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the weights grams[label, bucket] of each word's features, label by label."""
    return np.stack([sum(np.add.reduceat(row[buckets], begins) if len(buckets) > len(begins) else row[buckets] for buckets, begins in kinds) for row in grams], axis=1)


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """Score of each label for each word."""
    if not words:
        return np.zeros((0, len(model.langs)))
    out = gram_scores(model.grams, gram_buckets(words)) + model.bias
    hit = [i for i, w in enumerate(words) if w in model.lexicon]
    if hit:
        out[hit] += np.stack([model.lexicon[words[i]] for i in hit]) @ model.of_lexicon
    return out


def forward_backward(scores: np.ndarray, start: np.ndarray, moves: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, expected moves, log partition) of a batch scores[time, row, label].

    Rows shorter than the batch are given by lengths; their padding has marginals of zero.
    """
    t, n, k = scores.shape
    peak = scores.max(axis=2, keepdims=True)
    potential, go = np.exp(scores - peak), np.exp(moves)
    real = np.ones((t, n), bool) if lengths is None else np.arange(t)[:, None] < lengths[None, :]
    ahead, scale = np.empty((t, n, k)), np.ones((t, n))
    now = np.exp(start)[None, :] * potential[0]
    for i in range(t):
        if i:
            now = (ahead[i - 1] @ go) * potential[i]
        total = now.sum(axis=1)
        if lengths is not None and i:
            total = np.where(real[i], total, 1.0)
            now = np.where(real[i][:, None], now, ahead[i - 1] * total[:, None])
        scale[i] = total
        ahead[i] = now / total[:, None]
    back = np.empty((t, n, k))
    back[t - 1] = 1.0
    pair = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        right = potential[i] * back[i] / scale[i][:, None]
        if lengths is None:
            pair += ahead[i - 1].T @ right * go
            back[i - 1] = right @ go.T
        else:
            pair += ahead[i - 1].T @ (right * real[i][:, None]) * go
            back[i - 1] = np.where(real[i][:, None], right @ go.T, 1.0)
    logs = np.where(real, np.log(scale) + peak[:, :, 0], 0.0).sum(axis=0)
    return ahead * back * real[:, :, None], pair, logs


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = WORDS.findall(text.lower())
    if text.isascii() or "".join(found).isalpha():
        return found
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def fit(rows: list[tuple[str, list[list[str]]]], seed: int = 11) -> Model:
    """A model of labelled windows of at most WINDOW words: (language, windows) for each row. A language without words isn't learned.

    Half of the training sequences join halves of windows of two languages, so that the
    transitions learn switches. Full-batch Adam on the log-likelihood.
    """
    langs = sorted({lang for lang, ws in rows if any(ws)})
    k, rng = len(langs), np.random.Generator(np.random.PCG64(seed))
    windows: list[tuple[int, list[str]]] = sorted((langs.index(lang), w) for lang, ws in rows for w in ws if w)
    counts: list[dict[str, int]] = [{} for _ in langs]
    for lang, ws in sorted(rows):
        for w in (x for one in ws for x in one):
            counts[langs.index(lang)][w] = counts[langs.index(lang)].get(w, 0) + 1
    lexicon: dict[str, np.ndarray] = {}
    for i, c in enumerate(counts):
        total = max(1, sum(c.values()))
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, np.zeros(k))[i] = n / total
    lexicon = {w: x / x.sum() for w, x in lexicon.items()}
    model = Model(langs, np.zeros((k, BUCKETS)), lexicon, np.zeros((k, k)), np.zeros(k), np.zeros(k), np.zeros((k, k)))
    if not windows or k == 1:
        return model
    mates = rng.permutation(len(windows))
    seqs = [(w, [i] * len(w)) for i, w in windows]
    for (i, w), (j, v) in zip(windows, [windows[m] for m in mates.tolist()], strict=True):
        head, tail = w[: len(w) // 2], v[len(v) // 2 :]
        seqs.append((head + tail, [i] * len(head) + [j] * len(tail)))
    sizes = np.array([len(ws) for ws, _ in seqs])
    longest = int(sizes.max())
    real = np.arange(longest)[:, None] < sizes[None, :]
    lengths = None if real.all() else sizes
    vocabulary = sorted({w for w, _ in seqs for w in w})
    index = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([[index[w] for w in ws] + [0] * (longest - len(ws)) for ws, _ in seqs]).T
    gold = np.array([labels + [0] * (longest - len(labels)) for _, labels in seqs]).T
    kinds = gram_buckets(vocabulary)
    buckets = np.concatenate([b for b, _ in kinds])
    owner = np.concatenate([np.repeat(np.arange(len(vocabulary)), np.diff(begins, append=len(b))) for b, begins in kinds])
    lex = np.stack([lexicon.get(w, np.zeros(k)) for w in vocabulary])
    one = np.eye(k)[gold] * real[:, :, None]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:-1][real[1:]], gold[1:][real[1:]]), 1.0)
    gold_start = one[0].sum(axis=0)
    n = int(sizes.sum())
    params = [model.grams, model.of_lexicon, model.bias, model.start, model.moves]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        scores = gram_scores(model.grams, kinds) + lex @ model.of_lexicon + model.bias
        marginals, pair, logs = forward_backward(scores[ids], model.start, model.moves, lengths)
        model.losses.append(float((logs.sum() - (scores[ids] * one).sum() - (model.moves * gold_moves).sum() - (model.start * gold_start).sum()) / n))
        off = (one - marginals).reshape(-1, k)
        by_word = np.stack([np.bincount(ids.ravel(), off[:, j], len(vocabulary)) for j in range(k)], axis=1)
        grams = np.stack([np.bincount(buckets, by_word[owner, j], BUCKETS) for j in range(k)])
        grads = [grams, lex.T @ by_word, by_word.sum(axis=0), gold_start - marginals[0].sum(axis=0), gold_moves - pair]
        for p, g, (m, v) in zip(params, grads, state, strict=True):
            g = g / n - DECAY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; score is the mean marginal of that language over its words.

    A null text and one without letters is ('und', 0). Equal sums go to the first language.
    """
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if model.scores is None or len(model.seen) > SEEN_WORDS:
        model.seen, model.scores = {}, np.zeros((0, len(model.langs)))
    index = model.seen
    held: list[tuple[int, np.ndarray]] = []

    def settle():
        fresh = list(itertools.islice(index, len(model.scores), None))
        scores = model.scores = np.concatenate((model.scores, emissions(model, fresh)))
        held.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(held):
            upto = at + 1
            while upto < len(held) and len(held[upto][1]) * (upto + 1 - at) <= BATCH_CELLS:
                upto += 1
            some = held[at:upto]
            lengths = np.array([len(x) for _, x in some])
            ids = np.zeros((lengths.max(), len(some)), np.int64)
            for j, (_, x) in enumerate(some):
                ids[: len(x), j] = x
            marginals, _, _ = forward_backward(scores[ids], model.start, model.moves, lengths)
            mean = marginals.sum(axis=0) / lengths[:, None]
            for (row, _), m in zip(some, mean, strict=True):
                best = int(m.argmax())
                out[row] = (model.langs[best], float(min(1.0, max(0.0, m[best]))))
            at = upto
        held.clear()

    words = 0
    for row, text in enumerate(texts):
        found = words_of(text) if text else []
        if not found or not model.langs:
            continue
        for w in set(found).difference(index):
            index[w] = len(index)
        held.append((row, np.fromiter(map(index.__getitem__, found), np.int32, len(found))))
        words += len(found)
        if words >= BLOCK_WORDS:
            settle()
            words = 0
    if held:
        settle()
    return out


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, rows: int) -> list[tuple[str, list[list[str]]]]:
    """Windows of words of at most so many rows of each language: those of the smallest hash of id and text.

    Rows without words or without an id aren't chosen, rows of equal id and text count once.
    Every language is learned. A row gives at most SAMPLE_WINDOWS windows of WINDOW words, spread
    over its text; only they reach the driver. A hash bound that follows from an estimate of the
    languages' different rows lets some 8 times the rows through, so that no task ranks a whole language.
    """
    text, digest = F.col(text_col).cast("string"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & text.rlike(LETTER))
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(digest, F.lit(1 << 40)).alias("h"), text.alias("text"))
    counts = labelled.groupBy(F.col("lang").alias("lang_")).agg(F.approx_count_distinct("h").alias("n"))
    near = labelled.join(small(materialize(counts, "languages")), F.col("lang") == F.col("lang_")).where(F.col("h") * F.col("n") <= F.lit(float(8 * rows) * (1 << 40)))
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = near.dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).select("lang", "text")

    def cut(batches):
        for batch in batches:
            langs, found = [], []
            for lang, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(own)
                spread = max(1, (len(words) - WINDOW) // SAMPLE_WINDOWS)
                begins = range(0, max(0, len(words) - WINDOW) + 1, spread) if words else []
                langs.append(lang)
                found.append([[w[:WORD_CHARS] for w in words[i : i + WINDOW]] for i in list(begins)[:SAMPLE_WINDOWS]])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.list_(pa.string())))], names=["lang", "windows"])

    got = chosen.mapInArrow(cut, "lang string, windows array<array<string>>").collect()
    return sorted((r["lang"], [list(w) for w in r["windows"]]) for r in got)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., id, lang_pred, score) of every row, from its text alone. An empty table gives no rows.

    keep names columns that come along untouched. Null, empty and letterless texts are 'und' with
    score 0, and so is everything if the model saw no label. Repeated rows are predicted each.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, seen={}, scores=None))

    def run(batches):
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            found = predict(shared.value, batch.column(1).to_pylist())
            rest = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", *(f"keep_{i}" for i in range(len(keep))), "lang_pred", "score"])

    kinds = dict(source.dtypes)
    ddl = ", ".join(["id long", *(f"keep_{i} {kinds[f'keep_{i}']}" for i in range(len(keep))), "lang_pred string", "score double"])
    return source.mapInArrow(run, ddl)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are never learned from: crc32 of the id as text, mod 4, is 2. False for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """A model fitted on a bounded sample of the labelled rows outside the held-out fold."""
    return fit(sample(docs, ~held_out(id_col), id_col, text_col, lang_col, rows))


def label_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row of docs, by a model that train fits on them. An empty table gives no rows."""
    return identify(docs, train(docs, id_col, text_col, lang_col, rows), id_col, text_col).select("id", held_out("id").alias("held_out"), "lang_pred", "score")
