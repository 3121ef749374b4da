"""Main text of HTML pages by a recurrent block labeller.

A page is parsed into its sequence of text blocks. Each block has a vector: its tag path (tag
names and the words of class, id and role of every open element, hashed), its hashed words and
a few sizes. A bidirectional LSTM in numpy reads the whole sequence, and every block is labelled
with the context of the whole page. The labeller is fitted on invented pages, in seconds, once a process.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import MARK, page

#: Elements that end the block around them.
BLOCKS = frozenset("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html input label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A paragraph ends where one of these begins.
PARAGRAPH_ENDS = BLOCKS - {"br", "button", "input", "label", "option"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")

PATH_BUCKETS, WORD_BUCKETS, SIZES, HIDDEN = 1024, 64, 6, 16
#: Invented pages, passes over them, pages of a step, rate at the start (it falls to nothing), seed.
PAGES, EPOCHS, STEP, RATE, SEED = 700, 10, 24, 0.02, 8
#: A block is of the article if its score is above -LEAN: to lose one of its blocks is worse than to keep a stray one.
LEAN = 0.75
#: Blocks of a padded batch.
CELLS = 60_000


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def blocks(source: str | None) -> list[Block]:
    """Text blocks in page order: white space is single spaces, references are decoded, empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    state = {"path": (), "linked": 0}

    def flush():
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, state["path"], state["linked"]))
        pieces.clear()
        state["linked"] = 0

    in_head = False
    for m in TOKEN.finditer(source or ""):
        text = m["text"]
        if text is not None:
            if in_head and not text.isspace():
                in_head = False  # text never belongs to a head
            if not in_head:
                if not any(p.strip() for p in pieces) and not text.isspace():
                    state["path"] = tuple(x for _, own in stack for x in own)
                piece = html.unescape(text) if "&" in text else text
                pieces.append(piece)
                if any(t == "a" for t, _ in stack):
                    state["linked"] += len(piece)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "head":
            in_head = not m["end"]
            continue
        if tag in BLOCKS:
            flush()
            in_head = False if tag == "body" else in_head
        if m["end"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
            continue
        if tag in PARAGRAPH_ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag == "li":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "li":
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "menu"):
                    break
        if tag not in VOID and not m["attrs"].endswith("/"):
            names = [n for a in ATTRIBUTE.finditer(m["attrs"]) for n in NAME.findall((a[2] or a[3] or a[4] or "").lower())] if m["attrs"] else []
            stack.append((tag, (f"<{tag}", *(f".{n}" for n in names))))
    flush()
    return out


@functools.lru_cache(1 << 16)
def bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


@functools.lru_cache(1 << 14)
def path_buckets(path: tuple[str, ...]) -> tuple[int, ...]:
    """Distinct hashed tokens of a tag path, the innermost once more as itself."""
    last = next((t for t in reversed(path) if t[0] == "<"), "")
    return tuple(sorted({bucket(t, PATH_BUCKETS) for t in (*path, f"leaf{last}")}))


def vector(block: Block) -> np.ndarray:
    """Hashed words (share of the block) and sizes of a block."""
    words = block.text.lower().split()
    counts = np.bincount(np.fromiter((bucket(w.strip(".,;:!?"), WORD_BUCKETS) for w in words), np.int64, len(words)), minlength=WORD_BUCKETS) / len(words)
    n = len(block.text)
    sizes = (np.log1p(n) / 8, np.log1p(len(words)) / 6, block.linked / n, sum(map(block.text.count, ".,;")) / len(words), float(block.text[-1:] in ".!?"), len(block.path) / 16)
    return np.concatenate((counts, sizes))


def lstm(z: np.ndarray, u: np.ndarray, real: np.ndarray):
    """Hidden states of a batch of inputs z[time, row, 4 * hidden], and what the gradient needs."""
    t, n, _ = z.shape
    h, c = np.zeros((t + 1, n, HIDDEN)), np.zeros((t + 1, n, HIDDEN))
    gates = np.empty((t, n, 4 * HIDDEN))
    for i in range(t):
        g = z[i] + h[i] @ u
        g[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
        g[:, 3 * HIDDEN :] = np.tanh(g[:, 3 * HIDDEN :])
        gates[i] = g
        now = g[:, HIDDEN : 2 * HIDDEN] * c[i] + g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
        c[i + 1] = np.where(real[i][:, None], now, c[i])
        h[i + 1] = np.where(real[i][:, None], g[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(now), h[i])
    return h, c, gates


def lstm_gradient(up: np.ndarray, h: np.ndarray, c: np.ndarray, gates: np.ndarray, u: np.ndarray, real: np.ndarray):
    """Gradients of the inputs z and of the recurrent weights, for gradients up of the hidden states."""
    t, n, _ = up.shape
    dz, du = np.zeros_like(gates), np.zeros_like(u)
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for i in range(t - 1, -1, -1):
        on = real[i][:, None]
        inn, forget, out, cand = (gates[i][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        total = dh + up[i]
        squashed = np.tanh(c[i + 1])
        cell = dc + total * out * (1 - squashed**2)
        d = np.concatenate((cell * cand * inn * (1 - inn), cell * c[i] * forget * (1 - forget), total * squashed * out * (1 - out), cell * inn * (1 - cand**2)), axis=1) * on
        dz[i] = d
        du += h[i].T @ d
        dh = np.where(on, d @ u.T, total)
        dc = np.where(on, cell * forget, dc)
    return dz, du


class Labeller:
    """Weights of the bidirectional LSTM: for each direction of paths, of words and sizes, recurrent ones and bias; then the output's."""

    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        wide = WORD_BUCKETS + SIZES
        draw = lambda *shape: rng.normal(0, 0.1, shape)
        self.path, self.dense, self.again, self.bias = draw(2, PATH_BUCKETS, 4 * HIDDEN), draw(2, wide, 4 * HIDDEN), draw(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 4 * HIDDEN))
        self.bias[:, HIDDEN : 2 * HIDDEN] = 1.0
        self.out, self.shift = draw(2 * HIDDEN), np.zeros(1)

    def weights(self) -> list[np.ndarray]:
        return [self.path, self.dense, self.again, self.bias, self.out, self.shift]

    def inputs(self, some: list[list[Block]]):
        """Padded features of a batch: (path tokens, their cells), dense features, which cells are real."""
        t, n = max(map(len, some)), len(some)
        dense, real = np.zeros((t, n, WORD_BUCKETS + SIZES)), np.zeros((t, n), bool)
        tokens, cells = [], []
        for j, own in enumerate(some):
            real[: len(own), j] = True
            for i, block in enumerate(own):
                dense[i, j] = vector(block)
                found = path_buckets(block.path)
                tokens += found
                cells += [i * n + j] * len(found)
        return np.array(tokens, np.int64), np.array(cells, np.int64), dense, real

    def run(self, tokens, cells, dense, real):
        """Scores of the cells, and the states of both directions."""
        t, n, wide = dense.shape
        flips = [slice(None), slice(None, None, -1)]
        states = []
        order = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1)) if len(cells) else np.zeros(0, np.int64)
        for d in range(2):
            z = (dense.reshape(-1, wide) @ self.dense[d] + self.bias[d]).reshape(t * n, -1)
            z[cells[order]] += np.add.reduceat(self.path[d][tokens], order, axis=0)
            states.append(lstm(z.reshape(t, n, -1)[flips[d]], self.again[d], real[flips[d]]))
        hidden = np.concatenate((states[0][0][1:], states[1][0][1:][::-1]), axis=2)
        return hidden @ self.out + self.shift[0], hidden, states

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is of the article, for each page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and len(pages[order[upto]]) * (upto + 1 - at) <= CELLS // 4 and upto - at < 2000:
                upto += 1
            some = order[at:upto]
            scores, _, _ = self.run(*self.inputs([pages[i] for i in some]))
            for j, i in enumerate(some):
                out[i] = scores[: len(pages[i]), j] > -LEAN
            at = upto
        return out


def fit(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted on so many invented pages by back-propagation through time and Adam."""
    rng = random.Random(seed)
    some = sorted(((blocks(page(rng))) for _ in range(pages)), key=len)
    some = [x for x in some if x]
    gold = [np.array([b.text.startswith(MARK) for b in x], float) for x in some]
    clean = [[Block(b.text.replace(MARK, "") or "-", b.path, b.linked) for b in x] for x in some]
    batches = []
    for at in range(0, len(clean), STEP):
        tokens, cells, dense, real = labeller_inputs = Labeller.inputs(None, clean[at : at + STEP])
        want = np.zeros(real.shape)
        for j, g in enumerate(gold[at : at + STEP]):
            want[: len(g), j] = g
        batches.append((labeller_inputs, want))
    net = Labeller(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    for _ in range(epochs):
        rng.shuffle(batches)
        for (tokens, cells, dense, real), want in batches:
            step += 1
            scores, hidden, states = net.run(tokens, cells, dense, real)
            n = real.sum()
            error = np.where(real, 1 / (1 + np.exp(-scores)) - want, 0.0) / n
            up = error[:, :, None] * net.out
            grads = [np.zeros_like(w) for w in net.weights()]
            grads[4][:] = (error[:, :, None] * hidden).sum(axis=(0, 1))
            grads[5][0] = error.sum()
            for d, flip in enumerate((slice(None), slice(None, None, -1))):
                half = up[:, :, d * HIDDEN : (d + 1) * HIDDEN][flip]
                dz, du = lstm_gradient(half, *states[d], net.again[d], real[flip])
                dz = dz[flip].reshape(-1, 4 * HIDDEN)
                grads[1][d] = dense.reshape(len(dz), -1).T @ dz
                grads[2][d], grads[3][d] = du, dz.sum(axis=0)
                order = np.argsort(tokens, kind="stable")
                first = np.concatenate(([0], np.flatnonzero(np.diff(tokens[order])) + 1))
                grads[0][d][tokens[order][first]] = np.add.reduceat(dz[cells[order]], first, axis=0)
            for w, g, (m, v) in zip(net.weights(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (1 - step / (1 + epochs * len(batches))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


@functools.lru_cache(1)
def fitted() -> Labeller:
    return fit()


def main_texts(net: Labeller, sources: list[str | None]) -> list[str]:
    """The main text of each page: its article's blocks in page order, one to a line."""
    parsed = [blocks(s) for s in sources]
    return ["\n".join(b.text for b, on in zip(own, label, strict=True) if on) for own, label in zip(parsed, net.label(parsed), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), net: Labeller | None = None) -> DataFrame:
    """(id, keep..., text) of every row: the main text of its whole HTML. An empty table gives no rows.

    Null and empty pages, and those without an article's block, have an empty text. Broken
    markup is read as far as it goes: open elements end with their parent, a cut-off tag or
    comment with the page. Repeated rows are extracted each, null ids stay. keep names columns that come along.
    """
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    shared = pages.sparkSession.sparkContext.broadcast(net or fitted())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = pa.array(main_texts(shared.value, some.column(1).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), *some.columns[2:], texts], names=["id", *(f"keep_{i}" for i in range(len(keep))), "text"])

    kinds = dict(source.dtypes)
    ddl = ", ".join(["id long", *(f"keep_{i} {kinds[f'keep_{i}']}" for i in range(len(keep))), "text string"])
    return source.mapInArrow(run, ddl).toDF("id", *keep, "text")
