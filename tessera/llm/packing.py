"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of 2,048 and, for what is left, of the powers of two
that add up to it. Every piece is a sequence of its own; sequences of equal length form a
bucket, from which batches of one length are drawn. So no sequence crosses documents and none
is padded.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table

LONGEST = 2048
#: Words that a worker's cache holds.
WORDS = 300_000
#: The tokenizer's own pre-tokens, in a lower-case text of Latin-1 characters: letters, digits, contractions, the rest.
PRETOKENS = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\\t-\\r \x85\xa0]+")
#: Rows up to which the table of sequence numbers is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def vocabulary() -> str:
    """Path of the tokenizer that the query uses. It is part of the environment, on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The settings of a tokenizer whose split PRETOKENS makes.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_words(path: str) -> bool:
    """Whether the tokenizer of that file lower-cases, splits as PRETOKENS does and ends words with </w>."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    model, before = settings["model"], settings.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [{}])[0]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    known = (settings.get("normalizer") or {}).get("normalizers") == NORMALIZERS and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    special = all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in settings["added_tokens"])
    return known and plain and special and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and settings.get("truncation") is None


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it has a shape of its own, else one after U+00FF in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


SIGNS = byte_signs()


def visible(word: str) -> str:
    return "".join([SIGNS[b] for b in word.encode()])


class Encoder:
    """Token ids of whole texts, with a cache of words that have been tokenised before.

    The tokenizer of the query lower-cases a text, splits it into pre-tokens and merges nothing
    across them. For texts in Latin-1 the same split is made here, and only words that are new go
    to the tokenizer's model: each is one pre-token. Other texts,
    and those that may hold a special token, go to the tokenizer whole, and so do all texts if
    the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = splits_words(path)
        ids = np.arange(max(self.tokenizer.get_vocab().values()) + 1, dtype="<u4").tobytes()
        self.raw = [ids[i : i + 4] for i in range(0, len(ids), 4)]
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, as little-endian 32-bit integers: what the tokenizer's merges make of their bytes."""
        raw, tokenize = self.raw, self.model.tokenize
        return {w: b"".join([raw[t.id] for t in tokenize(w if w.isascii() and w.isprintable() else visible(w))]) for w in words}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. A full cache lets go what these texts added."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words, out, waiting, ask = self.words, [b""] * len(texts), [], {}
        for row, text in enumerate(texts):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                out[row] = self.whole(text)
                continue
            if "<|" in text:
                out[row] = self.whole(text)
                continue
            split = PRETOKENS.findall(text.lower())
            ids = list(map(words.get, split))
            holes, at = [], -1
            while True:
                try:
                    at = ids.index(None, at + 1)
                except ValueError:
                    break
                holes.append(at)
            if holes:
                ask.update((split[i], None) for i in holes)
                waiting.append((row, ids, [(i, split[i]) for i in holes]))
            else:
                out[row] = b"".join(ids)
        new = self.fresh(list(ask))
        for row, ids, holes in waiting:
            for i, w in holes:
                ids[i] = new[w]
            out[row] = b"".join(ids)
        if len(words) < WORDS:
            words.update(new)
        return out


def pieces(n: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n tokens: whole longest ones, then powers of two, largest first."""
    full, rest = n // longest, n % longest
    row = np.repeat(np.arange(len(n)), full)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)) * longest
    bits = longest >> np.arange(1, longest.bit_length())
    own, k = np.nonzero(rest[:, None] & bits)
    above = rest[own] & ~(2 * bits[k] - 1)
    row, start, length = np.concatenate((row, own)), np.concatenate((start, (full * longest)[own] + above)), np.concatenate((np.full(len(row), longest), bits[k]))
    order = np.lexsort((start, row))
    return row[order], start[order], length[order]


_encoders: dict[str, Encoder] = {}


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, longest: int = LONGEST, ids: bool = True) -> DataFrame:
    """(id, start, length, ids, ids_crc32, doc_tokens, part, place): the pieces of each row's tokens and end token.

    part is the task that cut them, place the piece's rank among that task's pieces of equal
    length, ids_crc32 the CRC-32 of its ids as little-endian 32-bit integers. Without ids the
    ids themselves are left out.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = tokenizer or vocabulary()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        places: dict[int, int] = {}
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = encoder(some.column(1).to_pylist())
                n = np.fromiter((len(x) // 4 + 1 for x in found), np.int64, len(found))
                raw = end.join([*found, b""])
                row, start, length = pieces(n, longest)
                place = np.zeros(len(row), np.int64)
                for own in np.unique(length).tolist():
                    mine = np.flatnonzero(length == own)
                    first = places.get(own, 0)
                    place[mine] = np.arange(first, first + len(mine))
                    places[own] = first + len(mine)
                # The pieces follow each other as the ids do.
                bounds = np.concatenate(([0], np.cumsum(length)))
                at_byte = (bounds * 4).tolist()
                view = memoryview(raw)
                crc = [zlib.crc32(view[i:j]) for i, j in zip(at_byte, at_byte[1:], strict=False)]
                rows = pa.array(row)
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(raw, "<i4")))] if ids else []
                yield pa.RecordBatch.from_arrays([some.column(0).take(rows), pa.array(start), pa.array(length), *lists, pa.array(crc, pa.int64()), pa.array(n[row]), some.column(2).take(rows), pa.array(place)], names=names)

    names = ["id", "start", "length", *(["ids"] if ids else []), "ids_crc32", "doc_tokens", "part", "place"]
    kinds = {"ids": "array<int>", "part": "int"}
    return source.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, longest: int = LONGEST, ids: bool = True) -> DataFrame:
    """(id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): every piece, each the one piece of its sequence. An empty table gives no rows.

    Sequences are numbered bucket by bucket, the longest first, without gaps. A null or
    empty text is the end token alone. Repeated rows are packed once each; a null id stays
    null. Texts of any length are packed whole. Pieces are written once to the shared folder
    (without ids: all but the token ids), and the numbers come from a count for each task and
    bucket. Extra columns are ignored.
    """
    cuts = Table(cut(docs, id_col, text_col, tokenizer, end_id, longest, ids), "pieces").df
    counts = Table(cuts.groupBy("length", "part").agg(F.count("*").alias("n")), "buckets").df
    begins, at = [F.lit(-1).cast("long"), F.lit(0).cast("long")], 0
    # One row for each power of two.
    for r in sorted(counts.groupBy("length").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["length"]):
        begins += [F.lit(r["length"]).cast("long"), F.lit(at).cast("long")]
        at += r["n"]
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(upto), F.lit(0)) + F.element_at(F.create_map(*begins), F.col("length"))
    first = counts.select(F.col("length").alias("length_"), F.col("part").alias("part_"), before.alias("first"))
    first = F.broadcast(first) if counts.count() <= BROADCAST_ROWS else first
    placed = cuts.join(first, (F.col("length") == F.col("length_")) & (F.col("part") == F.col("part_")))
    own = ["ids", "ids_crc32"] if ids else ["ids_crc32"]
    return placed.select("id", "start", "length", *own, "doc_tokens", (F.col("first") + F.col("place")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
