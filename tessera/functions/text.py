"""Text functions as columns. Character classes are spelled out, so that other engines agree."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def words(text: Column) -> Column:
    """Identifiers and numbers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))


def subtokens(word: Column) -> Column:
    """Lower-case camel and snake parts of more than one character."""
    parts = F.transform(F.regexp_extract_all(word, F.lit(C.PART), F.lit(0)), F.lower)
    return F.filter(parts, lambda p: F.length(p) > 1)


def tokenize(text: Column, keep_stopwords: bool = False) -> Column:
    """Each word in lower case, then its parts that differ from it; single characters and stopwords are left out."""
    stop = F.array(*map(F.lit, C.STOPWORDS))
    good = (lambda x: F.lit(True)) if keep_stopwords else (lambda x: ~F.array_contains(stop, x))

    def of(word: Column) -> Column:
        low = F.lower(word)
        whole = F.filter(F.array(low), lambda x: (F.length(x) > 1) & good(x))
        # Only words with an upper-case letter inside, a digit or an underscore have parts of their own.
        parts = F.filter(subtokens(word), lambda p: (p != low) & good(p))
        return F.when(word.rlike("^[A-Z]?[a-z]*$"), whole).otherwise(F.concat(whole, parts))

    return F.flatten(F.transform(words(F.coalesce(text, F.lit(""))), of))


def word_tokens(word: Column, keep_stopwords: bool = False) -> Column:
    """The tokens of one word of ``words``, as an array: what tokenize makes of it."""
    stop = C.STOPWORDS
    low = F.lower(word)
    good = F.length(low) > 1 if keep_stopwords else (F.length(low) > 1) & ~low.isin(stop)
    whole = F.when(good, F.array(low)).otherwise(F.array().cast("array<string>"))
    parts = F.filter(subtokens(word), lambda p: (p != low) if keep_stopwords else (p != low) & ~p.isin(stop))
    return F.when(word.rlike("^[A-Z]?[a-z]*$"), whole).otherwise(F.concat(whole, parts))


def exploded_tokens(rows: DataFrame, keep: list[str], text: str, name: str = "term") -> DataFrame:
    """A row with the kept columns for each token of a text. Words are rows before they are cut, so that every step is generated code."""
    each = rows.select(*keep, F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("word_"))
    return each.select(*keep, F.explode(word_tokens(F.col("word_"))).alias(name))


_STOP, _PART = frozenset(C.STOPWORDS), re.compile(C.PART)


@functools.lru_cache(1 << 18)
def _tokens(word: str) -> tuple[str, ...]:
    """What word_tokens makes of a word."""
    low = word.lower()
    whole = (low,) if len(low) > 1 and low not in _STOP else ()
    if low.isalpha() and word[1:] == low[1:]:
        return whole
    return whole + tuple(p for p in map(str.lower, _PART.findall(word)) if len(p) > 1 and p != low and p not in _STOP)


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, p) for each value of the key: how many tokens its texts have, and an array of (term, tf).

    A text's words are counted before they are cut and no token is a row, so that nothing but texts is shuffled, and they only
    where they don't lie by their key. Words are ASCII, which Python and the JVM cut alike.
    """
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        word = re.compile(C.WORD)
        for own in batches:
            for at in range(0, own.num_rows, 256):
                some = own.slice(at, 256)
                sizes, ends, terms, tfs = [], [0], [], []
                for texts in some.column(1).to_pylist():
                    found: dict[str, int] = {}
                    for w, c in Counter(word.findall("\n".join(texts))).items():
                        # Most words are in lower case and have no parts: each is its own token, without a look-up.
                        for token in (w,) * (len(w) > 1 and w not in _STOP) if w.isalpha() and w.islower() else _tokens(w):
                            found[token] = found.get(token, 0) + c
                    terms += found.keys()
                    tfs += found.values()
                    sizes.append(sum(found.values()))
                    ends.append(len(terms))
                pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=[key, "dl", "p"])

    texts = rows.groupBy(key).agg(F.collect_list(text).alias("texts"))
    return texts.mapInArrow(run, f"`{key}` {kind.simpleString()}, dl int, p array<struct<term:string,tf:int>>")


def normalize_symbol(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"^[()]+|[()]+$", ""))


def symbol_variants(name: Column) -> Column:
    """Keys that a symbol is found under, in this order: lower case, last dotted part, parts joined without and with underscores."""
    trimmed = F.regexp_replace(name, r"^\s+|\s+$", "")
    parts = subtokens(trimmed)
    keys = F.array(F.lower(trimmed), F.lower(F.substring_index(trimmed, ".", -1)), F.array_join(parts, ""), F.array_join(parts, "_"))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def leaf(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def extract_symbols(text: Column) -> Column:
    """Identifier candidates of a question, the most specific pattern first, without repeats."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p.replace("{b}", BEGIN).replace("{e}", END)), F.lit(1)) for p in C.SYMBOL_PATTERNS))
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[`.,()]+|[`.,()]+$", ""))
    good = lambda x: (F.length(x) >= 3) & ~F.array_contains(F.array(*map(F.lit, C.NO_SYMBOLS)), F.lower(x))
    return F.array_distinct(F.filter(bare, good))


def classify(question: Column) -> Column:
    """First category whose pattern the question has."""
    rules = [(name, "(?i)" + BEGIN + pattern.replace("{e}", END)) for name, pattern in C.CATEGORIES]
    return functools.reduce(lambda rest, r: F.when(question.rlike(r[1]), F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(C.DEFAULT_CATEGORY))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def truncate(text: Column, tokens: int = C.CHUNK_TOKENS) -> Column:
    """A text of more than 4 characters a token keeps its head and its tail around a note of what is left out."""
    most = tokens * 4
    head, tail = int(most * C.HEAD_SHARE), int(most * C.TAIL_SHARE)
    note = F.concat(F.lit("\n... ["), (F.length(text) - head - tail).cast("string"), F.lit(" chars elided] ...\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(tail))))


def squash(text: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", ""), 1, most)


def parse_citations(text: Column) -> Column:
    """Distinct (path, start_line, end_line) that a text cites, in order."""
    each = [F.regexp_extract_all(text, F.lit(C.CITATION), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(each[0].alias("p"), each[1].alias("s"), each[2].alias("e"))
    return F.array_distinct(F.transform(zipped, lambda z: F.struct(z["p"].alias("path"), z["s"].cast("int").alias("start_line"), z["e"].cast("int").alias("end_line"))))


def strip_thinking(text: Column) -> Column:
    """Without closed thinking sections and from an open one on."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(closed, r"(?s)<think>.*$", ""), r"^\s+|\s+$", "")


def extract_json(text: Column) -> Column:
    """The JSON object of a text: in a code fence, else between the outermost braces; trailing commas go. Null if none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    raw = F.when(fenced != "", fenced).otherwise(outer)
    mended = F.regexp_replace(raw, r",\s*([}\]])", "$1")
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.when(raw != "", F.coalesce(valid(raw), valid(mended)))


def tolerant_int(text: Column) -> Column:
    """An integer from an integer, a decimal or a boolean in text; null for anything else."""
    trimmed = F.trim(text)
    return F.when(F.lower(trimmed).isin("true", "false"), (F.lower(trimmed) == "true").cast("int")).otherwise(trimmed.try_cast("double").try_cast("int"))


def is_test_path(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.rlike(r"^test_.*|.*_test\.py$|^conftest\.py$") | F.concat(F.lit("/"), path).rlike("/tests?/")


def module_name(path: Column) -> Column:
    """Dotted module of a path, without a package's __init__."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.py$", ""), "/", "."), r"(^|\.)__init__$", "")


@functools.lru_cache(1 << 16)
def gram_buckets(token: str, dimension: int) -> np.ndarray:
    """Buckets of a token's character 3- and 4-grams; a shorter token counts once for each n."""
    grams = (token[i : i + n] for n in (3, 4) for i in range(max(len(token) - n + 1, 1)))
    return np.array([zlib.crc32(g.encode()) % dimension for g in grams], np.int32)
