"""Files to chunks: Python symbols, document sections, windows, commits."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from ..plans.storage import scratch_path

CONFIG_SUFFIXES = ("yaml", "yml", "toml", "json", "cfg", "ini")
LINES, OVERLAP, LEAST = 220, 20, 60
DOC_MOST, DOC_LEAST = 4000, 120

_CHUNK = (
    "path string, artifact_type string, language string, start_line int, end_line int, content string, symbol string, symbol_type string, qualified_name string, "
    "parent_symbol string, imports array<string>, references array<string>, decorators array<string>, docstring string, signature string, heading_path array<string>"
)


def windows(df: DataFrame, text: str = "content", limit: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """Each row's text in windows of at most limit lines that share overlap lines; none begins after one that reaches the end."""
    step = max(limit - overlap, 1)
    lines = df.withColumn("lines_", F.split(F.col(text), "\n")).withColumn("o_", F.explode(F.sequence(F.lit(0), F.size("lines_") - 1, F.lit(step))))
    kept = lines.where((F.col("o_") == 0) | (F.col("o_") - step + limit < F.size("lines_")))
    content = F.array_join(F.slice(F.col("lines_"), F.col("o_") + 1, F.lit(limit)), "\n")
    return kept.withColumn("start_line", F.col("o_") + 1).withColumn("end_line", F.least(F.col("o_") + limit, F.size("lines_"))).withColumn("content", content).drop("lines_", "o_")


def cut_at_blanks(text: Column, limit: int = DOC_MOST) -> Column:
    """Line numbers (from 1) of the blank lines that a text of more than limit characters is cut after: the first once a piece has limit characters."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(acc, line):
        size, at = acc["size"] + F.length(line) + 1, acc["at"] + 1
        here = (size >= limit) & line.rlike(r"^\s*$")
        return F.struct(F.when(here, 0).otherwise(size).alias("size"), at.alias("at"), F.when(here, F.concat(acc["cuts"], F.array(at))).otherwise(acc["cuts"]).alias("cuts"))

    return F.when(F.length(text) <= limit, F.array().cast("array<int>")).otherwise(F.aggregate(lines, start, step, lambda acc: acc["cuts"]))


def section_pieces(df: DataFrame, text: str = "content", limit: int = DOC_MOST) -> DataFrame:
    """df with start_line, end_line and content of each piece of a text: cut after blank lines, and evenly where a piece has over twice the limit.

    A text of at most limit characters is one piece; what follows the last cut is one if it isn't blank.
    """
    lines, cuts = F.split(F.col(text), "\n"), cut_at_blanks(F.col(text), limit)
    base = df.withColumn("lines_", lines).withColumn("cuts_", cuts).withColumn("short_", F.length(F.col(text)) <= limit)
    ends = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("cuts_")).alias("a"), F.concat(F.col("cuts_"), F.array(F.size("lines_"))).alias("b"))
    each = base.withColumn("p_", F.explode(ends)).withColumn("a_", F.col("p_.a")).withColumn("b_", F.col("p_.b")).where("a_ < b_")
    own = F.slice(F.col("lines_"), F.col("a_") + 1, F.col("b_") - F.col("a_"))
    written = F.exists(own, lambda x: ~x.rlike(r"^\s*$"))
    each = each.where(F.col("short_") | F.array_contains("cuts_", F.col("b_")) | written)
    chars = F.aggregate(own, F.lit(0), lambda n, x: n + F.length(x)) + F.col("b_") - F.col("a_") - 1
    n = F.col("b_") - F.col("a_")
    step = F.when(F.col("short_") | (chars <= 2 * limit), n).otherwise(F.greatest(F.floor(n / (F.floor(chars / limit) + 1)).cast("int"), F.lit(1)))
    each = each.withColumn("step_", step).withColumn("i_", F.explode(F.sequence(F.col("a_"), F.col("b_") - 1, F.col("step_"))))
    end = F.least(F.col("i_") + F.col("step_"), F.col("b_"))
    content = F.array_join(F.slice(F.col("lines_"), F.col("i_") + 1, end - F.col("i_")), "\n")
    return each.withColumn("start_line", F.col("i_") + 1).withColumn("end_line", end).withColumn("content", content).drop("lines_", "cuts_", "short_", "p_", "a_", "b_", "step_", "i_")


def html_headings(html: Column) -> Column:
    """(level, title) of the headings of a page, in order."""
    pattern = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("t"))
    return F.transform(pairs, lambda z: F.struct(z["l"].cast("int").alias("level"), F.trim(F.regexp_replace(z["t"], "<[^>]*>", "")).alias("title")))


def html_sections(html: Column) -> Column:
    """(level, title, path, body) of the sections of a page: each heading with those it stands under and the text up to the next one.

    A heading ends the sections of its level and of deeper ones: one fold over the headings keeps the open ones.
    """
    head = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"
    bodies = F.split(html, head)
    start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("open"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc, h):
        still = F.concat(F.filter(acc["open"], lambda o: o["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        return F.struct(still.alias("open"), F.concat(acc["paths"], F.array(F.transform(still, lambda o: o["title"]))).alias("paths"))

    heads = html_headings(html)
    paths = F.aggregate(heads, start, step, lambda acc: acc["paths"])
    text = lambda i: F.trim(F.regexp_replace(F.regexp_replace(F.element_at(bodies, i + 2), "<[^>]*>", " "), r"[ \t\n\r\f]+", " "))
    return F.transform(heads, lambda h, i: F.struct(h["level"].alias("level"), h["title"].alias("title"), F.element_at(paths, i + 1).alias("path"), text(i).alias("body")))


def split_long(start: int, lines: list[str], limit: int, overlap: int) -> Iterator[tuple[int, list[str]]]:
    step = max(limit - overlap, 1)
    for at in range(0, max(len(lines), 1), step):
        if at and at - step + limit >= len(lines):
            break
        yield start + at, lines[at : at + limit]


#: What a module's overview lists at most: imports, lines of its interface, methods of a class.
IMPORTS, API_LINES, METHODS = 60, 80, 25


class PythonChunks:
    """Chunks of a Python module: an overview of it, of each class, and each function and method of a module or class body."""

    def __init__(self, path: str, source: str, limit: int = LINES, overlap: int = OVERLAP, least: int = LEAST):
        self.path, self.lines, self.limit, self.overlap, self.least = path, source.split("\n"), limit, overlap, least
        self.module = re.sub(r"(^|\.)__init__$", "", re.sub(r"\.py$", "", path).replace("/", "."))
        self.tree = ast.parse(source)
        found = set()
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Import):
                found |= {a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                base = "." * node.level + (node.module or "")
                found |= {base} if base.strip(".") else {base + a.name for a in node.names}
        self.imports = sorted(found)

    def row(self, start: int, content: str, **more) -> dict:
        end = more.pop("end", None) or start + content.count("\n")
        base = {"path": self.path, "language": "python", "start_line": start, "end_line": end, "content": content, "imports": self.imports, "references": [], "decorators": [], "heading_path": []}
        return base | more

    def signature(self, node) -> str:
        if isinstance(node, ast.ClassDef):
            bases = ", ".join(ast.unparse(b) for b in node.bases)
            return f"class {node.name}" + (f"({bases})" if bases else "")
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}){returns}"

    def overview(self) -> list[str]:
        """Signatures of a module's classes, with the first of their methods, and functions, and its constants, annotated ones too."""
        out = []
        for node in self.tree.body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(self.signature(node))
                if isinstance(node, ast.ClassDef):
                    out += ["    " + self.signature(m) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))][:METHODS]
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                out += [t.id for t in targets if isinstance(t, ast.Name) and t.id.isupper()]
        return out[:API_LINES]

    def rows(self) -> Iterator[dict]:
        parts = [f"module {self.module}", ast.get_docstring(self.tree) or "", *(f"import {i}" for i in self.imports[:IMPORTS]), *self.overview()]
        yield self.row(1, "\n".join(p for p in parts if p), end=len(self.lines), symbol=self.module.split(".")[-1], symbol_type="module", qualified_name=self.module, docstring=ast.get_docstring(self.tree))
        for node in self.tree.body:
            yield from self.of(node, None)

    def of(self, node, parent: str | None) -> Iterator[dict]:
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            return
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        end = min(node.end_lineno or node.lineno, len(self.lines))
        name = f"{parent}.{node.name}" if parent else node.name
        calls = {ast.unparse(c.func) for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
        common = {
            "symbol": node.name, "qualified_name": f"{self.module}.{name}" if self.module else name, "parent_symbol": parent, "docstring": ast.get_docstring(node),
            "signature": self.signature(node), "decorators": [ast.unparse(d) for d in node.decorator_list],
        }
        if isinstance(node, ast.ClassDef):
            inner = [ast.unparse(x) for x in node.body if isinstance(x, (ast.Assign, ast.AnnAssign))]
            methods = [self.signature(x) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            head = self.lines[start - 1 : node.body[0].lineno - 1] or [self.lines[node.lineno - 1]]
            text = "\n".join([*head, *([f'    """{common["docstring"]}"""'] if common["docstring"] else []), *("    " + x for x in inner + methods)])
            yield self.row(start, text, end=end, symbol_type="class", references=sorted({ast.unparse(b) for b in node.bases}), **common)
            for x in node.body:
                yield from self.of(x, name)
            return
        for at, some in split_long(start, self.lines[start - 1 : end], self.limit, self.overlap):
            yield self.row(at, "\n".join(some), symbol_type="method" if parent else "function", references=sorted(calls), **common)


def python_chunks(path: str, source: str, limit: int = LINES, overlap: int = OVERLAP, least: int = LEAST) -> list[dict]:
    """Chunks of a Python file; one that doesn't parse is cut into windows of kind 'file'."""
    try:
        found = list(PythonChunks(path, source, limit, overlap, least).rows())
    except (SyntaxError, ValueError, RecursionError):
        lines = source.split("\n")
        return [{"path": path, "language": "python", "start_line": at, "end_line": at + len(some) - 1, "content": "\n".join(some), "symbol_type": "file"} for at, some in split_long(1, lines, limit, 0)]
    return [r for r in found if len(r["content"].strip()) >= least]


_MARKS = "array<struct<at:int,level:int,title:string>>"
_CUTS = "array<struct<at:int,path:array<string>>>"
_OPEN = "array<struct<level:int,title:string>>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _opened(acc: Column, level: Column, title: Column, at: Column) -> tuple[Column, Column]:
    """The headings that stay open under a new one, with it, and the cuts with the one that it makes."""
    still = F.concat(F.filter(acc["open"], lambda o: o["level"] < level), F.array(F.struct(level.alias("level"), title.alias("title"))))
    return still, F.concat(acc["cuts"], F.array(F.struct(at.alias("at"), F.transform(still, lambda o: o["title"]).alias("path"))))


def _spans(cuts: Column, n: Column) -> Column:
    """(first, last, path) between cuts and up to line n; what stands before the first cut has no path, an empty span is left out."""
    every = F.concat(F.array(F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("path"))), cuts)
    ends = F.concat(F.transform(cuts, lambda c: c["at"] - 1), F.array(n))
    spans = F.transform(F.arrays_zip(every.alias("c"), ends.alias("e")), lambda z: F.struct(z["c"]["at"].alias("first"), z["e"].alias("last"), z["c"]["path"].alias("path")))
    return F.filter(spans, lambda x: x["last"] >= x["first"])


def markdown_sections(lines: Column) -> Column:
    """(first line, last line, heading path) of each section of a text's lines.

    Fences and headings are picked out as arrays; one fold over them keeps whether a fence is open, in which
    headings are text, and which headings are. What stands before the first heading has no path.
    """
    head = r"(?s)^(#{1,6})\s+(.*?)\s*#*\s*$"
    mark = lambda x, i: F.struct((i + 1).alias("at"), F.when(x.rlike(r"^\s*(```|~~~)"), 0).otherwise(F.length(F.regexp_extract(x, head, 1))).alias("level"), F.regexp_extract(x, head, 2).alias("title"))
    marks = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z["x"].rlike(r"^\s*(```|~~~)|^#{1,6}\s")), lambda z: mark(z["x"], z["i"])).cast(_MARKS)
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast(_OPEN).alias("open"), F.array().cast(_CUTS).alias("cuts"))

    def step(acc, m):
        fence = m["level"] == 0
        still, cuts = _opened(acc, m["level"], m["title"], m["at"])
        text = fence | acc["fenced"]
        return F.struct((acc["fenced"] != fence).alias("fenced"), F.when(text, acc["open"]).otherwise(still).alias("open"), F.when(text, acc["cuts"]).otherwise(cuts).alias("cuts"))

    return _spans(F.aggregate(marks, start, step, lambda acc: acc["cuts"]), F.size(lines))


def rst_sections(lines: Column) -> Column:
    """The same for reST: a title has a line of one punctuation mark below it, levels go by the mark's first use.

    Each line is zipped with the one below it, and one fold over the titles keeps the marks that were seen.
    """
    both = F.arrays_zip(lines.alias("t"), F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit(""))).alias("u"))
    clean = F.transform(both, lambda z, i: F.struct((i + 1).alias("at"), stripped(z["t"]).alias("title"), F.regexp_replace(z["u"], r"\s+$", "").alias("under")))
    titled = lambda z: (z["title"] != "") & (F.length(z["under"]) >= F.greatest(F.lit(3), F.length(z["title"]) - 2)) & z["under"].rlike("^([=\\-~^\"'`#*+.:_])\\1*$") & ~z["title"].rlike(r"(?U)^(\W)\1*$")
    start = F.struct(F.lit("").alias("seen"), F.array().cast(_OPEN).alias("open"), F.array().cast(_CUTS).alias("cuts"))

    def step(acc, m):
        own = F.left(m["under"], F.lit(1))
        seen = F.when(F.contains(acc["seen"], own), acc["seen"]).otherwise(F.concat(acc["seen"], own))
        still, cuts = _opened(acc, F.instr(seen, own), m["title"], m["at"])
        return F.struct(seen.alias("seen"), still.alias("open"), cuts.alias("cuts"))

    return _spans(F.aggregate(F.filter(clean, titled), start, step, lambda acc: acc["cuts"]), F.size(lines))


def sections(docs: DataFrame, text: str, find: Callable[[Column], Column]) -> DataFrame:
    """docs with first, last, heading_path and section (the text) of each section that find sees in the lines of a text."""
    lined = docs.withColumn("lines_", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    each = lined.withColumn("s_", F.explode(find(F.col("lines_"))))
    own = F.array_join(F.slice("lines_", F.col("s_.first"), F.col("s_.last") - F.col("s_.first") + 1), "\n")
    return each.select(*docs.columns, F.col("s_.first").alias("first"), F.col("s_.last").alias("last"), F.col("s_.path").alias("heading_path"), own.alias("section"))


def document_chunks(docs: DataFrame, language: str, most: int = DOC_MOST, least: int = DOC_LEAST) -> DataFrame:
    """Chunks of documents (file, content): their sections, the long ones in pieces, the short ones left out."""
    cut = section_pieces(sections(docs, "content", rst_sections if language == "rst" else markdown_sections).drop("content"), "section", most)
    last = F.when(F.size("heading_path") > 0, F.element_at("heading_path", -1))
    return cut.where(F.length(stripped(F.col("content"))) >= least).select(
        F.col("file").alias("path"), F.lit(language).alias("language"), (F.col("first") + F.col("start_line") - 1).alias("start_line"), (F.col("first") + F.col("end_line") - 1).alias("end_line"), "content",
        last.alias("symbol"), F.lit("section").alias("symbol_type"), F.nullif(F.array_join("heading_path", " > "), F.lit("")).alias("qualified_name"), "heading_path",
    )


def config_chunks(files: DataFrame, limit: int = LINES, least: int = LEAST) -> DataFrame:
    """Chunks of settings (file, content): windows of lines, the short ones left out."""
    cut = windows(files, "content", limit, 0).where(F.length(stripped(F.col("content"))) >= least)
    return cut.select(F.col("file").alias("path"), F.lower(F.substring_index("file", ".", -1)).alias("language"), "start_line", "end_line", "content", F.lit("file").alias("symbol_type"))


def parse_files(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content) by their suffix; those of an unknown one have none.

    Files are written once by kind, so that each kind is read on its own. Python is parsed a file at a
    time where it lies; documents and settings are cut by array functions.
    """
    suffix = F.lower(F.substring_index("path", ".", -1))
    kind = F.when(suffix == "py", "py").when(suffix.isin("md", "rst"), suffix).when(suffix.isin(*CONFIG_SUFFIXES), "config")
    at = scratch_path(files.sparkSession, "files")
    source = F.regexp_replace(F.coalesce("content", F.lit("")), r"\r\n?", "\n")
    files.select(F.col("path").alias("file"), source.alias("content"), kind.alias("kind")).where("kind is not null").write.partitionBy("kind").parquet(at)
    every = files.sparkSession.read.schema("file string, content string, kind string").parquet(at)
    own = lambda name: every.where(F.col("kind") == name).select("file", "content")
    names = [x.split()[0] for x in re.findall(r"(?:^|, )(\w+ \w+(?:<\w+>)?)", _CHUNK)]

    def run(batches):
        for batch in batches:
            rows = [r for path, text in zip(batch["file"], batch["content"], strict=True) for r in python_chunks(path, text)]
            lists = ("imports", "references", "decorators", "heading_path")
            yield pd.DataFrame([{n: r.get(n, [] if n in lists else None) for n in names} for r in rows], columns=names)

    parsed = own("py").mapInPandas(run, _CHUNK)
    for some in (document_chunks(own("md"), "markdown"), document_chunks(own("rst"), "rst"), config_chunks(own("config"))):
        parsed = parsed.unionByName(some, allowMissingColumns=True)
    empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("imports", "references", "decorators", "heading_path")}
    what = F.lower(F.substring_index("path", ".", -1))
    artifact = F.when(what == "py", F.when(is_test_path(F.col("path")), "test").otherwise("source")).when(what.isin("md", "rst"), "doc").otherwise("config")
    return parsed.withColumns(empty).withColumn("artifact_type", artifact).select(*names)
