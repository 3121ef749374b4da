"""Sections of Markdown and reST by plain loops over lines, for tests to compare with."""

import re


def markdown_sections(lines: list[str]) -> list[tuple[int, int, list[str]]]:
    """(first line, last line, heading path) of each section; headings inside fences are text, what stands before the first is a section without a path."""
    cuts, stack, fenced = [(1, [])], [], False
    for i, line in enumerate(lines, 1):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2])]
            cuts.append((i, [t for _, t in stack]))
    ends = [at - 1 for at, _ in cuts[1:]] + [len(lines)]
    return [(at, end, path) for (at, path), end in zip(cuts, ends, strict=True) if end >= at]


def rst_sections(lines: list[str]) -> list[tuple[int, int, list[str]]]:
    """The same for reST: a title has a line of one punctuation mark below it, levels go by the mark's first use."""
    cuts, stack, marks = [(1, [])], [], []
    for i in range(1, len(lines)):
        title, under = lines[i - 1].strip(), lines[i].rstrip()
        if title and len(under) >= max(3, len(title) - 2) and len(set(under)) == 1 and under[0] in "=-~^\"'`#*+.:_" and not re.fullmatch(r"(\W)\1*", title):
            if under[0] not in marks:
                marks.append(under[0])
            level = marks.index(under[0])
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            cuts.append((i, [t for _, t in stack]))
    ends = [at - 1 for at, _ in cuts[1:]] + [len(lines)]
    return [(at, end, path) for (at, path), end in zip(cuts, ends, strict=True) if end >= at]


def cut_section(start: int, lines: list[str], most: int) -> list[tuple[int, list[str]]]:
    """A long section in pieces: after blank lines once a piece has most characters, and evenly where one still has over twice that."""
    if sum(map(len, lines)) + len(lines) - 1 <= most:
        return [(start, lines)]
    pieces, at, size = [], 0, 0
    for i, line in enumerate(lines):
        size += len(line) + 1
        if size >= most and not line.strip():
            pieces.append((at, i + 1))
            at, size = i + 1, 0
    if any(x.strip() for x in lines[at:]):
        pieces.append((at, len(lines)))
    out = []
    for a, b in pieces:
        chars = sum(map(len, lines[a:b])) + b - a - 1
        step = b - a if chars <= 2 * most else max((b - a) // (chars // most + 1), 1)
        out += [(start + i, lines[i : min(i + step, b)]) for i in range(a, b, step)]
    return out
