"""Structure-aware chunks of one text: tables stay whole, headings go before what they head, paragraphs are packed with overlap."""

import re

from lectern.operators.documents import chunks

#: Words in a chunk at most, and words that a chunk takes over from the one before under the same heading.
MOST, OVERLAP = 220, 40

_MARKED = re.compile(r"#{1,6}\s+\S")
_LABEL = re.compile(r"[^\W\d_][^:|]{1,58}:$")
_GAP = re.compile(r"\S(?:\t+| {2,})\S")


def is_heading(line: str) -> bool:
    """Markdown marks, a short capitalised label that ends in a colon, or a short line of capitals."""
    t = line.strip()
    if _MARKED.match(t):
        return True
    if _LABEL.match(t) and t[0].isupper():
        return True
    return 4 <= len(t) <= 60 and t.upper() == t and sum(c.isalpha() for c in t) >= 3 and t[-1] not in ".;,|" and "|" not in t


def is_row(line: str) -> bool:
    return line.strip().startswith("|") and line.strip().endswith("|") and line.count("|") > 1


def is_aligned(line: str) -> bool:
    return len(line) <= 120 and bool(_GAP.search(line))


def blocks(text: str):
    """(kind, text) of a text's blocks in order: heading, table, or text (a paragraph, ended by a blank line, a heading or a table).

    A table is a run of Markdown rows, or of two lines or more that are aligned in columns.
    """
    lines, i, paragraph = text.split("\n"), 0, []

    def flush():
        if paragraph:
            yield "text", "\n".join(paragraph)
            paragraph.clear()

    while i < len(lines):
        line = lines[i]
        end = i
        while end < len(lines) and is_row(lines[end]):
            end += 1
        if end == i:
            while end < len(lines) and is_aligned(lines[end]):
                end += 1
            end = end if end - i >= 2 else i
        if end > i:
            yield from flush()
            yield "table", "\n".join(x.strip() if is_row(x) else x.rstrip() for x in lines[i:end])
            i = end
            continue
        if not line.strip():
            yield from flush()
        elif is_heading(line):
            yield from flush()
            yield "heading", line.strip()
        else:
            paragraph.append(line.strip())
        i += 1
    yield from flush()


def structured(text: str, most: int = MOST, overlap: int = OVERLAP):
    """(chunk, kind) of a text: text chunks of at most most words of content after their heading, whole tables, and headings that nothing follows.

    Paragraphs under one heading are packed together, each chunk beginning with the last overlap words of the one before. A table
    carries its heading and is never cut. An empty text has none.
    """
    head, waiting, prose = "", False, []

    def packed():
        nonlocal waiting
        for part in chunks(" ".join(prose), most, overlap):
            yield (f"{head}\n{part}" if head else part), "text"
            waiting = False
        prose.clear()

    for kind, block in blocks(text):
        if kind == "text":
            prose.append(block)
            continue
        yield from packed()
        if kind == "heading":
            if waiting:
                yield head, "heading"
            head, waiting = block, True
        else:
            yield (f"{head}\n{block}" if head else block), "table"
            waiting = False
    yield from packed()
    if waiting:
        yield head, "heading"
