"""Texts put together and cut: pages, sections, chunks and batches. Folds over one document's blocks in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Titles, without their numbers and in lower case, that begin a major section.
MAJORS = {
    "abstract": "abstract", "summary": "abstract", "introduction": "introduction", "results": "results", "results and discussion": "results_and_discussion",
    "discussion": "discussion", "methods": "methods", "online methods": "methods", "materials and methods": "methods", "materials & methods": "methods",
    "conclusions": "conclusion", "conclusion": "conclusion", "significance": "significance", "references": "references", "acknowledgments": "acknowledgments",
    "acknowledgements": "acknowledgments", "funding": "funding", "author contributions": "author_contributions", "authorship": "author_contributions",
    "disclosures": "disclosures", "supplementary material": "supplementary_material",
}
FRONT = {"abstract", "introduction", "significance"}
FURNITURE = {"header", "footer", "page_number"}
_NUMBERED = re.compile(r"^\s*\d+(?:\.\d+)*[.\s]+")
_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


def assembled(blocks: DataFrame, group: list[str], order: str, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """group, order and the half-open place of each block in its group's text, which is the blocks joined in order."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + len(separator)).over(w), F.lit(0)).cast("long")
    return blocks.select(*group, order, text, start.alias("char_start"), (start + F.length(text)).alias("char_end"))


def role(title: str) -> str | None:
    return MAJORS.get(_NUMBERED.sub("", title).strip().lower())


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """key, ord, section_no, major of each block (key, ord, type, text).

    A title begins a section if it names a major one, or if the present major isn't a front one. A title without such a
    name joins a section that holds only titles and page furniture so far.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        no, major, bare, out = 0, None, True, []
        for i, (k, o, t, x) in enumerate(pdf.sort_values("ord")[[key, "ord", "type", "text"]].itertuples(index=False)):
            if t == "title":
                named = role(x or "")
                begins = named is not None or major not in FRONT and major is not None
                if begins and i and not (bare and named is None):
                    no, bare = no + 1, True
                major = named or major
            elif t not in FURNITURE:
                bare = False
            out.append((k, o, no, major))
        return pd.DataFrame(out, columns=[key, "ord", "section_no", "major"])

    return blocks.select(key, "ord", "type", "text").groupBy(key).applyInPandas(fold, f"{key} {kind}, ord long, section_no long, major string")


def bounded_chunks(blocks: DataFrame, key: str, max_chars: int = 12_000, max_pages: int = 2, separator: int = 2) -> DataFrame:
    """key, ord, chunk_no: consecutive blocks (key, ord, page, chars) together while they keep within both bounds; a block that is too long by itself is a chunk."""
    kind = blocks.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        no, chars, pages, out = 0, 0, set(), []
        for k, o, page, n in pdf.sort_values("ord")[[key, "ord", "page", "chars"]].itertuples(index=False):
            if pages and (chars + separator + n > max_chars or len(pages | {page}) > max_pages):
                no, chars, pages = no + 1, 0, set()
            chars += n + (separator if pages else 0)
            pages.add(page)
            out.append((k, o, no))
        return pd.DataFrame(out, columns=[key, "ord", "chunk_no"])

    return blocks.select(key, "ord", "page", "chars").groupBy(key).applyInPandas(fold, f"{key} {kind}, ord long, chunk_no long")


def split_ranges(text: str, limit: int) -> list[tuple[int, int]]:
    """A text's half-open ranges of at most limit characters, each ending after its last line feed or else space, if it has one."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = max(text.rfind("\n", at, at + limit), -1)
        if cut < at:
            cut = text.rfind(" ", at, at + limit)
        end = cut + 1 if cut >= at else at + limit
        out.append((at, end))
        at = end
    return [*out, (at, len(text))]


def split_texts(documents: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, char_start, char_end of the ranges of every text that isn't empty."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, a, b) for k, t in zip(batch[key], batch[text], strict=True) if t for i, (a, b) in enumerate(split_ranges(t, limit))]
            yield pd.DataFrame(rows, columns=[key, "part", "char_start", "char_end"])

    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, part long, char_start long, char_end long")


def pair_batches(pairs: DataFrame, max_nodes: int, max_pairs: int) -> DataFrame:
    """group, a, b, batch_no: pairs of a group in order, a new batch where distinct nodes or pairs would exceed their bound."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        no, nodes, n, out = 0, set(), 0, []
        for g, a, b in pdf.sort_values(["a", "b"])[["group", "a", "b"]].itertuples(index=False):
            if n and (len(nodes | {a, b}) > max_nodes or n >= max_pairs):
                no, nodes, n = no + 1, set(), 0
            nodes |= {a, b}
            n += 1
            out.append((g, a, b, no))
        return pd.DataFrame(out, columns=["group", "a", "b", "batch_no"])

    return pairs.select("group", "a", "b").groupBy("group").applyInPandas(fold, "group long, a long, b long, batch_no long")


def html_headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, heading_no, level, title, heading_path (joined by ' > ') of the headings of web pages in order."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html import unescape

        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[html], strict=True):
                path: list[tuple[int, str]] = []
                for i, m in enumerate(_HEADING.finditer(t or "")):
                    level, title = int(m[1]), " ".join(unescape(_TAG.sub(" ", m[2])).split())
                    path = [x for x in path if x[0] < level] + [(level, title)]
                    rows.append((k, i, level, title, " > ".join(x[1] for x in path)))
            yield pd.DataFrame(rows, columns=[key, "heading_no", "level", "title", "heading_path"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, heading_no long, level int, title string, heading_path string")


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#*)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")


def markdown_groups(text: str) -> list[dict]:
    """Heading groups of a markdown text, which together are the whole text.

    A heading (by number signs or underlined, not in fenced code, quotes or lists) begins a group. A heading followed only
    by blanks and a deeper heading shares its group. Text before the first heading is a group if it isn't blank.
    """
    starts, at = [], 0
    for m in re.finditer(r"[^\r\n]*(?:\r\n|\r|\n|$)", text):
        if m[0]:
            starts.append((m.start(), m[0].rstrip("\r\n")))
    found, fence, before = [], None, None
    for i, (at, line) in enumerate(starts):
        shown = line.removeprefix("﻿") if not i else line
        if fence:
            if (m := _FENCE.match(shown)) and m[1].startswith(fence) and not m[2].strip():
                fence = None
            before = None
            continue
        if (m := _FENCE.match(shown)) and not (m[1][0] == "`" and "`" in m[2]):
            fence, before = m[1], None
        elif m := _ATX.match(shown):
            found.append((at, i + 1, len(m[1]), (m[2] or "").strip()))
            before = None
        elif before is not None and (m := _UNDER.match(shown)):
            found.append((starts[before][0], i + 1, 1 if m[1][0] == "=" else 2, " ".join(x[1].strip() for x in starts[before:i])))
            before = None
        elif not shown.strip() or re.match(r"\s{4,}|\s*>|\s*[-*+]\s|\s*\d+[.)]\s", shown) and before is None:
            before = None
        elif before is None:
            before = i
    ends = [starts[x[1]][0] if x[1] < len(starts) else len(text) for x in found]
    groups, stack, i = [], [], 0
    head = found[0][0] if found else len(text)
    if not found or text[:head].removeprefix("﻿").strip():
        groups.append({"char_start": 0, "char_end": head, "titles": [], "path": []})
        first = head
    else:
        first = 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j][2] < found[j + 1][2] and not text[ends[j] : found[j + 1][0]].strip():
            j += 1
        for x in found[i : j + 1]:
            stack = [s for s in stack if s[0] < x[2]] + [(x[2], x[3])]
        end = found[j + 1][0] if j + 1 < len(found) else len(text)
        groups.append({"char_start": first, "char_end": end, "titles": [x[3] for x in found[i : j + 1]], "path": [s[1] for s in stack]})
        first, i = end, j + 1
    return groups


def markdown_table(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, group_no, char_start, char_end, byte_start, byte_end, heading_path of every markdown text."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                byte = 0
                for i, g in enumerate(markdown_groups(t) if t is not None else ()):
                    n = len(t[g["char_start"] : g["char_end"]].encode())
                    rows.append((k, i, g["char_start"], g["char_end"], byte, byte + n, " > ".join(g["path"])))
                    byte += n
            yield pd.DataFrame(rows, columns=[key, "group_no", "char_start", "char_end", "byte_start", "byte_end", "heading_path"])

    return files.select(key, text).mapInPandas(run, f"{key} {kind}, group_no long, char_start long, char_end long, byte_start long, byte_end long, heading_path string")
