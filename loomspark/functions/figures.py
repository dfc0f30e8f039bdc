"""Mentions of numbered figures in prose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A numeric range is written out if it spans at most this many numbers.
LONGEST_RANGE = 100
#: Words that make a label's figures supplementary, and the warnings.
SUPPLEMENT = ("supplementary", "supplemental", "supp.")
NOT_EXPANDED, PANELS_NOT_EXPANDED = "figure_range_not_expanded", "panel_range_not_expanded"
_START = re.compile(rf"(?<!\w)((?:{'|'.join(map(re.escape, SUPPLEMENT))})\s+)?fig(?:ure)?s?\b\.?\s*(?=S?[1-9])", re.I)
_BRACKET = re.compile(r"\s*\(([A-Za-z](?:\s*(?:[-–—,&]|and\b)\s*[A-Za-z])*)\)(?!\w)")
_TOKEN = re.compile(r"\s*(?:(?P<join>,?\s*(?:and|&)\b|,|&)|(?P<to>[-–—]))?\s*(?:(?P<s>S)?(?P<number>[1-9]\d*)(?P<panel>[A-Za-z])?(?![A-Za-z0-9])|(?P<letter>[A-Za-z])(?![A-Za-z0-9]))")


def listed(panels: str) -> tuple[list[str], bool]:
    """Letters of a list such as `a, c-e`, in order; False if a range runs backwards (its ends stay)."""
    out: list[str] = []
    ok = True
    for dash, letter in re.findall(r"([-–—])?\s*([a-z])(?![a-z])", panels.lower()):
        if dash and out and out[-1] < letter:
            out += [chr(c) for c in range(ord(out[-1]) + 1, ord(letter))]
        elif dash:
            ok = False
        if letter not in out:
            out.append(letter)
    return out, ok


def mentions(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, scope, number, panels, warning) for each figure that a label names; all members of a label share its span.

    A label is a prefix and numbers with optional panel letters, plain or in brackets, joined by commas, "and" or dashes. A dash between plain
    numbers of one scope stands for those between; any other range keeps its ends with a warning.
    """
    out, after = [], 0
    for start in _START.finditer(text):
        if start.start() < after:
            continue
        scope, items, warning, end, panel_range = "supplement" if start[1] else "main", [], "", start.end(), False
        while m := _TOKEN.match(text, end):
            if items and not (m["join"] or m["to"]) or not items and (m["join"] or m["to"] or m["letter"]):
                break
            if m["letter"]:
                if not items[-1][2]:
                    break  # a letter after a whole figure is prose
                last = items[-1][2][-1]
                letter = m["letter"].lower()
                if m["to"] and last < letter:
                    items[-1][2].extend(chr(c) for c in range(ord(last) + 1, ord(letter) + 1))
                elif m["to"]:
                    warning = PANELS_NOT_EXPANDED
                elif letter not in items[-1][2]:
                    items[-1][2].append(letter)
            else:
                own = "supplement" if m["s"] else items[-1][0] if items else scope
                panels = [m["panel"].lower()] if m["panel"] else []
                if m["to"]:
                    a, b = int(items[-1][1]), int(m["number"])
                    if own == items[-1][0] and not panels and not items[-1][2] and 0 < b - a <= LONGEST_RANGE:
                        items += [(own, str(n), []) for n in range(a + 1, b)]
                    else:
                        warning = NOT_EXPANDED
                items.append((own, m["number"], panels))
                if bracket := _BRACKET.match(text, m.end()):
                    letters, ok = listed(bracket[1])
                    panels += [c for c in letters if c not in panels]
                    warning = warning if ok else PANELS_NOT_EXPANDED
                    end = bracket.end()
                    continue
            end = m.end()
        after = end
        out += [(start.start(), end, s, n, "".join(p), warning) for s, n, p in items]
    return out


def figure_mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *m) for k, t in zip(batch[key], batch[text], strict=True) for m in mentions(t or "")]
            yield pd.DataFrame(rows, columns=[key, "char_start", "char_end", "scope", "number", "panels", "warning"])

    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, char_start long, char_end long, scope string, number string, panels string, warning string")


#: Block types that are captions, how a caption says that it goes on, and what else may follow its label.
CAPTIONS = ("image_caption", "figure_title")
_GOES_ON = re.compile(r"[\s.|:–—-]*(?:\(\s*)?(?:continued\b|cont\.(?!\w))", re.I)
_PARTED = re.compile(r"\s*[.|:]")


def anchors(text: str, is_caption: bool) -> list[tuple[str, str, str, str, bool]]:
    """(scope, number, panels, warning, whether it goes on from an earlier page) of the figures that a caption is of.

    The text has to begin with their label; figures that it names later are not its own. Unless the block's type says that
    it is a caption, a separator or a mark of continuation has to follow the label.
    """
    found = mentions(text)
    if not found or text[: found[0][0]].strip():
        return []
    begin, end = found[0][:2]
    goes_on = _GOES_ON.match(text, end) is not None
    if not (is_caption or goes_on or _PARTED.match(text, end)):
        return []
    return [(*m[2:], goes_on) for m in found if m[0] == begin]


def caption_anchors(blocks: DataFrame, key: str = "block_id", text: str = "text", kind: str = "type") -> DataFrame:
    """A row for each figure that a block is the caption of; a null text has none, a null type is no caption's."""
    of_key = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *a) for k, t, c in zip(batch[key], batch[text], batch[kind], strict=True) for a in anchors(t or "", c in CAPTIONS)]
            yield pd.DataFrame(rows, columns=[key, "scope", "number", "panels", "warning", "is_continuation"])

    return blocks.select(key, text, kind).mapInPandas(run, f"{key} {of_key}, scope string, number string, panels string, warning string, is_continuation boolean")
