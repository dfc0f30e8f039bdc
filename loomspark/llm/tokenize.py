"""Whole texts to token ids, by the tokenizers library on distinct pieces of text.

A text is cut only at places where the library's own pre-tokenizer cuts whatever stands on either side, so the ids of
a text are those of its pieces in order. Pieces recur, so each worker keeps a table of pieces it has met,
which grows to a bound and stays; frequent pieces come early. What is not there goes to the library. tests/llm compare the ids with the library's for whole texts.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re
import struct

#: Entries at which a table stops to grow.
TABLE_ENTRIES = 300_000
#: Longer pieces are not kept.
KEPT_CHARS = 64

_REGULAR_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE_RUN = re.compile(r"\s\s")
_LINE_CUT = re.compile(r"(?<=\S)(\n)(?=\S)")
#: A word of Latin letters and the ASCII signs or digits after it: every pre-tokenizer here cuts between the two. An apostrophe may join them, so it isn't among the signs.
_TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-@\[-`{-~]+)")
_LOADED: dict = {}


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    style "byte": the pre-tokenizer gives a space to the word that follows it. A space between two other characters
    always begins a pre-token, and a line end between two such characters is one.
    style "word": white space is dropped, so any space, tab or line end is a cut.
    """

    def __init__(self, path: str, style: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.style = style
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.atoms: dict[str, bytes] = {}  # parts of pieces

    def _pieces(self, text: str) -> list[str]:
        if self.style == "word":
            if "<|" not in text:  # special strings are found in the case they were written in
                with contextlib.suppress(UnicodeEncodeError):
                    text.encode("latin-1")  # in this range lower case is the library's, and comes to the same before its normaliser
                    text = text.lower()
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return _REGULAR_CUT.split(text) if _SPACE_RUN.search(text) else text.split(" ")

    def _by_library(self, strings: list[str]) -> dict[str, bytes]:
        found = {}
        for lo in range(0, len(strings), 256):
            part = strings[lo : lo + 256]
            for s, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[s] = struct.pack(f"<{len(ids := e.ids)}I", *ids)
        return found

    def _found(self, missing: set[str], lead: str) -> dict[str, bytes]:
        """The ids of pieces that a table lacks."""
        parts, atoms, kept = {}, set(), self.atoms
        for p in missing:
            if "\n" in p:
                parts[p] = [a for a in _LINE_CUT.split(lead + p) if a]
            elif m := _TAIL.fullmatch(p):
                parts[p] = [lead + m[1], m[2]]
            else:
                parts[p] = [lead + p]
            atoms.update(parts[p])
        made = self._by_library([a for a in atoms if a not in kept])
        if len(kept) < TABLE_ENTRIES:
            kept.update((a, b) for a, b in made.items() if len(a) <= KEPT_CHARS)
        return {p: b"".join([made[a] if a in made else kept[a] for a in x]) for p, x in parts.items()}

    def _joined(self, cut: list[list[str]], table: dict[str, bytes], lead: str) -> list[bytes]:
        got, gaps, missing = [], [], set()
        for c in cut:
            ids = list(map(table.get, c))
            at, places = -1, []
            with contextlib.suppress(ValueError):
                while True:
                    at = ids.index(None, at + 1)
                    places.append(at)
                    missing.add(c[at])
            got.append(ids)
            gaps.append(places)
        found = self._found(missing, lead)
        for c, ids, places in zip(cut, got, gaps, strict=True):
            for at in places:
                ids[at] = found[c[at]]
        if len(table) < TABLE_ENTRIES:
            table.update((p, b) for p, b in found.items() if len(p) <= KEPT_CHARS)
        return [b"".join(ids) for ids in got]

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # nothing here makes cycles, and the collector would walk all pieces again and again
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        if self.style == "word":
            return self._joined(cut, self.first, "")
        head = self._joined([c[:1] for c in cut], self.first, "")
        return [a + b for a, b in zip(head, self._joined([c[1:] for c in cut], self.spaced, " "), strict=True)]


class RankEncoder:
    """ids of a byte-level vocabulary by its rank file (tiktoken), for the vocabulary of a tokenizers file of style "byte".

    The library of the .json file needs about six times the CPU seconds for the same ids. Texts that hold one of its
    special strings go to the library itself, so that its default for them holds. tests/llm compare both on all rows.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode(t, add_special_tokens=False).ids if any(x in t for x in self.special) else self.ranks.encode_ordinary(t) for t in texts]


def rank_encoder(path: str, ranks_path: str, pattern: str) -> RankEncoder:
    if (path, ranks_path) not in _LOADED:
        _LOADED[path, ranks_path] = RankEncoder(path, ranks_path, pattern)
    return _LOADED[path, ranks_path]


def encoder(path: str, style: str) -> PieceEncoder:
    """The worker's encoder of this vocabulary; later tasks of the worker use it again."""
    if (path, style) not in _LOADED:
        _LOADED[path, style] = PieceEncoder(path, style)
    return _LOADED[path, style]
