"""Operators 2 and 9: merge-type sentence pieces, counted and encoded.

The model merges, again and again, the adjacent pair whose joined string is the piece of the best score (leftmost among
equals), starting from single characters; what stays outside the vocabulary becomes bytes. No piece has a space sign
after another character, so nothing is merged across the start of a run of spaces: a text falls into pre-tokens there,
and equal pre-tokens get equal pieces. A worker keeps those it has met in a table that grows to a bound.

Both operators: a null text is the empty text and has no pieces (one id with an end id); other columns of the input
are left aside; repeated rows each give a row.
"""

from __future__ import annotations

import gc
import heapq
import re
from functools import cached_property

from pyspark.sql import DataFrame

from loomspark.llm.batches import map_batches, texts_of

SPACE = "▁"
#: Pre-tokens at which a table stops to grow.
TABLE_ENTRIES = 400_000
KEPT_CHARS = 64
#: Longer pre-tokens are merged with a heap: simultaneous rounds would be as many as their characters.
LONG = 200
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")
_MODELS: dict = {}


class Pieces:
    """The vocabulary of a model file, as the library gives it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        self.ids = {self.names[i]: i for i in plain}
        self.end_id = sp.eos_id()
        self.controls = {i for i in range(len(self.names)) if sp.is_control(i)}
        # equal scores share a rank: among them the leftmost pair is first
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.names[i]: order[sp.get_score(i)] for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece spans words or has a character of its own")

    # -- reference merging, for long pre-tokens, pairs and single pieces

    def merged(self, s: str) -> list[str]:
        """Symbols of s after all merges, by a heap of pairs."""
        rank, n = self.rank, len(s)
        if n <= 24:
            sym = list(s)
            while len(sym) > 1:
                best, at = None, -1
                for i in range(len(sym) - 1):
                    r = rank.get(sym[i] + sym[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                sym[at : at + 2] = [sym[at] + sym[at + 1]]
            return sym
        sym: list[str | None] = list(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, s[i : i + 2]) for i in range(n - 1) if (r := rank.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get(both + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, both + sym[k]))
            if (h := left[i]) >= 0 and (r := rank.get(sym[h] + both)) is not None:
                heapq.heappush(heap, (r, h, sym[h] + both))
        return [x for x in sym if x is not None]

    # -- operator 2

    @cached_property
    def pairs(self):
        """Sorted keys left * size + right of all pairs of pieces that join to a piece, with its rank and id."""
        import numpy as np

        size, found = len(self.names), []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    found.append((a * size + b, self.rank[p], i))
        found.sort()
        return tuple(np.array(c, dtype=np.int64) for c in zip(*found, strict=True))

    def count_batch(self, words: list[str]) -> list[int]:
        """Symbols that survive in each word, all words merged together round by round.

        The words lie end to end in one array with their offsets. In a round every word applies its lowest-rank
        pair (the leftmost of these); words without a pair leave the arrays with their count.
        """
        import numpy as np

        size, (keys, ranks, made) = len(self.names), self.pairs
        none, out = np.int64(1 << 40), np.zeros(len(words), np.int64)
        get = self.ids.get
        sym = np.fromiter((get(c, -len(c.encode("utf-8", "surrogatepass"))) for w in words for c in w), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        who = np.arange(len(words))

        def rank_of(a, b):
            key = np.where((a < 0) | (b < 0), -1, a * size + b)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            return np.where(hit, ranks[at], none), np.where(hit, made[at], -1)

        word = np.repeat(who, lens)
        # ranks of the pair that begins at each symbol; the last symbol of a word has none
        pair, join = np.full(len(sym), none), np.full(len(sym), -1)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(sym) else np.zeros(0, np.int64)
        pair[inner], join[inner] = rank_of(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            ends = np.r_[starts[1:], len(sym)]
            best = np.minimum.reduceat(pair, starts)
            done = best == none
            if done.any():
                weight = np.where(sym < 0, -sym, 1)
                out[word[starts[done]]] = np.add.reduceat(weight, starts)[done]
                stay = np.repeat(~done, ends - starts)
                sym, pair, join, word = sym[stay], pair[stay], join[stay], word[stay]
                continue
            # the first place in each word that has its best rank
            hits = np.flatnonzero(pair == np.repeat(best, ends - starts))
            at = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            sym[at] = join[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            sym, pair, join, word = sym[keep], pair[keep], join[keep], word[keep]
            at = shift[at]
            for x in (at, at - 1):  # only pairs at the new symbols change
                x = x[x >= 0]
                last = (x + 1 >= len(sym)) | (word[np.minimum(x + 1, len(sym) - 1)] != word[x])
                pair[x[last]], join[x[last]] = none, -1
                x = x[~last]
                pair[x], join[x] = rank_of(sym[x], sym[x + 1])
        return out.tolist()

    @cached_property
    def counts(self) -> dict[str, int]:
        return {}

    def count_words(self, words: list[str]) -> dict[str, int]:
        short = [w for w in words if len(w) <= LONG]
        found = {}
        for lo in range(0, len(short), 50_000):
            part = short[lo : lo + 50_000]
            found.update(zip(part, self.count_batch(part), strict=True))
        for w in words:
            if len(w) > LONG:
                found[w] = sum(1 if x in self.ids else len(x.encode()) for x in self.merged(w))
        return found

    # -- operator 9

    @cached_property
    def automaton(self):
        """All pieces that the model gives for their own string; a piece it never gives is no candidate."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in self.ids:
            if self.merged(p) == [p]:
                a.add_word(p, p)
        a.make_automaton()
        return a

    @cached_property
    def shorter(self) -> dict[str, str]:
        """Each candidate's longest proper prefix that is a candidate."""
        out = {}
        for p in self.automaton.keys():
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in self.automaton:
                    out[p] = p[:k]
                    break
        return out

    @cached_property
    def fits(self) -> dict[tuple[str, str], bool]:
        return {}

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b anew stops at exactly a, b."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.merged(a + b) == [a, b]
            if len(self.fits) < TABLE_ENTRIES:
                self.fits[a, b] = known
        return known

    def split(self, s: str) -> list[str]:
        """The pieces of s, all of whose characters are pieces, by backtracking.

        A sequence of pieces is the model's own exactly if each piece is its own encoding and each neighbouring pair is
        compatible, and every prefix has just one. So the longest match is tried first, then its shorter
        prefixes; a position from which nothing fits is marked and never entered again.
        """
        n, shorter, fits = len(s), self.shorter, self.compatible
        longest: list = [None] * n
        for end, p in self.automaton.iter(s):
            k = end + 1 - len(p)
            if longest[k] is None or len(p) > len(longest[k]):
                longest[k] = p
        failed, out, pos = bytearray(n // 8 + 1), [], 0
        piece = longest[0]
        while pos < n:
            while piece is not None and (failed[pos + len(piece) >> 3] >> (pos + len(piece) & 7) & 1 or out and not fits(out[-1], piece)):
                piece = shorter.get(piece)
            if piece is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(piece)
                piece = shorter.get(piece)
                continue
            out.append(piece)
            pos += len(piece)
            piece = longest[pos] if pos < n else None
        return out

    def encode_word(self, w: str) -> tuple[int, ...]:
        ids, out, run = self.ids, [], []
        if all(c in ids for c in w):
            return tuple([ids[p] for p in self.split(w)])
        for c in [*w, None]:
            if c is not None and c in ids:
                run.append(c)
                continue
            if run:
                out += [ids[p] for p in self.split("".join(run))]
                run = []
            if c is not None:
                out += [self.byte_ids[b] for b in c.encode()]
        return tuple(out)

    @cached_property
    def encoded(self) -> dict[str, tuple[int, ...]]:
        return {}

    @cached_property
    def sounds(self) -> list[bytes]:
        """The bytes that each id stands for."""
        by_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        return [b"" if i in self.controls else by_byte.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.names)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and runs of bytes joined, the space that encoding set before the text taken off, broken bytes replaced."""
        sounds = self.sounds
        raw = b"".join([sounds[i] for i in ids])
        first = next((i for i in ids if i not in self.controls), None)
        if first is not None and first not in self.byte_ids.values() and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def pretokens(text: str) -> list[str]:
    """The text cut before each run of spaces, with the space that the model sets in front; an empty text has none."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return _RUNS.findall(SPACE + text.replace(" ", SPACE))
    return text.split(" ")


def _lead(word: str) -> str:
    """pretokens() leaves the sign away where each word has just one."""
    return word if word[:1] == SPACE else SPACE + word


def _known(cut: list[list[str]], table: dict, make) -> dict:
    """What the table lacks of these pre-tokens; the table takes it up while it may grow."""
    missing = {w for c in cut for w in c if w not in table}
    found = make(missing)
    if len(table) < TABLE_ENTRIES:
        table.update((w, v) for w, v in found.items() if len(w) <= KEPT_CHARS)
    return found


def token_counts(documents: DataFrame, model: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text, by rank-synchronous merging of its distinct pre-tokens."""

    def start():
        m = pieces(model)

        def make(words):
            got = m.count_words([_lead(w) for w in words])
            return {w: got[_lead(w)] for w in words}

        def f(ids, texts):
            gc.disable()
            cut = [pretokens(t) for t in texts]
            found, get = _known(cut, m.counts, make), m.counts.get
            n = [sum([found[w] if (v := get(w)) is None else v for w in c]) for c in cut]
            gc.enable()
            return [ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return f

    return map_batches(texts_of(documents), start, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with the end id) and the text that decoding them gives, for every whole text."""
    from itertools import chain

    def start():
        m = pieces(model)
        make = lambda words: {w: m.encode_word(_lead(w)) for w in words}

        def f(ids, texts):
            gc.disable()
            cut = [pretokens(t) for t in texts]
            found, get = _known(cut, m.encoded, make), m.encoded.get
            got = [[*chain.from_iterable([found[w] if (v := get(w)) is None else v for w in c]), m.end_id] for c in cut]
            gc.enable()
            return [ids, got, [m.decode(g) for g in got]]

        return f

    return map_batches(texts_of(documents), start, "doc_id long, ids array<int>, decoded string")


def encoding_digest(documents: DataFrame, model: str) -> DataFrame:
    """The query's columns of encode_documents()."""
    from pyspark.sql import functions as F

    return encode_documents(documents, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


