"""Operator 5: toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

fit() learns the lexicon and the weights from labelled rows: terms are whole words, or beginnings that many words share,
which documents labelled toxic hold far more often than others. The trie holds them all. A word of a text is matched by
walking its Levenshtein automaton and the trie together: a state of the automaton is the row of edit distances to the
part of a term read so far, and a branch ends where every entry is above the bound. A word is reached where the last
entry is within the bound, a beginning where any entry is, as then some beginning of the text's word is near it. So
misspelt terms of both kinds are caught without listing them. Each hit is judged where it stands: between two quotation
marks that pair, or after a verb of reporting, it counts as quoted and by QUOTED_SHARE in each other count, beside a
pronoun of address as directed. A logistic model over the counts of hits by kind gives the score; what it weighs has
prior means, so that kinds that no labelled row shows keep a sensible weight.

Fitted on at most SAMPLE_ROWS labelled rows, chosen by a hash of doc_id, so that its cost doesn't grow. For the lexicon, of
near copies among them (one least shingle and label) one counts, or each word of a text that is copied often would tell;
terms are words of 3 to 40 letters. Every document is scored whole. Labels, language, source and doc_id are no inputs of a score. A null text is the empty text and has no
hits. Without labelled rows of both classes the lexicon is empty and the prior weights hold. Repeated rows each give a
row; a doc_id labelled twice counts as toxic if one label says so. Only the columns named are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.batches import groups, map_batches, schema_of, small_batches, texts_of
from loomspark.sources.workspace import written

SAMPLE_ROWS = 8000
THRESHOLD = 0.7
#: What a quoted hit counts for, beside being quoted.
QUOTED_SHARE = 0.25
TABLE_ENTRIES = 300_000
PREFIXES = range(5, 9)

_WORD = re.compile(r"[^\W\d_]+")
_EDGE = " \t\n.,;:!?\"'()[]{}<>|*#&%$“”„«»‘’…-–—"
_LEET = str.maketrans("013457@$!", "oieastasi")
#: Signs and words by which a hit counts as quoted or as directed at someone.
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’"}
#: Signs open at once at most, the last ones: those that never close don't add up.
LEVELS = 8
_MARK = re.compile("[\"“”„«»‘’‚]")
_TOKEN = re.compile(r"\S+")
REPORTING = frozenset("said says wrote quoted called calling word term sagte schrieb zitat wort dit écrit mot dijo escribió palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein ihr sie tu toi ton vous te ti usted".split())
#: bias, exact hits, misspelt hits, hits of beginnings, quoted, directed, share of words and distinct terms without misspelt ones
PRIOR = [-3.0, 1.5, 0.5, 0.3, -1.0, 0.5, 0.1, 0.5]


def distance_bound(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms: word -> weight for whole words, beginning -> weight for beginnings."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.root: dict = {}
        for end, terms in (("word", words), ("start", beginnings)):
            for term in terms:
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                    node[f"most {end}"] = max(node.get(f"most {end}", 0), distance_bound(term))
                node[end] = term
        self.widest = max(map(distance_bound, [*words, *beginnings]), default=0)
        self.known: dict[str, tuple | None] = {}
        self.judged: dict[str, tuple | None] = {}
        self.start_sizes = sorted({len(t) for t in beginnings}, reverse=True)
        # b edits leave one of b + 1 parts of a term whole: (place, part) -> lengths that a word with it may have
        self.parts: dict[tuple[int, str], set[int]] = {}
        for t in words:
            if b := distance_bound(t):
                cuts = [len(t) * i // (b + 1) for i in range(b + 2)]
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    place = 0 if i == 0 else 2 if i == b else 1
                    self.parts.setdefault((place, t[lo:hi]), set()).update(range(len(t) - b, len(t) + b + 1))
        self.heads, self.tails = ({k[1]: v for k, v in self.parts.items() if k[0] == p} for p in (0, 2))
        self.middles = [(k[1], v) for k, v in self.parts.items() if k[0] == 1]
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in self.heads}), sorted({len(h) for h in self.tails})
        self.lengths = set().union(*self.parts.values())
        # of a beginning, parts after the first are whole within b letters of their place
        self.start_heads: set[str] = set()
        self.start_parts: dict[int, dict[str, set[int]]] = {}
        for t in beginnings:
            if b := distance_bound(t):
                cuts = [len(t) * i // (b + 1) for i in range(b + 2)]
                self.start_heads.add(t[: cuts[1]])
                for lo, hi in zip(cuts[1:], cuts[2:], strict=False):
                    self.start_parts.setdefault(hi - lo, {}).setdefault(t[lo:hi], set()).update(range(max(0, lo - b), lo + b + 1))
        self.start_head_sizes = sorted({len(h) for h in self.start_heads})
        self.start_reach = {k: range(max(max(v) for v in held.values()) + 1) for k, held in self.start_parts.items()}

    def near(self, word: str) -> bool:
        """Whether some term's part is whole where an edited term would have it: else no walk is needed."""
        n, none = len(word), ()
        return n in self.lengths and (
            any(n in self.heads.get(word[:k], none) for k in self.head_sizes) or any(n in self.tails.get(word[-k:], none) for k in self.tail_sizes) or any(n in v and m in word for m, v in self.middles)
        )

    def near_start(self, word: str) -> bool:
        """The same for beginnings."""
        return any(word[:k] in self.start_heads for k in self.start_head_sizes) or any(i in held.get(word[i : i + k], ()) for k, held in self.start_parts.items() for i in self.start_reach[k])

    def walked(self, word: str, end: str) -> tuple[int, str] | None:
        """(distance, term) of the nearest term of the trie that ends so: as a "word", or as a "start" of which any beginning of word is near.

        Of a row only the entries are worked out that can be within the widest bound, those at most that far from the
        row's depth. A branch is left where no term that ends so has a bound as wide as the row's least entry.
        """
        best: tuple | None = None
        n, widest, most = len(word), self.widest, f"most {end}"
        far = widest + 1

        def walk(node: dict, depth: int, row: list[int]) -> None:
            nonlocal best
            lo, hi = max(1, depth - widest), min(n, depth + widest)
            for c, below in node.items():
                if len(c) > 1 or most not in below:
                    continue
                new = [far] * (n + 1)
                left = least = new[lo - 1] = min(far, depth) if lo == 1 else far
                for k in range(lo, hi + 1):
                    x = row[k - 1] if word[k - 1] == c else row[k - 1] + 1
                    if row[k] < x:
                        x = row[k] + 1
                    if left < x:
                        x = left + 1
                    left = new[k] = x
                    if x < least:
                        least = x
                if least <= below[most]:
                    if end in below and (d := new[n] if end == "word" else least) <= distance_bound(below[end]) and (best is None or (d, below[end]) < best):
                        best = (d, below[end])
                    walk(below, depth + 1, new)

        walk(self.root, 1, [min(far, k) for k in range(n + 1)])
        return best

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(term, distance, whether it is a beginning) of the nearest term, the whole words first; beginnings as they are written."""
        if word in self.words:
            return word, 0, False
        if self.near(word) and (best := self.walked(word, "word")):
            return best[1], best[0], False
        for k in self.start_sizes:
            if word[:k] in self.beginnings:
                return word[:k], 0, True
        return None

    def match_any(self, word: str) -> tuple[str, int, bool] | None:
        """match(), then the nearest misspelt beginning."""
        if word in self.judged:
            return self.judged[word]
        if (m := self.match(word)) is None and self.near_start(word) and (best := self.walked(word, "start")):
            m = best[1], best[0], True
        if len(self.judged) < TABLE_ENTRIES and len(word) <= 40:
            self.judged[word] = m
        return m

    def of(self, token: str) -> tuple[str, int, bool] | None:
        """The match of a token between white space: its words in lower case, then with digits and signs read as letters."""
        low = token.lower()
        for w in _WORD.findall(low):
            if len(w) > 2 and (m := self.match_any(w)):
                return m
        core = low.strip(_EDGE)
        if core and not core.isalpha() and (plain := core.translate(_LEET).replace("-", "").replace(".", "").replace("*", "")) != core and plain.isalpha():
            return self.match_any(plain)
        return None

    def features(self, text: str) -> list[float]:
        """Of a whole text, in the order of PRIOR; zeros where it has no hits."""
        tokens, known = text.split(), self.known
        missing = {t for t in tokens if t not in known}
        found = {t: self.of(t) for t in missing}
        if len(known) < TABLE_ENTRIES:
            known.update((t, m) for t, m in found.items() if len(t) <= 40)
        get = known.get
        hits = [(i, m) for i, t in enumerate(tokens) if (m := found[t] if t in found else get(t)) is not None]
        exact = fuzzy = starts = plain = quoted = directed = 0.0
        terms: dict[str, float] = {}
        spans = quotations(text) if hits else []
        places = [m.start() for m in _TOKEN.finditer(text)] if spans else []
        for i, (term, edits, start) in hits:
            w = 1.0
            if self._reported(tokens, i) or spans and self._enclosed(spans, tokens[i], places[i]):
                quoted += 1
                w = QUOTED_SHARE
            if any(t.lower().strip(_EDGE) in ADDRESS for t in tokens[max(0, i - 3) : i + 4]):
                directed += w
            if edits:
                fuzzy += w
                continue
            plain += w
            name = tokens[i].lower().strip(_EDGE) if start else term
            terms[name] = max(terms.get(name, 0.0), w)
            if start:
                starts += w * self.beginnings[term]
            else:
                exact += w * self.words[term]
        share = min(10.0, 100 * plain / max(1, len(tokens)))
        return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(starts), math.log1p(quoted), math.log1p(directed), share, math.log1p(sum(terms.values()))]

    @staticmethod
    def _enclosed(spans: list[tuple[int, int]], token: str, place: int) -> bool:
        lo = place + len(token) - len(token.lstrip(_EDGE))
        k = bisect_right(spans, lo, key=lambda x: x[0]) - 1
        return k >= 0 and lo + len(token.strip(_EDGE)) <= spans[k][1]

    @staticmethod
    def _reported(tokens: list[str], i: int) -> bool:
        return any(t.lower().strip(_EDGE) in REPORTING for t in tokens[max(0, i - 2) : i])


def quotations(text: str) -> list[tuple[int, int]]:
    """(place of the opening sign, place of the closing one) of the outermost quotations, in order; signs that don't pair enclose nothing."""
    open_: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        c, i = m[0], m.start()
        before, after = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
        inside = before.isalnum() and after.isalnum()
        starts = not before.isalnum() and not after.isspace()  # may open
        ends = not before.isspace()  # may close
        k = next((k for k in range(len(open_) - 1, -1, -1) if c == open_[k][0] == '"' or c in PAIRS.get(open_[k][0], "")), None)
        if k is not None and not (c == "’" and inside) and (ends or not starts or c not in "\"«»"):
            while found and found[-1][0] > open_[k][1]:
                found.pop()
            found.append((open_[k][1], i))
            del open_[k:]
        elif c == '"':
            if starts or before.isspace() and after.isspace():
                open_ = [x for x in open_ if x[0] != c]  # an earlier one never closed
                open_.append((c, i))
        elif c in PAIRS and (c != "»" or starts and before.isspace()):
            open_.append((c, i))
        del open_[:-LEVELS]
    return found


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _terms(text: str) -> set[str]:
    """Words, and beginnings marked by a star, of a text."""
    words = {w for w in _WORD.findall(text.lower()) if 3 <= len(w) <= 40}
    return words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k}


def _least_shingle(text: str) -> int:
    """The least hash of five words in a row; near copies mostly share it."""
    from zlib import crc32

    words = text.lower().split()
    return min((crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """The lexicon from (term, toxic documents, other documents with it)."""

    def g2(a: int, b: int) -> float:
        n, k = toxic + clean, a + b
        cells = ((a, toxic * k / n), (b, clean * k / n), (toxic - a, toxic * (n - k) / n), (clean - b, clean * (n - k) / n))
        return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)

    odds = lambda a, b: math.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1)))
    told = sorted(((g2(a, b), t, a, b) for t, a, b in counts if a >= 5 and odds(a, b) > 1.4), reverse=True)
    told = [x for x in told if x[0] >= 20]
    words = {t: (a, b) for _, t, a, b in told if t[-1] != "*"}
    starts = {t[:-1]: (a, b) for _, t, a, b in told if t[-1] == "*"}
    # a beginning has to add to each word and each longer beginning under it
    most: dict[str, int] = {}
    for t, (a, _) in [*words.items(), *starts.items()]:
        for k in PREFIXES:
            if len(t) > k:
                most[t[:k]] = max(most.get(t[:k], 0), a)
    ok = {s: v for s, v in starts.items() if v[0] >= 1.25 * most.get(s, 0)}
    # words under it stay, as their misspellings may be further from it; a longer beginning, of the same bound, finds nothing more
    ok = {s: v for s, v in ok.items() if not any(len(s) > k and s[:k] in ok for k in PREFIXES)}
    ranked = sorted([*((g2(*v), t, v, False) for t, v in words.items()), *((g2(*v), t, v, True) for t, v in ok.items())], reverse=True)
    weight = lambda v: min(5.0, max(0.5, odds(*v)))
    return Lexicon({t: weight(v) for _, t, v, s in ranked if not s}, {t: weight(v) for _, t, v, s in ranked if s})


def regress(rows: list[tuple[list[float], int]], prior: list[float] = PRIOR) -> list[float]:
    """Logistic weights with a normal prior around the given means."""
    import numpy as np

    beta = np.array(prior, float)
    if len({y for _, y in rows}) < 2:
        return beta.tolist()
    x, y = np.array([r for r, _ in rows]), np.array([v for _, v in rows], float)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p)
        step = np.linalg.solve((x * w[:, None]).T @ x + 0.5 * np.eye(len(beta)), x.T @ (y - p) - 0.5 * (beta - prior))
        beta += np.clip(step, -1.5, 1.5)
        beta[1:4] = np.maximum(beta[1:4], 0)  # a hit of any kind never speaks for a clean text
    return beta.tolist()


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Lexicon, list[float]]:
    """Lexicon and weights from labelled rows whose remainder isn't 1, SAMPLE_ROWS at most."""
    spark = documents.sparkSession
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(remainder(F.col("doc_id")) != 1)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    chosen = spark.createDataFrame(chosen.collect(), "doc_id long, toxic int")  # SAMPLE_ROWS rows at most
    sample = written(texts_of(documents).join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "sample")
    out = schema_of("term string, toxic long, clean long")

    def run(batches):
        tox, rest = Counter(), Counter()
        for ys, texts in groups(batches, 1):
            for y, t in zip(ys, texts, strict=True):
                (tox if y else rest).update(_terms(t))
                (tox if y else rest)[""] += 1
        if names := [*(tox.keys() | rest.keys())]:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([tox[t] for t in names]), pa.array([rest[t] for t in names])], names=["term", "toxic", "clean"])

    # copies would make every word of theirs telling: of texts with the same least shingle one counts
    kinds = map_batches(sample, lambda: lambda ys, texts: [[_least_shingle(t) for t in texts], ys, texts], "least long, toxic int, text string", text=1)
    single = kinds.groupBy("least", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    counted = small_batches(single).mapInArrow(run, out).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # the sample's bound bounds the table; what can't be a term stays where it is
    rows = counted.where("term = '' or toxic >= 5 and toxic > clean / 4").collect()
    totals = next(((r["toxic"], r["clean"]) for r in rows if r["term"] == ""), (0, 0))
    lexicon = choose([(r["term"], r["toxic"], r["clean"]) for r in rows if r["term"]], *totals) if all(totals) else Lexicon({}, {})
    words, beginnings = lexicon.words, lexicon.beginnings

    def start():
        lex = Lexicon(words, beginnings)
        return lambda ys, texts: [ys, [lex.features(t) for t in texts]]

    seen = map_batches(sample, start, "toxic int, features array<double>").collect()
    return lexicon, regress(sorted((list(r["features"]), r["toxic"]) for r in seen))


def scored(documents: DataFrame, lexicon: Lexicon, weights: list[float], more: list[str] | None = None) -> DataFrame:
    """doc_id and score of every row."""
    words, beginnings = lexicon.words, lexicon.beginnings

    def start():
        lex = Lexicon(words, beginnings)

        def score(text: str) -> float:
            z = sum(a * b for a, b in zip(weights, lex.features(text), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return lambda ids, texts: [ids, [score(t) for t in texts]]

    return map_batches(texts_of(documents), start, "doc_id long, score double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    lexicon, weights = fit(documents, labels)
    return scored(documents, lexicon, weights).select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without those that score at the threshold or above; all columns, in order."""
    lexicon, weights = fit(documents, labels)
    words, beginnings = lexicon.words, lexicon.beginnings

    def start():
        lex = Lexicon(words, beginnings)

        def f(rows, texts):
            z = [sum(a * b for a, b in zip(weights, lex.features(t or ""), strict=True)) for t in texts]
            ok = [i for i, v in enumerate(z) if 1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) < threshold]
            return [[rows[i] for i in ok], [texts[i] for i in ok]]

        return f

    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"] or [F.lit(0).alias("none")])
    both = documents.select(rest.alias("rest"), F.col("text"))
    done = map_batches(both, start, both.schema)
    return done.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in documents.columns])
