"""Operator 10: personal data by weak supervision.

base_spans() gives the spans that four fixed rules define. Beyond them, candidates() proposes secrets, numbers, handles
and names; labelers (shape, gazetteer, context for and against, entropy) vote on each: 1 personal, -1 not, 0 silent.
Expectation-maximisation estimates how reliable each labeler is and how likely each pattern of votes is personal, and a
logistic span classifier is trained on those likelihoods over votes, kinds and lengths. Its spans are added; base spans
always stay, and a candidate that overlaps one is none.

Votes and shapes are categories, so the whole corpus enters training as a table of how often each pattern occurs. Its
size is bounded by the number of patterns, whatever the number of documents.

Offsets are code points, ends exclusive. A null text is the empty text and has no spans. Repeated rows each give a row.
An empty table, or one without candidates, trains no classifier and adds nothing. redact() keeps all columns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.batches import groups, map_batches, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "number", "handle", "name")
LABELERS = 5
THRESHOLD = 0.5

# The rules' classes and counts, written so that a search takes time in proportion to the text: a run of characters
# that can't begin a match further left is entered at its start only. Matches are those of the plain rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_TOKEN_END = re.compile(r"[A-Za-z0-9_-]*")
_HANDLE = re.compile(r"@[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@.-])")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?)\b\.? ([A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)?)")
_HEX = re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_FOR = re.compile(r"(?i)\b(?:token|key|secret|passw(?:or)?d|auth|bearer|ssn|account|konto|cuenta|compte|passport|iban|user|contact|name|call|id)\b")
_AGAINST = re.compile(r"(?i)\b(?:isbn|doi|version|page|order|sku|rfc|issue|commit|sha256|md5|checksum|http)\b")
GIVEN_NAMES = frozenset("anna ben carlos clara david elena emma hans james jean john juan julia karl laura luis maria marie mary michael paul peter pierre robert sofia thomas william".split())
KEY_STARTS = ("sk_", "pk_", "ghp_", "AKIA", "xox", "AIza", "eyJ")
NOT_HANDLES = frozenset("media import param return override charset keyframes".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """The local part cannot hold the sign, so a match is the run before a sign, and the domain after it."""
    out, after, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > after and t[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((lo, m.end()))
            after = m.end()
            at = t.find("@", after)
        else:
            after, at = at + 1, t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in emails(t)] if "@" in t else []
    if _DIGITS.search(t):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m[0].split(".")))]
        for m in _CARD.finditer(t):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in t:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def candidates(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(start, kind's place in MORE, end, features) of spans that overlap no base span; features: votes, kind, length class."""
    found = []
    after = 0
    for m in _DIGITS.finditer(t):
        if m.start() < after:
            continue
        lo = m.start()
        while lo > after and t[lo - 1] in _TOKEN:
            lo -= 1
        after = _TOKEN_END.match(t, m.end()).end()
        s = t[lo:after]
        if len(s) < 9:
            continue
        digits = sum(c.isdigit() for c in s)
        if len(s) >= 20 and digits < len(s) - s.count("-"):
            found.append((lo, 0, after))
        elif digits >= 9 and digits + s.count("-") == len(s):
            found.append((lo, 1, after))
    if "@" in t:
        found += [(m.start(), 2, m.end()) for m in _HANDLE.finditer(t) if not m.start() or t[m.start() - 1] not in _LOCAL]
    found += [(m.start(1), 3, m.end(1)) for m in _TITLE.finditer(t)]
    if not found:
        return []
    found.sort()
    out, k, reach = [], 0, -1
    for lo, kind, hi in found:
        while k < len(base) and base[k][0] < hi:
            reach = max(reach, base[k][2])
            k += 1
        if reach > lo:
            continue
        s, left = t[lo:hi], t[max(0, lo - 40) : lo]
        low = s.lower()
        shape = (1 if _HEX.fullmatch(s) else 0, 1 if _SSN.fullmatch(s) else -1 if len(set(s) - {"-"}) == 1 else 0, 0, 1 if " " in s else 0)[kind]
        listed = (1 if s.startswith(KEY_STARTS) else 0, 0, -1 if low[1:] in NOT_HANDLES else 0, 1 if low.split(" ")[0] in GIVEN_NAMES else 0)[kind]
        bits = _entropy(s) if kind < 2 else 0
        level = (1 if bits >= 3 else -1 if bits < 2 else 0) if kind < 2 else 0
        votes = (shape, listed, 1 if _FOR.search(left) else 0, -1 if _AGAINST.search(left) else 0, level)
        out.append((lo, kind, hi, (*votes, kind, min(len(s) // 10, 5))))
    return out


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60):
    """Expectation-maximisation over patterns of votes and their counts.

    Returns (share of personal spans, table[labeler, class, vote + 1] of vote probabilities, likelihood of each pattern).
    """
    import numpy as np

    patterns = sorted(counts)
    v = np.array(patterns, np.int64).reshape(len(patterns), LABELERS) + 1
    w = np.array([counts[p] for p in patterns], float)
    q = 1 / (1 + np.exp(-2.0 * (v - 1).sum(1) + 0.5))  # begins with the sum of the votes
    for _ in range(rounds):
        share = float((w * q).sum() + 1) / float(w.sum() + 2)
        table = np.ones((LABELERS, 2, 3))
        for j in range(LABELERS):
            for c in range(3):
                at = v[:, j] == c
                table[j, 1, c] += (w * q)[at].sum()
                table[j, 0, c] += (w * (1 - q))[at].sum()
        table[:, 1, 2] += 2  # a vote for is presumed to speak for, a vote against, against
        table[:, 0, 0] += 2
        table /= table.sum(2, keepdims=True)
        yes = math.log(share) + sum(np.log(table[j, 1, v[:, j]]) for j in range(LABELERS))
        no = math.log(1 - share) + sum(np.log(table[j, 0, v[:, j]]) for j in range(LABELERS))
        q = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return share, table, dict(zip(patterns, q.tolist(), strict=True))


def _row(features: tuple[int, ...]) -> list[float]:
    votes, kind, size = features[:LABELERS], features[LABELERS], features[LABELERS + 1]
    return [1.0, *(float(x > 0) for x in votes), *(float(x < 0) for x in votes), *(float(kind == k) for k in range(len(MORE))), size / 5]


def train(counts: dict[tuple[int, ...], int]) -> list[float] | None:
    """Weights of the span classifier from counts of feature patterns; None without candidates."""
    import numpy as np

    if not counts:
        return None
    votes: Counter = Counter()
    for f, n in counts.items():
        votes[f[:LABELERS]] += n
    _, _, likely = reliabilities(votes)
    rows = sorted(counts)
    x = np.array([_row(f) for f in rows])
    w = np.array([counts[f] for f in rows], float)
    w *= len(rows) / w.sum() * 100
    y = np.array([likely[f[:LABELERS]] for f in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(beta)), x.T @ (w * (y - p)) - beta)
        beta += np.clip(step, -2, 2)
    return beta.tolist()


def classified(weights: list[float], features: tuple[int, ...]) -> bool:
    return sum(a * b for a, b in zip(weights, _row(features), strict=True)) > math.log(THRESHOLD / (1 - THRESHOLD))


def fit(documents: DataFrame) -> list[float] | None:
    """The classifier of this corpus: all documents vote; what reaches the driver is one row for each pattern."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from loomspark.llm.batches import schema_of

    out = schema_of("pattern array<int>, n long")
    arrow = to_arrow_schema(out)

    def run(batches):
        seen: Counter = Counter()
        for _, texts in groups(batches, 1):
            for t in texts:
                seen.update(c[3] for c in candidates(t, base_spans(t)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], arrow.types[0]), pa.array(list(seen.values()), arrow.types[1])], schema=arrow)

    rows = small_batches(texts_of(documents)).mapInArrow(run, out).groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return train({tuple(r["pattern"]): r["n"] for r in rows})


def all_spans(t: str, weights: list[float] | None, known: dict) -> tuple[list, list]:
    """(base spans, all spans) as (start, order, end, kind)."""
    base = base_spans(t)
    spans = [(a, k, b, KINDS[k]) for a, k, b in base]
    more = []
    if weights is not None:
        for a, k, b, f in candidates(t, base):
            ok = known.get(f)
            if ok is None:
                ok = known[f] = classified(weights, f)
            if ok:
                more.append((a, len(KINDS) + k, b, MORE[k]))
    return spans, sorted(spans + more) if more else spans


def _said(spans) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, _, b, k in spans])


def digest(documents: DataFrame) -> DataFrame:
    """The query's columns."""
    weights = fit(documents)

    def start():
        known: dict = {}

        def f(ids, texts):
            out = [[] for _ in range(7)]
            for key, t in zip(ids, texts, strict=True):
                base, spans = all_spans(t, weights, known)
                n = Counter(s[3] for s in base)
                row = (key, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans))
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            return out

        return f

    return map_batches(texts_of(documents), start, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(t: str, spans) -> str:
    """The text with each span (overlapping ones as one, named by the first) replaced by [KIND]."""
    out, after = [], 0
    for a, _, b, kind in spans:
        if a >= after:
            out += [t[after:a], f"[{kind.upper()}]"]
        after = max(after, b)
    return "".join([*out, t[after:]]) if out else t


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with personal data replaced in their text; all columns, in order. A null text stays null."""
    weights = fit(documents)

    def start():
        known: dict = {}
        return lambda row, texts: [row, [redacted(t, all_spans(t, weights, known)[1]) if t is not None else None for t in texts]]

    # the other columns travel as one struct beside the text, so their names and types don't matter
    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text] or [F.lit(0).alias("none")])
    both = documents.select(rest.alias("rest"), F.col(text).alias("text"))
    done = map_batches(both, start, both.schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in documents.columns])
