"""Citations: passages located by their exact text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passages are searched for in blocks of about this many characters; each block is one automaton in every task.
BLOCK_CHARS = 16_000_000


def locate_once(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages (item_id, text) that occur exactly once in a document, with their half-open code-point span.

    A block of passages becomes one Aho-Corasick automaton, and each document is read once for a block, whatever the number of
    passages. Null or empty texts match nothing. A second, overlapping occurrence also makes a passage ambiguous.
    """
    passages = passages.where("length(text) > 0").select("item_id", "text")
    total = passages.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = total // BLOCK_CHARS + 1, None
    for b in range(blocks):
        rows = passages.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # about BLOCK_CHARS characters
        names = defaultdict(list)
        for r in rows:
            names[r["text"]].append(r["item_id"])
        found = _located(documents, dict(names))
        out = found if out is None else out.unionByName(found)
    return out


def _located(documents: DataFrame, names: dict[str, list[int]]) -> DataFrame:
    from hashlib import sha256

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for quote in names:
            automaton.add_word(quote, quote)
        automaton.make_automaton()
        digests = {q: sha256(q.encode()).hexdigest() for q in names}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                at: dict = defaultdict(list)
                for end, quote in automaton.iter(text) if names and text else ():
                    at[quote].append(end + 1)
                rows += [(doc, item, ends[0] - len(q), ends[0], digests[q]) for q, ends in at.items() if len(ends) == 1 for item in names[q]]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "char_start", "char_end", "quote_sha256"])

    return documents.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, item_id long, char_start long, char_end long, quote_sha256 string")
