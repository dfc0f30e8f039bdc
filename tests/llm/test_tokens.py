import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomspark.llm import packing, pieces, records
from loomspark.llm.tokenize import PieceEncoder, RankEncoder
from loomspark.sources.workspace import fresh_path
from tests.llm.data import empty, frame, texts

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
RANKS = (BYTE, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def test_encoders_agree_with_the_library(library):
    all_texts = [t for t in texts(150) if t is not None]
    for path, style in ((WORD, "word"), (BYTE, "byte")):
        e = PieceEncoder(path, style)
        for _ in range(2):  # from the library, then from the table
            got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(all_texts)]
            assert got == [library[path].encode(t, add_special_tokens=False).ids for t in all_texts]
    assert RankEncoder(*RANKS).encode(all_texts) == [library[BYTE].encode(t, add_special_tokens=False).ids for t in all_texts]


def test_records(spark, library):
    df, rows = frame(spark)
    got = [tuple(r) for r in records.digest(spark, df, WORD).collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        e = np.array([*library[WORD].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(e), zlib.crc32(e.tobytes())))
    got.sort(key=lambda r: r[1])
    assert Counter((i, *r) for i, _, *r in got) == Counter(want)
    for i, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == [r[0] for r in want]
    assert records.digest(spark, empty(spark), WORD).collect() == []


def test_record_files(spark, tmp_path, library):
    df, _ = frame(spark, [(2, "b c"), (1, "a"), (3, None)])
    path = fresh_path(spark, "records")
    for width in (2, 4):
        manifest = records.write_records(df, lambda: PieceEncoder(WORD, "word").encode, f"{path}-{width}", 1, 2, width)
        [shard] = manifest.collect()
        at = records.read_at(f"{path}-{width}", shard["path"], [2, 0])
        assert [(k, np.frombuffer(b, "<u4").tolist()) for k, b in at] == [(3, [2]), (1, [*ids(WORD, "a"), 2])]
    import io

    whole = records.frame(b"\x05payload")
    assert list(records.frames(io.BytesIO(whole * 2))) == [b"\x05payload"] * 2
    for broken in (whole[:-1], whole[:5] + b"x" + whole[6:], whole[:14] + b"x" + whole[15:]):
        with pytest.raises(ValueError):
            list(records.frames(io.BytesIO(broken)))


def test_pieces(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    df, rows = frame(spark)
    want = Counter()
    for i, t in rows:
        e = sp.encode(t or "")
        want[i, len((t or "").encode()), len(e), len(e) > 100] += 1
    assert Counter(tuple(r) for r in pieces.token_counts(df, PIECE, 100).collect()) == want
    want = Counter()
    for i, t in rows:
        e = [*sp.encode(t or ""), sp.eos_id()]
        want[i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(sp.decode(e).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in pieces.encoding_digest(df, PIECE).collect()) == want
    assert pieces.token_counts(empty(spark), PIECE, 100).collect() == pieces.encoding_digest(empty(spark), PIECE).collect() == []


def test_pieces_of_random_strings():
    import random

    r, sp, m = random.Random(5), sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.pieces(PIECE)
    strings = ["".join(r.choices(a, k=r.randint(1, 400))) for a in ("ab c  ▁é\n日x中aaa", "aaab", "the of ing", "    x") for _ in range(60)]
    for s in [*strings, "a" * 3000, " " * 500, "zxq" * 400]:
        words, e = [pieces._lead(w) for w in pieces.pretokens(s)], sp.encode(s)
        assert [i for w in words for i in m.encode_word(w)] == e
        counts = m.count_words(words)
        assert sum(counts[w] for w in words) == len(e)
        assert m.decode(e) == sp.decode(e)


def check_pieces(got, rows, library):
    """Every id in one piece, sequences gapless and within the window."""
    want = Counter((i, len(library[BYTE].encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sum(r["length"] for r in got) == sum(n * c for (_, n), c in want.items())
    assert Counter(dict(want)) == Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fills = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        fills.append(at)
    return fills


def test_packing(spark, library):
    df, rows = frame(spark)
    got = packing.digest(df, *RANKS).collect()
    fills = check_pieces(got, rows, library)
    assert all(f >= packing.WINDOW - packing.MAX_GAP or f & (f - 1) == 0 for f in fills)
    texts_by_id = {i: t for i, t in rows if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            e = np.array([*library[BYTE].encode(texts_by_id[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
            assert r["ids_crc32"] == zlib.crc32(e[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.digest(empty(spark), *RANKS).collect() == []


def test_plan_is_best_fit_decreasing():
    import random

    r = random.Random(1)
    for most in [63] * 30 + [5, 9, 20] * 10:
        window, lengths = 64, sorted((r.randint(1, most) for _ in range(r.randint(1, 200))), reverse=True)
        rooms = []
        for n in lengths:  # the plain algorithm
            fit = min((x for x in rooms if x >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((fit if fit is not None else window) - n)
        moves, loose, windows, pooled = packing.plan(Counter(lengths), window, 1)
        assert windows == len(rooms)
        wide = [x for x in rooms if x > 1 and (window - x) & (window - x - 1)]
        assert pooled == sum(window - x for x in wide)
        assert sum(hi - lo for lo, hi, _, _ in loose) == len(wide)
        assert {m[0] for m in moves} == set(lengths)
        # with the default, only windows with more room than that are cut anew
        window = 1024
        long = [16 * n + r.randint(-15, 0) for n in lengths]
        moves, loose, windows, pooled = packing.plan(Counter(long), window)
        again, none, plain, _ = packing.plan(Counter(long), window, window)
        assert (moves, windows) == (again, plain) and not none
        assert all(window - fill > packing.MAX_GAP for _, _, fill, _ in loose)


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> B", "A <|endoftext|> B", "<|StartOfText|>É", "<| Plain |> Text's É"])
def test_special_strings_keep_their_case(text):
    made = PieceEncoder(P.path("word_bpe_49k.json"), "word")
    ids = made.library.encode(text, add_special_tokens=False).ids
    assert made.encode([text]) == [np.array(ids, "<u4").tobytes()]
