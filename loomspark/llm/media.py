"""Operator 4: media columns by signature sniffing.

One Aho-Corasick automaton over the magic bytes of all known formats finds where a stored value may begin; a validator
for the format confirms structure and lengths there and tells where the medium ends. What is confirmed at byte 0
corrects the declared type; what is confirmed further on is embedded and can be carved out.

texts_as_media() makes the bytes of texts losslessly the 8-bit samples of a WAV file; digest() writes these to the shared
folder and reads them back, and the payload is the data chunk that the validator found in what was stored. A null value has no type and no embedded media; a null text is the empty
text, whose payload is 64 zero bytes. Equal values give equal results. Rows are handled alone; an empty table gives
none; columns besides those named are left aside.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from loomspark.llm.batches import map_batches, texts_of
from loomspark.sources.workspace import written

#: Magic bytes, their distance from the start of the medium, and the format they may begin.
MAGIC = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"BM", 0, "bmp"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"fLaC", 0, "flac"),
    (b"OggS\x00", 0, "ogg"),
]
#: The types of the formats.
TYPES = {
    "wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif",
    "bmp": "image/bmp", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "flac": "audio/flac", "ogg": "audio/ogg",
}
BLOCK = 64
RATE = 8000
_PDF = re.compile(rb"%PDF-[0-9]\.[0-9]")
_PDF_END = re.compile(rb"startxref[\r\n ]{1,4}[0-9]{1,20}[\r\n ]{1,4}%%EOF")


class Found(NamedTuple):
    """A confirmed medium: bytes [start, end) of the value; data_start and data_end bound its samples where the format has such a part."""

    kind: str
    start: int
    end: int
    data_start: int
    data_end: int


# -- validators: (value, start) -> Found, or None if structure or lengths don't hold


def _riff(v: bytes, at: int) -> Found | None:
    if at + 12 > len(v):
        return None
    size, form = struct.unpack_from("<I4s", v, at + 4)
    end, kind = at + 8 + size, {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(form)
    if kind is None or end > len(v) or size < 4:
        return None
    pos, parts = at + 12, {}
    while pos + 8 <= end:
        name, n = struct.unpack_from("<4sI", v, pos)
        if pos + 8 + n > end:
            return None
        parts.setdefault(name, (pos + 8, pos + 8 + n))
        pos += 8 + n + n % 2
    if pos not in (end, end + 1):
        return None
    if kind == "wav":
        if b"fmt " not in parts or b"data" not in parts or parts[b"fmt "][1] - parts[b"fmt "][0] < 16:
            return None
        _, channels, rate, per_second, block, bits = struct.unpack_from("<HHIIHH", v, parts[b"fmt "][0])
        if not channels or block != channels * (bits + 7) // 8 or per_second != rate * block or not block or (parts[b"data"][1] - parts[b"data"][0]) % block:
            return None
        return Found(kind, at, end, *parts[b"data"])
    return Found(kind, at, end, at, end) if parts else None


def _png(v: bytes, at: int) -> Found | None:
    pos, first = at + 8, True
    while pos + 12 <= len(v):
        n, name = struct.unpack_from(">I4s", v, pos)
        if pos + 12 + n > len(v) or first and (name != b"IHDR" or n != 13):
            return None
        if zlib.crc32(v[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", v, pos + 8 + n)[0]:
            return None
        first, pos = False, pos + 12 + n
        if name == b"IEND":
            return Found("png", at, pos, at, pos)
    return None


def _jpeg(v: bytes, at: int) -> Found | None:
    pos = at + 2
    while pos + 4 <= len(v) and v[pos] == 0xFF:
        mark, n = v[pos + 1], struct.unpack_from(">H", v, pos + 2)[0]
        if not 0xC0 <= mark <= 0xFE or n < 2 or pos + 2 + n > len(v):
            return None
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded data runs to the next marker that isn't a restart or stuffing
            while (pos := v.find(b"\xff", pos)) >= 0 and pos + 1 < len(v):
                if v[pos + 1] == 0xD9:
                    return Found("jpeg", at, pos + 2, at, pos + 2)
                if v[pos + 1] == 0 or 0xD0 <= v[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
            if pos < 0:
                return None
    return None


def _gif(v: bytes, at: int) -> Found | None:
    if at + 13 > len(v):
        return None
    flags = v[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while pos < len(v):
        kind = v[pos]
        if kind == 0x3B:
            return Found("gif", at, pos + 1, at, pos + 1)
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(v):
            flags = v[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return None
        while pos < len(v) and v[pos]:
            pos += 1 + v[pos]
        pos += 1
    return None


def _bmp(v: bytes, at: int) -> Found | None:
    if at + 30 > len(v):
        return None
    size, _, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", v, at + 2)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or offset < 14 + header or offset > size or at + size > len(v) or width <= 0:
        return None
    if offset + (width * bits + 31) // 32 * 4 * abs(height) > size and struct.unpack_from("<I", v, at + 30)[0] == 0:
        return None
    return Found("bmp", at, at + size, at + offset, at + size)


def _pdf(v: bytes, at: int) -> Found | None:
    """Up to the last mark of an end that follows a table of references, before the next header: a PDF may have been added to."""
    if not _PDF.match(v, at):
        return None
    headers, ends = _marks(v)[:2]
    after = bisect_right(headers, at)
    k = bisect_left(ends, headers[after] if after < len(headers) else len(v) + 1) - 1
    return Found("pdf", at, ends[k], at, ends[k]) if k >= 0 and ends[k] > at else None


def _zip(v: bytes, at: int) -> Found | None:
    end = _marks(v)[2].get(at)
    return Found("zip", at, end, at, end) if end else None


@lru_cache(1)
def _marks(v: bytes) -> tuple[list[int], list[int], dict[int, int]]:
    """Found in one pass: PDF headers, ends of PDF files, and the end of each archive by its start, which its end record tells."""
    archives: dict[int, int] = {}
    end = v.find(b"PK\x05\x06")
    while end >= 0:
        if end + 22 <= len(v):
            size, offset, note = struct.unpack_from("<IIH", v, end + 12)
            at = end - size - offset
            if at >= 0 and v[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(v):
                archives.setdefault(at, end + 22 + note)
        end = v.find(b"PK\x05\x06", end + 1)
    return [m.start() for m in _PDF.finditer(v)], [m.end() for m in _PDF_END.finditer(v)], archives


def _gzip(v: bytes, at: int) -> Found | None:
    if at + 18 > len(v) or v[at + 3] & 0xE0:
        return None
    left, d = memoryview(v)[at:], zlib.decompressobj(31)
    try:
        while left and not d.eof:  # in parts: what comes out is not kept
            d.decompress(left, 1 << 20)
            left = d.unconsumed_tail if not d.eof else d.unused_data
    except zlib.error:
        return None
    return Found("gzip", at, len(v) - len(d.unused_data), at, len(v) - len(d.unused_data)) if d.eof else None


def _flac(v: bytes, at: int) -> Found | None:
    pos, first = at + 4, True
    while pos + 4 <= len(v):
        kind, n = v[pos], int.from_bytes(v[pos + 1 : pos + 4])
        if first and (kind & 127 or n != 34) or pos + 4 + n > len(v):
            return None
        first, pos = False, pos + 4 + n
        if kind & 128:
            ok = pos + 2 <= len(v) and v[pos] == 0xFF and v[pos + 1] & 0xFC == 0xF8
            return Found("flac", at, len(v), pos, len(v)) if ok else None
    return None


def _ogg(v: bytes, at: int) -> Found | None:
    pos = at
    while v[pos : pos + 5] == b"OggS\x00" and pos + 27 <= len(v):
        laces = v[pos + 27 : pos + 27 + v[pos + 26]]
        end = pos + 27 + v[pos + 26] + sum(laces)
        if len(laces) != v[pos + 26] or end > len(v):
            return None
        last, pos = v[pos + 5] & 4, end
        if last:
            break
    return Found("ogg", at, pos, at, pos) if pos > at else None


VALIDATORS = {"riff": _riff, "png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg}


class Sniffer:
    def __init__(self):
        import ahocorasick

        # the automaton reads strings; one character stands for one byte
        self.automaton = ahocorasick.Automaton()
        for magic, before, kind in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), (before + len(magic) - 1, kind))
        self.automaton.make_automaton()

    def find(self, value: bytes) -> list[Found]:
        """Confirmed media by their start, none inside another."""
        out, after = [], 0
        for end, (back, kind) in self.automaton.iter(value.decode("latin-1")):
            at = end - back
            if at >= after and (found := VALIDATORS[kind](value, at)):
                out.append(found)
                after = found.end
        return out

    def sniff(self, value: bytes | None, declared: str | None) -> tuple[str | None, bool, list[Found]]:
        """(type, whether the declared one was wrong, embedded media). The declared type stands where nothing is confirmed at byte 0."""
        if value is None:
            return None, False, []
        found = self.find(value)
        kind = TYPES[found[0].kind] if found and found[0].start == 0 else declared
        return kind, kind != declared, [f for f in found if f.start]


_SNIFFER: list[Sniffer] = []


def sniffer() -> Sniffer:
    if not _SNIFFER:
        _SNIFFER.append(Sniffer())
    return _SNIFFER[0]


def sniffed(media: DataFrame, key: str = "media_id", value: str = "content", declared: str = "declared") -> DataFrame:
    """key, type, corrected and the embedded media (type, start, end, their bytes) of a table of binary values."""

    def start():
        s = sniffer()

        def f(keys, values, said):
            got = [s.sniff(v, d) for v, d in zip(values, said, strict=True)]
            carved = [[{"type": TYPES[x.kind], "start": x.start, "end": x.end, "content": v[x.start : x.end]} for x in g[2]] for g, v in zip(got, values, strict=True)]
            return [keys, [g[0] for g in got], [g[1] for g in got], carved]

        return f

    chosen = media.select(media[key], media[value], media[declared])
    return map_batches(chosen, start, f"`{key}` {media.schema[key].dataType.simpleString()}, type string, corrected boolean, embedded array<struct<type: string, start: long, end: long, content: binary>>")


def as_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def padded(raw: bytes) -> bytes:
    """With zero bytes up to a positive multiple of BLOCK."""
    return raw + b"\0" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def texts_as_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared and the stored WAV file of each whole text."""

    def start():
        def f(ids, texts):
            raw = [t.encode() for t in texts]
            return [ids, [len(r) for r in raw], ["text/plain"] * len(raw), [as_wav(padded(r)) for r in raw]]

        return f

    return map_batches(texts_of(documents), start, "doc_id long, n_bytes long, declared string, content binary")


def digest(documents: DataFrame) -> DataFrame:
    """The query's columns: each stored file is read back, sniffed and its samples taken from where the validator found them.

    feature: corrected type, bounds of the samples, number of embedded media, then mean and largest step of the samples.
    """
    import numpy as np

    def start():
        s = sniffer()

        def f(ids, n_bytes, declared, contents):
            out = [[] for _ in range(9)]
            for key, n, said, v in zip(ids, n_bytes, declared, contents, strict=True):
                wav = s.find(v)[0]
                kind, payload = TYPES[wav.kind], v[wav.data_start : wav.data_end]
                inside = s.find(payload)
                a = np.frombuffer(payload, np.uint8).astype(np.int16)
                feature = f"{said}>{kind};{wav.data_start}-{wav.data_end};embedded={','.join(f'{x.kind}:{x.start}-{x.end}' for x in inside) or 0};mean={int(a.sum(dtype=np.int64)) * 1000 // len(a)};step={int(np.abs(np.diff(a)).max())}"
                row = (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(v), hashlib.sha256(v).hexdigest(), feature, kind)
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            return out

        return f

    made = written(texts_as_media(documents), "media")
    return map_batches(
        made, start, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string", text=3
    )
