"""Byte kernels of stream filters: pure functions that return bytes, or None where the input is declined."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np

INFLATE_LIMIT = 128 << 20
RASTER_LIMIT = 256 << 20


def inflate_capped(data: bytes, limit: int = INFLATE_LIMIT) -> bytes | None:
    """A whole zlib stream, if it ends properly within the limit."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error:
        return None
    return out if d.eof and len(out) <= limit else None


def deflate(data: bytes) -> bytes:
    return zlib.compress(data, 9)


def redeflate(data: bytes) -> bytes | None:
    """A strictly smaller zlib stream of the same content, checked by inflating it; else None."""
    raw = inflate_capped(data)
    if raw is None:
        return None
    new = deflate(raw)
    return new if len(new) < len(data) and inflate_capped(new) == raw else None


def png_filter(raster: bytes, stride: int, bpp: int, tag: int) -> bytes | None:
    """Each row of the raster under PNG filter tag 0 to 4, with the tag before it."""
    if stride <= 0 or len(raster) % stride:
        return None
    rows = np.frombuffer(raster, np.uint8).reshape(-1, stride).astype(np.int16)
    up, left, corner = _neighbours(rows, bpp)
    base = (np.zeros_like(rows), left, up, (left + up) >> 1, _paeth(left, up, corner))[tag]
    out = np.empty((len(rows), stride + 1), np.uint8)
    out[:, 0] = tag
    out[:, 1:] = (rows - base) & 255
    return out.tobytes()


def _neighbours(rows: np.ndarray, bpp: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    corner[:, bpp:] = up[:, :-bpp]
    return up, left, corner


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    down, right = b - c, a - c
    pa, pb, pc = abs(down), abs(right), abs(down + right)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def png_defilter(data: bytes, stride: int, bpp: int) -> bytes | None:
    """The raster of filtered rows; None for an unknown tag or a partial row."""
    if stride <= 0 or len(data) % (stride + 1):
        return None
    return png_defilter_many([data], stride, bpp)[0]


def png_defilter_many(files: list[bytes], stride: int, bpp: int) -> list[bytes | None]:
    """As png_defilter, of many rasters with rows of one length together."""
    whole = [k for k, data in enumerate(files) if stride > 0 and not len(data) % (stride + 1)]
    across = -(-stride // bpp)
    tags, ends = {}, {}
    made = {k: np.zeros((len(files[k]) // (stride + 1), across * bpp), np.uint8) for k in whole}
    for k in whole:
        rows = np.frombuffer(files[k], np.uint8).reshape(-1, stride + 1)
        made[k][:, :stride] = rows[:, 1:]
        tags[k] = rows[:, 0]
        ends[k] = [*(np.flatnonzero(np.diff(tags[k])) + 1).tolist(), len(rows)] if len(rows) else []
    bad = {k for k in whole if len(tags[k]) and tags[k].max() > 4}
    at = dict.fromkeys(whole, 0)
    todo = [k for k in whole if k not in bad and ends[k]]
    while todo:  # runs of rows with one tag: the next one of each raster, those of the same tag together
        by: dict[int, list[int]] = {}
        for k in todo:
            by.setdefault(int(tags[k][at[k]]), []).append(k)
        for tag, own in by.items():
            spans = [made[k][at[k] : ends[k][0]] for k in own]
            above = [made[k][at[k] - 1] if at[k] else np.zeros(across * bpp, np.uint8) for k in own]
            if tag in (3, 4):
                steps, cells = max(map(len, spans)) + across, sum(x.size for x in spans)
                if cells < 32 * steps:
                    _by_pixel(spans, above, tag, bpp)
                else:
                    _waves(spans, above, tag, bpp)
            for span, up in zip(spans, above, strict=True):
                if tag == 1:
                    span[:] = np.cumsum(span.reshape(len(span), across, bpp), axis=1, dtype=np.uint8).reshape(span.shape)
                elif tag == 2:
                    span[0] += up
                    np.cumsum(span, axis=0, dtype=np.uint8, out=span)
            for k in own:
                at[k] = ends[k].pop(0)
        todo = [k for k in todo if ends[k]]
    return [made[k][:, :stride].tobytes() if k in made and k not in bad else None for k in range(len(files))]


def _by_pixel(spans: list[np.ndarray], above: list[np.ndarray], tag: int, bpp: int) -> None:
    """As _waves, for so few bytes that setting up arrays would cost more."""
    for span, up in zip(spans, above, strict=True):
        up = up.tobytes()
        for y in range(len(span)):
            line = bytearray(span[y].tobytes())
            for i in range(len(line)):
                a, b = (line[i - bpp] if i >= bpp else 0), up[i]
                if tag == 3:
                    base = (a + b) >> 1
                else:
                    c = up[i - bpp] if i >= bpp else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    base = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[i] = (line[i] + base) & 255
            span[y] = np.frombuffer(line, np.uint8)
            up = bytes(line)


def _waves(spans: list[np.ndarray], above: list[np.ndarray], tag: int, bpp: int) -> None:
    """Undoes Average or Paeth in rows of many rasters in place. A pixel needs those left of it and above, so all pixels with one sum of row and column are found together, over all rasters: rows lie by their number, within it longer rasters first, with an empty pixel in front."""
    spans, above = zip(*sorted(zip(spans, above, strict=True), key=lambda x: -len(x[0])), strict=True)
    across = spans[0].shape[1] // bpp
    heights = np.array([len(x) for x in spans])
    number = np.concatenate([np.arange(n) for n in heights])
    order = np.argsort(number, kind="stable")
    y, n = number[order], len(number)
    start = np.searchsorted(y, np.arange(heights[0] + 1))
    cells = np.zeros((n + len(spans), across + 1, bpp), np.int16)
    cells[:n, 1:] = np.concatenate(spans).reshape(n, across, bpp)[order]
    cells[n:, 1:] = np.stack(above).reshape(len(spans), across, bpp)
    place = np.arange(n) - start[y]
    up = np.where(y > 0, start[np.maximum(y - 1, 0)] + place, n + place)
    flat = cells.reshape(-1, bpp)
    own, over = np.arange(n) * (across + 1) + 1 - y, up * (across + 1) + 1 - y
    for t in range(heights[0] + across - 1):
        lo, hi = start[max(0, t - across + 1)], start[min(t, heights[0] - 1) + 1]
        here, there = own[lo:hi] + t, over[lo:hi] + t
        a, b = flat[here - 1], flat[there]
        base = (a + b) >> 1 if tag == 3 else _paeth(a, b, flat[there - 1])
        flat[here] = (flat[here] + base) & 255
    back = np.empty_like(order)
    back[order] = np.arange(n)
    rows = cells[:n, 1:].astype(np.uint8).reshape(n, -1)[back]
    k = 0
    for span in spans:
        span[:] = rows[k : k + len(span)]
        k += len(span)


def lzw_decode(data: bytes, early: int = 1, limit: int = INFLATE_LIMIT) -> bytes | None:
    """LZW of 9 to 12 bits, highest bit first. The first code after a clear has to be a literal, a full table without a clear declines, a missing end code is accepted."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    widths, ends = _lzw_widths(early)
    parts: list[bytes] = []
    at = held = 0
    while True:
        n = int(np.searchsorted(ends, 8 * len(data) - at, "right"))
        places = at + ends[:n] - widths[:n]
        k = places >> 3
        codes = (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (24 - (places & 7) - widths[:n]) & (1 << widths[:n]) - 1
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else n
        if stop == len(widths):  # a full table without a clear
            return None
        if stop:
            own = codes[:stop].tolist()
            if own[0] > 255:
                return None
            table = _LITERALS.copy()
            last = table[own[0]]
            got = [last]
            put, add = table.append, got.append
            for size, code in enumerate(own[1:], 258):
                if code < size:
                    now = table[code]
                elif code == size:
                    now = last + last[:1]
                else:
                    return None
                put(last + now[:1])
                add(now)
                last = now
            parts.append(b"".join(got))
            held += len(parts[-1])
            if held > limit and len(own) > 1:
                return None
        if stop == n or codes[stop] == 257:
            return b"".join(parts)
        at += int(ends[stop])


_LITERALS = [bytes([i]) for i in range(256)] + [b"", b""]


@functools.lru_cache(maxsize=2)
def _lzw_widths(early: int) -> tuple[np.ndarray, np.ndarray]:
    """The width of each code after a clear, and the bits up to its end; the last one can only be a clear or the end."""
    widths = np.array([min(12, max(9, (257 + i + early).bit_length())) for i in range(3840)])
    return widths, np.cumsum(widths)


@functools.lru_cache(maxsize=1)
def _lzw_codes(data: bytes) -> np.ndarray:
    """The codes of a stream after its first clear; the change of width has no part in them."""
    literals = {4096 << 8 | c: c for c in range(256)}
    codes: list[int] = []
    put = codes.append
    table, size, w = literals.copy(), 258, 4096
    get = table.get
    for c in data:
        k = w << 8 | c
        if (found := get(k)) is not None:
            w = found
            continue
        put(w)
        table[k] = size
        size += 1
        w = c
        if size >= 4094:
            put(w)
            put(256)
            table, size, w = literals.copy(), 258, 4096
            get = table.get
    if w < 4096:
        put(w)
    put(257)
    return np.array(codes)


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    """A stream that lzw_decode reads: for fixtures."""
    codes = _lzw_codes(data)
    first = np.concatenate(([0], np.flatnonzero(codes == 256) + 1))
    own = np.arange(len(codes))
    widths = _lzw_widths(early)[0][own - np.repeat(first, np.diff(np.append(first, len(codes))))]
    codes, widths = np.append(256, codes), np.append(9, widths)
    ends = np.cumsum(widths)
    at = ends - widths
    bits, byte, n = codes << (24 - (at & 7) - widths), at >> 3, (int(ends[-1]) + 7) // 8 + 2
    return sum(np.bincount(byte + k, bits >> (16 - 8 * k) & 255, n) for k in range(3)).astype(np.uint8)[: n - 2].tobytes()


def ascii85_decode(data: bytes) -> bytes | None:
    """Base 85 with z groups up to ~>; a missing end mark is accepted, a group of one digit is not."""
    out, group = bytearray(), []
    for b in data:
        if b in b" \t\r\n\f\0":
            continue
        if b == 0x7E:
            break
        if b == 0x7A and not group:
            out += bytes(4)
        elif 33 <= b <= 117:
            group.append(b - 33)
            if len(group) == 5:
                x = 0
                for d in group:
                    x = x * 85 + d
                if x >> 32:
                    return None
                out += x.to_bytes(4, "big")
                group = []
        else:
            return None
    if len(group) == 1:
        return None
    if group:
        x = 0
        for d in group + [84] * (5 - len(group)):
            x = x * 85 + d
        if x >> 32:
            return None
        out += x.to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def ascii_hex_decode(data: bytes) -> bytes | None:
    """Hexadecimal digits up to >, white space aside; an odd last digit counts as if a zero followed."""
    body = bytes(b for b in data.split(b">")[0] if b not in b" \t\r\n\f\0")
    if re.search(rb"[^0-9A-Fa-f]", body):
        return None
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def run_length_decode(data: bytes, limit: int = INFLATE_LIMIT) -> bytes | None:
    """Runs and copies up to byte 128; None where a run is cut short."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n == 128:
            return bytes(out)
        if n < 128:
            if i + n + 1 > len(data):
                return None
            out += data[i : i + n + 1]
            i += n + 1
        else:
            if i >= len(data):
                return None
            out += data[i : i + 1] * (257 - n)
            i += 1
        if len(out) > limit:
            return None
    return bytes(out)


_DECODERS = {"ASCII85Decode": ascii85_decode, "A85": ascii85_decode, "ASCIIHexDecode": ascii_hex_decode, "AHx": ascii_hex_decode, "RunLengthDecode": run_length_decode, "RL": run_length_decode, "FlateDecode": inflate_capped, "Fl": inflate_capped}
LEGACY = {"LZWDecode", "LZW", "ASCII85Decode", "A85", "ASCIIHexDecode", "AHx", "RunLengthDecode", "RL"}
MAX_CHAIN = 4


def decode_chain(data: bytes, filters: list[str], parms: list[dict]) -> bytes | None:
    """Undoes up to four filters in order. Predictors are undone where a filter has one; unknown filters decline."""
    if len(filters) > MAX_CHAIN:
        return None
    for i, name in enumerate(filters):
        own = parms[i] if i < len(parms) else {}
        if name in ("LZWDecode", "LZW"):
            data = lzw_decode(data, int(own.get("EarlyChange", 1)))
        elif name in _DECODERS:
            data = _DECODERS[name](data)
        else:
            return None
        if data is None:
            return None
        predictor = int(own.get("Predictor", 1))
        if predictor >= 10:
            colors, bits, columns = int(own.get("Colors", 1)), int(own.get("BitsPerComponent", 8)), int(own.get("Columns", 1))
            data = png_defilter(data, (colors * bits * columns + 7) // 8, max(1, colors * bits // 8))
            if data is None:
                return None
        elif predictor != 1:
            return None
    return data


PARMS_COST = 70


def best_raster(raster: bytes, stride: int, bpp: int, tags=(0, 1, 2, 3, 4)) -> tuple[int | None, bytes] | None:
    """The cheapest verified deflate of a raster, plain (None) or under one PNG filter, whose parameters count 70 bytes; ties go to plain, then to the lower tag."""
    options: list[tuple[int, int, int | None, bytes]] = [(len(x := deflate(raster)), -1, None, x)]
    for tag in tags:
        filtered = png_filter(raster, stride, bpp, tag)
        if filtered is not None:
            options.append((len(x := deflate(filtered)) + PARMS_COST, tag, tag, x))
    for _, _, tag, payload in sorted(options, key=lambda o: o[:2]):
        back = inflate_capped(payload)
        if (back if tag is None else png_defilter(back or b"?", stride, bpp)) == raster:
            return tag, payload
    return None


def minify_number(literal: str) -> str:
    """The shortest literal of exactly the same decimal value: leading plus and zeros, trailing zeros and a bare point go; what is no plain decimal stays."""
    m = re.fullmatch(r"([+-]?)(\d*)(?:\.(\d*))?", literal)
    if not m or not (m[2] or m[3]):
        return literal
    whole, part = m[2].lstrip("0"), (m[3] or "").rstrip("0")
    if not whole and not part:
        return "0"
    return ("-" if m[1] == "-" else "") + (whole or ("" if part else "0")) + (f".{part}" if part else "")
