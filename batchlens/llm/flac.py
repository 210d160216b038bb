"""FLAC media columns: texts' bytes (or any bytes) as 8-bit mono samples.

The coder works on all frames of a batch together. A frame has 192 samples. For each, the encoder takes the cheapest of
a constant, plain samples, fixed linear predictors of order 0 to 2 and a quantised linear predictor of order 2, with
Rice-coded residuals, and writes the header's CRC-8 and the frame's CRC-16. The decoder finds frames by their headers
(sync code, CRC-8, running frame number), checks every CRC-16, and decodes Rice residuals (any partition order) and
linear predictors (fixed or quantised, any order) one sample of all frames at a time; last it checks the stream's MD5.
`stored` writes the streams as a table in the shared folder; `pcm_blocks` reads them back and decodes them into blocks
with the sample offset at which each starts, `decoded` writes these as a table, and `seek` reads from any offset of it.

Nulls and odd input: a null text is empty, and an empty one is stored as one block of spaces; null and repeated ids are
allowed. Very long texts are coded whole, on their own. Bytes that do not decode raise ValueError. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import stage, table
from batchlens.llm.kernels import slices, text_bytes

BLOCK, RATE, PAD = 192, 8000, 32
#: Coefficient bits and shift of the encoder's own predictors.
PRECISION, SHIFT = 8, 5
CONSTANT, PLAIN, FIXED, LINEAR = 0, 1, 2, 3
FIXED_COEFFICIENTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ polynomial, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005).astype(np.int32)


def _crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many runs of bytes, one byte of all at a time."""
    order = np.argsort(-length, kind="stable")
    at, crc = start[order].copy(), np.zeros(len(start), np.int32)
    active = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), "right")
    for n in active:
        crc[:n] = (crc[:n] << 8 & 0xFFFF) ^ CRC16[(crc[:n] >> 8) ^ data[at[:n]]]
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _numbered(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes (padded to 6) and how many there are."""
    count = 1 + (number >= 1 << 7) + (number >= 1 << 11) + (number >= 1 << 16) + (number >= 1 << 21) + (number >= 1 << 26)
    out = np.zeros((len(number), 6), np.int64)
    for n in range(1, 7):
        mine = count == n
        if mine.any():
            value = number[mine]
            lead = 0 if n == 1 else (0xFF << (8 - n)) & 0xFF
            out[mine, 0] = lead | value >> (6 * (n - 1))
            for b in range(1, n):
                out[mine, b] = 0x80 | value >> (6 * (n - 1 - b)) & 0x3F
    return out, count


def _headers(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers with CRC-8: bytes (padded to 11) and their lengths."""
    coded, count = _numbered(number)
    head = np.zeros((len(number), 11), np.int64)
    head[:, :4] = (0xFF, 0xF8, 0x14, 0x02)  # sync, fixed block size, 192 samples at 8 kHz, mono of 8 bits
    head[:, 4:10] = coded
    crc = np.zeros(len(number), np.int64)
    for b in range(10):
        crc = np.where(b < 4 + count, CRC8[crc ^ head[:, b]], crc)
    head[np.arange(len(number)), 4 + count] = crc
    return head, 5 + count


def _rice(residual: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the Rice parameter of each frame and its bits (very many if a quotient is too long)."""
    folded = (residual << 1) ^ (residual >> 31)
    folded[:, :skip] = 0
    mean = folded.sum(1) / (BLOCK - skip)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int32)
    cost = [(folded >> kk[:, None]).sum(1) + (BLOCK - skip) * (1 + kk) for kk in (k, np.minimum(k + 1, 14))]
    k, bits = np.where(cost[1] < cost[0], np.minimum(k + 1, 14), k), np.minimum(*cost)
    return folded, k, np.where(folded.max(1) >> k > 24, 1 << 20, bits)


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of frames of 192 signed samples, frame after frame, and where each starts (one more entry than frames)."""
    n = len(samples)
    x = samples.astype(np.int32)
    linear = x.astype(np.float64)
    a, b = linear[:, 1:-1], linear[:, :-2]
    saa, sab, sbb, sya, syb = (a * a).sum(1), (a * b).sum(1), (b * b).sum(1), (linear[:, 2:] * a).sum(1), (linear[:, 2:] * b).sum(1)
    det = saa * sbb - sab * sab
    det = np.where(det == 0, np.inf, det)
    most = (1 << (PRECISION - 1)) - 1
    c1 = np.clip(np.rint((sya * sbb - syb * sab) / det * (1 << SHIFT)), -most, most).astype(np.int32)
    c2 = np.clip(np.rint((syb * saa - sya * sab) / det * (1 << SHIFT)), -most, most).astype(np.int32)
    candidates = []
    for order, kind in ((0, FIXED), (1, FIXED), (2, FIXED), (2, LINEAR)):
        r = x.copy()
        if kind == LINEAR:
            r[:, 2:] -= (c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> SHIFT
        else:
            for _ in range(order):
                r[:, 1:] = r[:, 1:] - r[:, :-1]
        folded, k, bits = _rice(r, order)
        candidates.append((order, kind, folded, k, bits + 8 * order + 10 + (9 + 2 * PRECISION) * (kind == LINEAR)))
    cost = np.stack([c[4] for c in candidates] + [np.full(n, 8 * BLOCK), np.where((x == x[:, :1]).all(1), 8, 1 << 21)])
    best = cost.argmin(0)
    kind, order, k = np.full(n, PLAIN), np.zeros(n, np.int32), np.zeros(n, np.int32)
    kind[best == 5] = CONSTANT
    # The sample columns, right-aligned values and widths: plain, or zeros of the quotient, a one, and the low bits.
    value, width = (x & 0xFF).astype(np.int32), np.full((n, BLOCK), 8, np.int32)
    width[best == 5, 1:] = 0
    for i, (o, kk, folded, param, _) in enumerate(candidates):
        mine = np.flatnonzero(best == i)
        kind[mine], order[mine], k[mine] = kk, o, param[mine]
        p = param[mine][:, None]
        f = folded[mine]
        value[mine] = (1 << p) | f & ((1 << p) - 1)
        width[mine] = (f >> p) + 1 + p
        width[mine, :o] = 0
    rice = kind >= FIXED
    type_code = np.select([kind == CONSTANT, kind == PLAIN, kind == FIXED], [0, 1, 8 + order], 32 + order - 1)
    front_value = np.stack([type_code << 1, x[:, 0] & 0xFF, x[:, 1] & 0xFF, np.full(n, (PRECISION - 1) << 5 | SHIFT), c1 & 0xFF, c2 & 0xFF, k], 1)
    lpc = kind == LINEAR
    front_width = np.stack([np.full(n, 8), 8 * (order > 0), 8 * (order > 1), 9 * lpc, PRECISION * lpc, PRECISION * lpc, 10 * rice], 1)
    value, width = np.concatenate([front_value, value], 1).astype(np.int64), np.concatenate([front_width, width], 1)
    head, head_length = _headers(number)
    bits = width.sum(1)
    body = -(-bits // 8)
    length = head_length + body + 2
    start = np.concatenate(([0], np.cumsum(length)))
    # Every field ends at a bit of the whole buffer; its value goes into the 32-bit word of its last bit and the one before.
    end = (np.cumsum(width, 1) + ((start[:-1] + head_length) * 8)[:, None]).ravel()
    used = width.ravel() > 0
    end, value = end[used], value.ravel()[used].astype(np.uint64)
    word, shift = (end - 1) >> 5, (31 - ((end - 1) & 31)).astype(np.uint64)
    moved = value << shift
    words = np.zeros(int(start[-1] * 8 // 32) + 3, np.uint64)
    edge = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[edge] + 1] += np.add.reduceat(moved & np.uint64(0xFFFFFFFF), edge)
    words[word[edge]] += np.add.reduceat(moved >> np.uint64(32), edge)
    data = words[1:].astype(">u4").view(np.uint8)[: start[-1]].copy()
    for b in range(11):
        mine = b < head_length
        data[start[:-1][mine] + b] = head[mine, b]
    crc = _crc16(data, start[:-1], length - 2)
    data[start[1:] - 2], data[start[1:] - 1] = crc >> 8, crc & 0xFF
    return data, start


def _stream_header(samples: bytes, least: int, most: int) -> bytes:
    """The stream marker and its one metadata block."""
    n = len(samples)
    info = BLOCK.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(samples).digest()
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """A FLAC stream for each payload of unsigned bytes, whose sizes are positive multiples of 192."""
    frames = np.array([len(p) // BLOCK for p in payloads], np.int64)
    samples = np.concatenate(payloads).reshape(-1, BLOCK) ^ 0x80
    number = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
    data, start = encode_frames(samples.view(np.int8), number)
    out, at = [], 0
    for count in frames:
        edge = start[at : at + count + 1]
        sizes = np.diff(edge)
        out.append(_stream_header(samples[at : at + count].tobytes(), int(sizes.min()), int(sizes.max())) + data[edge[0] : edge[-1]].tobytes())
        at += count
    return out


def _frame_starts(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of streams data[first:last]: frame starts, ends, header lengths and the stream of each frame."""
    sync = np.flatnonzero((data[:-4] == 0xFF) & (data[1:-3] == 0xF8) & (data[2:-2] == 0x14) & (data[3:-1] == 0x02))
    stream = np.searchsorted(first, sync, "right") - 1
    sync, stream = sync[(stream >= 0) & (sync < last[stream])], stream[(stream >= 0) & (sync < last[stream])]
    lead = data[sync + 4].astype(np.int64)
    count = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    number = np.where(count == 1, lead, lead & ((1 << (7 - count)) - 1))
    crc = np.zeros(len(sync), np.int64)
    for b in range(10):
        byte = data[np.minimum(sync + b, data.size - 1)].astype(np.int64)
        number = np.where((b > 4) & (b < 4 + count), number << 6 | byte & 0x3F, number)
        crc = np.where(b < 4 + count, CRC8[crc ^ byte], crc)
    good = crc == data[np.minimum(sync + 4 + count, data.size - 1)]
    sync, stream, number, count = sync[good], stream[good], number[good], count[good]
    # Frame numbers of a stream run from 0; a chance match between them does not carry the right number.
    nth = np.arange(len(sync)) - np.searchsorted(stream, stream)
    while (number != nth).any():
        keep = np.ones(len(sync), bool)
        keep[np.flatnonzero(number != nth)[0]] = False
        sync, stream, number, count = sync[keep], stream[keep], number[keep], count[keep]
        nth = np.arange(len(sync)) - np.searchsorted(stream, stream)
    end = np.append(sync[1:], 0)
    final = np.append(stream[1:] != stream[:-1], True) if len(sync) else np.zeros(0, bool)
    end[final] = last[stream[final]]
    return sync, end, 5 + count, stream


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Signed samples of frames, a row of 192 for each. Raises ValueError on a wrong checksum or an unknown subframe."""
    if (_crc16(data, start, end - start - 2) != (data[end - 2].astype(np.int32) << 8 | data[end - 1])).any():
        raise ValueError("a frame's CRC-16 does not match")
    n = len(start)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.ndarray((data.size + 8,), ">u8", padded, strides=(1,))
    bit = (start + head) * 8

    def take(count: np.ndarray, who: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The next `count` (up to 32) bits of each frame of who."""
        count = np.broadcast_to(count, bit[who].shape)
        at = bit[who]
        got = (window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) >> np.uint64(1) >> (63 - count).astype(np.uint64)
        bit[who] = at + count
        return got.astype(np.int64)

    def signed(value: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        return value - ((value >> (bits - 1) & 1) << bits)

    code = take(np.int64(8)) >> 1
    kind = np.select([code == 0, code == 1, (code >= 8) & (code <= 12), code >= 32], [CONSTANT, PLAIN, FIXED, LINEAR], -1)
    if (kind < 0).any():
        raise ValueError("an unknown subframe type")
    order = np.select([kind == FIXED, kind == LINEAR], [code - 8, code - 31], 0)
    deepest = int(order.max(initial=0))
    out = np.zeros((BLOCK, n), np.int64)
    still = np.flatnonzero(kind == CONSTANT)
    out[:, still] = signed(take(np.int64(8), still), 8)
    plain = np.flatnonzero(kind == PLAIN)
    for i in range(BLOCK if len(plain) else 0):
        out[i, plain] = signed(take(np.int64(8), plain), 8)
    coded = np.flatnonzero(kind >= FIXED)
    if not len(coded):
        return out.T
    o = order[coded]
    for i in range(deepest):
        who = coded[o > i]
        out[i, who] = signed(take(np.int64(8), who), 8)
    coefficient, shift = np.zeros((max(deepest, 1), n), np.int64), np.zeros(n, np.int64)
    for depth, fixed in enumerate(FIXED_COEFFICIENTS):
        for i, c in enumerate(fixed[:deepest]):
            coefficient[i, (kind == FIXED) & (order == depth)] = c
    linear = np.flatnonzero(kind == LINEAR)
    if len(linear):
        precision = take(np.int64(4), linear) + 1
        shift[linear] = take(np.int64(5), linear)
        for i in range(int(order[linear].max())):
            some = order[linear] > i
            coefficient[i, linear[some]] = signed(take(precision[some], linear[some]), precision[some])
    method, parts = take(np.int64(2), coded), take(np.int64(4), coded)
    if (method != 0).any():
        raise ValueError("an unknown residual coding")
    run = BLOCK >> parts
    coefficient, shift = coefficient[:, coded], shift[coded]
    at, param, s = bit[coded], np.zeros(len(coded), np.int64), out[:, coded]
    whole = bool((parts == 0).all())
    for i in range(BLOCK):
        opens = (i == o) if whole else ((i == o) & (i < run)) | ((i % run == 0) & (i > 0))
        if (i <= deepest if whole else True) and opens.any():
            w = window[at[opens] >> 3].astype(np.uint64) << (at[opens] & 7).astype(np.uint64)
            param[opens] = (w >> np.uint64(60)).astype(np.int64)
            at[opens] += 4
            if (param[opens] == 15).any():
                raise ValueError("an escaped partition")
        due = i >= o if i < deepest else None
        word = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        zeros = 32 - np.frexp((word >> np.uint64(32)).astype(np.float64))[1]
        if due is None and (zeros >= 32).any() or due is not None and (zeros[due] >= 32).any():
            raise ValueError("a quotient of more than 31")
        low = ((word << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - param).astype(np.uint64)).astype(np.int64)
        folded = zeros.astype(np.int64) << param | low
        residual = (folded >> 1) ^ -(folded & 1)
        if deepest:
            guess = coefficient[0] * s[i - 1] if i else np.zeros(len(coded), np.int64)
            for c in range(1, min(deepest, i)):
                guess = guess + coefficient[c] * s[i - 1 - c]
            residual = residual + (guess >> shift)
        if due is None:
            s[i] = residual
            at += zeros + 1 + param
        else:
            s[i] = np.where(due, residual, s[i])
            at += np.where(due, zeros + 1 + param, 0)
    out[:, coded] = s
    return out.T


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The unsigned bytes of each stream. Raises ValueError where a stream is broken."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    size = np.array([len(s) for s in streams], np.int64)
    last = np.cumsum(size)
    first = last - size
    if any(s[:4] != b"fLaC" for s in streams):
        raise ValueError("no stream marker")
    body = []
    for s, at in zip(streams, first, strict=True):
        block = 4
        while True:  # metadata blocks up to the one marked as the last
            closing, length = s[block] >> 7, int.from_bytes(s[block + 1 : block + 4], "big")
            block += 4 + length
            if closing:
                break
        body.append(at + block)
    start, end, head, stream = _frame_starts(data, np.array(body, np.int64), last)
    samples = decode_frames(data, start, end, head).astype(np.int8).view(np.uint8)
    edge = np.searchsorted(stream, np.arange(len(streams) + 1))
    out = []
    for i, s in enumerate(streams):
        found = samples[edge[i] : edge[i + 1]]
        if found.size != int.from_bytes(s[18:26], "big") & (1 << 36) - 1 or hashlib.md5(found.tobytes()).digest() != s[26:42]:
            raise ValueError("the stream's length or MD5 does not match")
        out.append((found ^ 0x80).ravel())
    return out


def payloads(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's bytes padded with spaces to a positive multiple of 192, and their sizes without padding."""
    data, starts = text_bytes(column)
    size = np.diff(starts)
    full = np.maximum(-(-size // BLOCK), 1) * BLOCK
    return [np.concatenate([data[a : a + n], np.full(f - n, PAD, np.uint8)]) for a, n, f in zip(starts[:-1], size, full, strict=True)], size


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                raw, size = payloads(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(encode(raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


BLOCKS = "array<struct<sample_offset: bigint, pcm: binary>>"


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every text as a FLAC stream in a table of the shared folder: doc_id, n_bytes and media."""
    return stage(spark, encoded(docs), "flac-media", "zstd")


def pcm_blocks(media: DataFrame, blocks: int = 64) -> DataFrame:
    """Samples of stored media in runs of `blocks` FLAC blocks: doc_id, n_bytes, media_bytes, media_sha256 and blocks, an array of sample_offset (where a run starts) and pcm (unsigned bytes). Rows without media are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                streams = part.column("media").to_pylist()
                cut = [[{"sample_offset": at, "pcm": pcm[at : at + blocks * BLOCK].tobytes()} for at in range(0, len(pcm), blocks * BLOCK)] for pcm in decode(streams)]
                columns = [part.column("doc_id"), part.column("n_bytes"), pa.array([len(m) for m in streams], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in streams], pa.string())]
                kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, kind)], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.filter("media IS NOT NULL").select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks {BLOCKS}")


def decoded(spark: SparkSession, media: DataFrame, blocks: int = 64) -> DataFrame:
    """The PCM blocks of stored media as a table of the shared folder."""
    return stage(spark, pcm_blocks(media, blocks), "flac-pcm", "zstd")


def seek(pcm: DataFrame, start: int, length: int) -> DataFrame:
    """doc_id and samples start to start + length (as far as there are any) of decoded media; only the blocks that hold them are put together."""
    size = lambda b: b["sample_offset"] + F.octet_length(b["pcm"])
    held = F.filter("blocks", lambda b: (size(b) > start) & (b["sample_offset"] < start + length))
    joined = F.aggregate(held, F.lit(b""), lambda upto, b: F.concat(upto, b["pcm"]))
    first = F.coalesce(F.get(held, F.lit(0))["sample_offset"], F.lit(0))
    return pcm.select("doc_id", F.substring(joined, (F.lit(start + 1) - first).cast("int"), F.lit(length)).alias("samples"))


def feature(pcm: np.ndarray) -> str:
    """Level, mean step, crossings of the mean and peak of samples, as text."""
    x = pcm.astype(np.float64) - 128
    step = np.abs(np.diff(x))
    side = x > x.mean()
    return f"rms={np.sqrt((x * x).mean()):.4f};step={step.mean():.4f};crossings={(side[1:] != side[:-1]).mean():.4f};peak={np.abs(x).max():.0f}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text as FLAC, read the stored bytes back, decode them into PCM blocks, and describe what these hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            data, starts = text_bytes(blocks.values.field("pcm"))
            edge = starts[blocks.offsets.to_numpy()]
            back = [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]
            columns = [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array([feature(p) for p in back], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGEST.split(", ")])

    return pcm_blocks(stored(spark, docs)).mapInArrow(run, DIGEST)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, table(spark, sf_dir, "documents"))
