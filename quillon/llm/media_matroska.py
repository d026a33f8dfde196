"""Media columns: Matroska files as packet tables, and lossless storage of bytes as 8-bit samples in such files.

Element ids and structure follow the public EBML and Matroska specifications (RFC 8794 and RFC 9559).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.confirm import parts

# Element ids of the Matroska specification.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster of unknown size.
_TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367, SEGMENT, EBML}

#: 576 8-bit samples are one frame, and 12 ms at 48 kHz.
FRAME, RATE, MS = 576, 48_000, 12
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size: as many leading zero bits as bytes follow the first."""
    n = width or next(n for n in range(1, 9) if value < (1 << (7 * n)) - 1)
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def _element(element: int, body: bytes) -> bytes:
    return _id(element) + vint(len(body)) + body


def _uint(element: int, value: int) -> bytes:
    return _element(element, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _block(frames: list[bytes], track: int, relative: int, lacing: int) -> bytes:
    head = vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1 if lacing != FIXED else 0x84])
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0])
        for before, s in zip(sizes[:-2], sizes[1:-1], strict=True):
            n = next(n for n in range(1, 9) if abs(s - before) < 1 << (7 * n - 1))
            head += vint(s - before + (1 << (7 * n - 1)) - 1, n)
    return head + b"".join(frames)


def _lacing_bits(flags: int) -> int:
    return {0: NO_LACING, 1: XIPH, 2: FIXED, 3: EBML_LACING}[flags >> 1 & 3]


def write(payload: bytes, frames_per_block: int = 4, blocks_per_cluster: int = 128) -> bytes:
    """A file with one 8-bit PCM track whose frames are the payload's; blocks take turns with the kinds of lacing."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    header = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"quillon") + _element(WRITING_APP, b"quillon"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, np.float32(RATE).astype(">f4").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, MS * 1_000_000)
    parts, cues = [info, _element(TRACKS, _element(TRACK_ENTRY, track + audio))], []
    at = sum(map(len, parts))
    step = frames_per_block * blocks_per_cluster
    for first in range(0, len(frames), step):
        body = [_uint(TIMESTAMP, first * MS)]
        for k, i in enumerate(range(first, min(first + step, len(frames)), frames_per_block)):
            group = frames[i : i + frames_per_block]
            body.append(_element(SIMPLE_BLOCK, _block(group, 1, (i - first) * MS, NO_LACING if len(group) == 1 else (XIPH, FIXED, EBML_LACING)[k % 3])))
        parts.append(_element(CLUSTER, b"".join(body)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * MS) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    return header + _element(SEGMENT, b"".join([*parts, _element(CUES, b"".join(cues))]))


class Damaged(ValueError):
    """The bytes are not a well-formed file."""


def _read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Damaged(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep_marker else value & ((1 << (7 * n)) - 1)), n


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(id, where the element begins, where its body begins, where it ends, is its size unknown) of each element."""
    while at < end:
        start = at
        element, n = _read_vint(data, at, end, keep_marker=True)
        at += n
        size, n = _read_vint(data, at, end)
        at += n
        unknown = size == (1 << (7 * n)) - 1
        stop = end if unknown else at + size
        if stop > end:
            raise Damaged(f"element at byte {start} goes beyond its parent")
        if unknown and element == CLUSTER:
            stop = at
            for inner, begin, _, after, _ in _children(data, at, end):
                if inner in _TOP:
                    stop = begin
                    break
                stop = after
        yield element, start, at, stop, unknown
        at = stop


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose header ends at ``at``."""
    if lacing == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise Damaged(f"cut off at byte {at}")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise Damaged(f"frames of unequal size at byte {at}")
        sizes = [(end - at) // n] * n
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"cut off at byte {at}")
                b = data[at]
                at += 1
                size += b
                if b < 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            value, width = _read_vint(data, at, end)
            at += width
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise Damaged(f"frames go beyond their block at byte {at}")
    stops = np.cumsum([at, *sizes]).tolist()
    return list(zip(stops[:-1], stops[1:], strict=True))


def parse(data: bytes) -> tuple[list[tuple], list[tuple], list[tuple], str | None]:
    """(packets, tracks, cues, what is damaged) of a file; what comes before damage is kept.

    Packet: track, timestamp in ns, first byte, length, keyframe, lacing, cluster's first byte. Frames of one block
    follow each other by the track's default duration. Track: number, type, codec, sampling frequency, channels,
    bit depth, default duration. Cue: time in ns, track, cluster's first byte.
    """
    packets: list[tuple] = []
    tracks: dict[int, tuple] = {}
    cues: list[tuple] = []
    scale = 1_000_000

    def block(at: int, end: int, base: int, cluster: int, key: bool | None) -> None:
        track, n = _read_vint(data, at, end)
        at += n
        if at + 3 > end:
            raise Damaged(f"cut off at byte {at}")
        time, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        lacing = _lacing_bits(flags)
        step = tracks[track][6] if track in tracks else 0
        for k, (a, b) in enumerate(_laced(data, at + 3, end, lacing)):
            packets.append((track, (base + time) * scale + k * step, a, b - a, bool(flags & 0x80) if key is None else key, lacing, cluster))

    try:
        for top, _, at, end, _ in _children(data, 0, len(data)):
            if top != SEGMENT:
                continue
            origin = at
            for element, start, at1, end1, _ in _children(data, at, end):
                if element == INFO:
                    for e, _, a, b, _ in _children(data, at1, end1):
                        if e == TIMESTAMP_SCALE:
                            scale = _number(data, a, b)
                elif element == TRACKS:
                    for e, _, a, b, _ in _children(data, at1, end1):
                        if e != TRACK_ENTRY:
                            continue
                        v: dict[int, object] = {}
                        for e2, _, a2, b2, _ in _children(data, a, b):
                            if e2 == AUDIO:
                                for e3, _, a3, b3, _ in _children(data, a2, b2):
                                    v[e3] = float(np.frombuffer(data[a3:b3], f">f{b3 - a3}")[0]) if e3 == SAMPLING_FREQUENCY and b3 - a3 in (4, 8) else _number(data, a3, b3)
                            else:
                                v[e2] = data[a2:b2].decode("ascii", "replace") if e2 == CODEC_ID else _number(data, a2, b2)
                        number = int(v.get(TRACK_NUMBER, 0))
                        tracks[number] = (number, v.get(TRACK_TYPE), v.get(CODEC_ID), v.get(SAMPLING_FREQUENCY), v.get(CHANNELS), v.get(BIT_DEPTH), int(v.get(DEFAULT_DURATION, 0)))
                elif element == CLUSTER:
                    base = 0
                    for e, _, a, b, _ in _children(data, at1, end1):
                        if e == TIMESTAMP:
                            base = _number(data, a, b)
                        elif e == SIMPLE_BLOCK:
                            block(a, b, base, start, None)
                        elif e == BLOCK_GROUP:
                            inner = [(e2, a2, b2) for e2, _, a2, b2, _ in _children(data, a, b)]
                            for e2, a2, b2 in inner:
                                if e2 == BLOCK:
                                    block(a2, b2, base, start, all(x[0] != REFERENCE_BLOCK for x in inner))
                elif element == CUES:
                    for e, _, a, b, _ in _children(data, at1, end1):
                        time = 0
                        for e2, _, a2, b2, _ in _children(data, a, b) if e == CUE_POINT else ():
                            if e2 == CUE_TIME:
                                time = _number(data, a2, b2)
                            elif e2 == CUE_TRACK_POSITIONS:
                                where = {e3: _number(data, a3, b3) for e3, _, a3, b3, _ in _children(data, a2, b2)}
                                cues.append((time * scale, where.get(CUE_TRACK), origin + where.get(CUE_CLUSTER_POSITION, 0)))
    except Damaged as x:
        return packets, list(tracks.values()), cues, str(x)
    return packets, list(tracks.values()), cues, None


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each whole text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, as a file.

    Null text is empty. Equal texts give equal files. Rows with equal ids are stored each for itself; other columns
    are not read.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):  # by bytes, so that long texts do not meet in one array of files
            raw = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("text").cast(pa.large_string())]
            media = [write(b + b"\xff" * (max(1, -(-len(b) // FRAME)) * FRAME - len(b))) for b in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of the files in ``media`` (``doc_id``, ``media``): track, time, byte range, keyframe, lacing, cluster, cue and damage.

    ``cued`` says whether a cue points at the packet's cluster. Null or empty files have no packets; a damaged file
    has those before the damage, each with ``error`` set; a file without any packet has no row.
    """
    names = ["doc_id", "packet", "track", "timestamp_ns", "byte_start", "byte_length", "keyframe", "lacing", "cluster_start", "cued", "error"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packets, _, cues, error = parse(batch.column("media")[i].as_py() or b"")
                cued = {c[2] for c in cues}
                columns = list(zip(*[(k, *p, p[6] in cued, error) for k, p in enumerate(packets)], strict=True)) or [()] * len(kinds)
                ids = batch.column("doc_id").slice(i, 1).take(pa.array([0] * len(packets), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, packet long, track long, timestamp_ns long, byte_start long, byte_length long, keyframe boolean, lacing int, cluster_start long, cued boolean, error string"
    return media.select("doc_id", "media").mapInArrow(f, schema)


def read_back(media: DataFrame) -> DataFrame:
    """The payload of each file in ``media``, put together from its packets' byte ranges, as digests and a feature string.

    Adds ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 32 bytes), ``media_bytes``, ``media_sha256``,
    ``feature`` (counts, duration and sample statistics as integers) and ``error`` to ``doc_id`` and ``n_bytes``.
    A null file counts as an empty one, whose payload is empty.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(data: bytes) -> tuple:
        packets, tracks, cues, error = parse(data)
        payload = b"".join([data[p[2] : p[2] + p[3]] for p in packets])
        samples = np.frombuffer(payload, np.uint8)
        end = max((p[1] + (tracks[0][6] if tracks else 0) for p in packets), default=0)
        feature = f"tracks={len(tracks)};clusters={len({p[6] for p in packets})};cues={len(cues)};packets={len(packets)};ms={end // 1_000_000};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max(initial=0))};steps={int(np.count_nonzero(samples[1:] != samples[:-1]))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, error

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[one(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("media").cast(pa.large_binary())], strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", *names])

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(f, schema)
