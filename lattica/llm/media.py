"""MPEG audio columns: a parser of frame headers, tags and variable-bitrate tables, and a writer of lossless payloads.

The parser reads MPEG 1, 2 and 2.5, layers I to III. It reads ID3v2 tags in front (2.2 to 2.4, with extended headers and
unsynchronisation), APE tags in front and behind and ID3v1 behind, searches for the next header that another one follows when
the bytes in between are no frame, checks the CRC of protected frames (of layer I and II over header, bit allocation and
scale factor selection, of layer III over header and side information), and reads Xing, Info and VBRI tables. Durations are
exact: samples and their rate.

The writer puts bytes where an encoder leaves room, in the ancillary data of silent, protected MPEG 1 layer III frames of
80 kbit/s at 48 kHz in mono: 240 bytes a frame, of which 4 are header, 2 CRC, 17 side information, 192 payload and 25 unused.
A first frame holds an Info table, and an ID3v2 tag in front holds the payload's size, so every player plays silence and
the payload comes back byte for byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

# Fixed values of the MPEG audio format: bitrates in kbit/s by (MPEG 1 or not, layer) and index, sample rates by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005
# Fixed values of layer II: (bits of an allocation, subbands) in a row, by the table that rate and bitrate choose.
ALLOCATIONS = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}

UNIT = 192
FRAME, FRONT = 240, 23
#: MPEG 1, layer III, protected; 80 kbit/s, 48 kHz; mono.
HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))
TAG_ID = b"lattica:payload"


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        for bit in range(7, -1, -1):
            crc = (crc << 1) ^ (CRC_POLYNOMIAL if (crc >> 15 ^ byte >> bit) & 1 else 0)
        crc &= 0xFFFF
    return crc


def _protected(frame: bytes, version: int, layer: int, kbits: int, hertz: int, channels: int) -> tuple[bytes, int]:
    """The bytes that a frame's CRC covers, and how many of their bits. The frame begins with its header and the CRC."""
    head, body = frame[2:4], frame[6:]
    if layer == 3:
        return head + body[: ((32, 17) if version == 3 else (17, 9))[channels == 1]], 0
    # Joint stereo shares the allocations from a bound on.
    bound = (frame[3] >> 4 & 3) * 4 + 4 if frame[3] >> 6 == 1 else 32
    if layer == 1:
        bits = 4 * (bound * channels + 32 - bound if channels == 2 else 32)
    else:
        own = kbits // channels
        if version != 3:
            table = "low"
        elif own <= 48:
            table = "d" if hertz == 32000 else "c"
        else:
            table = "a" if hertz == 48000 or own <= 80 else "b"
        widths = [w for w, n in ALLOCATIONS[table] for _ in range(n)]
        value, total, bits, used = int.from_bytes(body[:48]), 8 * len(body[:48]), 0, 0
        for band, width in enumerate(widths):
            shared = channels == 2 and band >= bound
            for _ in range(1 if shared else channels):
                bits += width
                if bits <= total and value >> total - bits & (1 << width) - 1:
                    used += channels if shared else 1
        bits += 2 * used
    return head + body[: -(-bits // 8)], 16 + bits


def _crc(part: bytes, bits: int) -> int:
    """The CRC of the first bits of some bytes, of all if bits is 0."""
    whole = bits // 8 if bits else len(part)
    crc = crc16(part[:whole])
    for bit in range(bits % 8 if bits else 0):
        crc = (crc << 1) ^ (CRC_POLYNOMIAL if (crc >> 15 ^ part[whole] >> 7 - bit) & 1 else 0)
    return crc & 0xFFFF


def parse_header(four: bytes) -> tuple[int, int, int, int, int, int, bool] | None:
    """(version code, layer, bitrate, sample rate, channels, frame bytes, protected), or None. Free-format frames, which do
    not tell their size, are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, pace = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or pace == 3:
        return None
    kbits, hertz = BITRATES[version == 3, layer][rate], SAMPLE_RATES[version][pace]
    padding = four[2] >> 1 & 1
    if layer == 1:
        size = (12000 * kbits // hertz + padding) * 4
    else:
        size = (72000 if layer == 3 and version != 3 else 144000) * kbits // hertz + padding
    return version, layer, kbits, hertz, 1 if four[3] >> 6 == 3 else 2, size, not four[1] & 1


def samples(version: int, layer: int) -> int:
    return 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _tags(data: bytes) -> tuple[int, int, dict]:
    """Where the audio begins and ends, and what the tags around it say."""
    start, end, tags = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10:
        size, major, flags = _syncsafe(data[start + 6 : start + 10]), data[start + 3], data[start + 5]
        body = data[start + 10 : start + 10 + size]
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        at = 0
        if flags & 0x40 and major >= 3 and len(body) >= 4:
            # The size counts itself from 2.4 on.
            at = _syncsafe(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4])
        name_bytes, front = (3, 6) if major == 2 else (4, 10)
        while at + front <= len(body) and body[at]:
            name = body[at : at + name_bytes].decode("latin-1")
            width = body[at + name_bytes : at + 2 * name_bytes]
            own = _syncsafe(width) if major >= 4 else int.from_bytes(width)
            value = body[at + front : at + front + own]
            if major >= 4 and body[at + 9] & 2:
                value = value.replace(b"\xff\0", b"\xff")
            if name == "PRIV":
                owner, _, value = value.partition(b"\0")
                name = f"PRIV:{owner.decode('latin-1')}"
            tags[name] = value
            at += front + own
        start += 10 + size + (10 if flags & 0x10 else 0)
    if data[start : start + 8] == b"APETAGEX" and len(data) >= start + 32:
        tags["APE"] = data[start + 32 : start + 32 + int.from_bytes(data[start + 12 : start + 16], "little")]
        start += 32 + int.from_bytes(data[start + 12 : start + 16], "little")
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags["ID3v1"] = data[end - 125 : end]
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        # The size counts the items and this footer; a header in front of them has as many bytes as the footer.
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        tags["APE"] = data[max(start, end - size) : end - 32]
        end = max(start, end - size - (32 if data[end - 9] & 0x80 else 0))
    return min(start, end), end, tags


def _table(frame: bytes, version: int, channels: int, protected: bool) -> dict | None:
    """The variable-bitrate table of a first frame."""
    side = (32, 17) if version == 3 else (17, 9)
    at = 4 + 2 * protected + side[channels == 1]
    for at in {at, 4 + side[channels == 1]}:
        if (kind := frame[at : at + 4]) in (b"Xing", b"Info"):
            flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
            found: dict = {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[name], at = int.from_bytes(frame[at : at + 4]), at + 4
            if flags & 4:
                found["seek"] = list(frame[at : at + 100])
            return found
    if frame[36:40] == b"VBRI":
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        seek = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "seek": seek}
    return None


def parse(data: bytes, checked: dict[tuple[bytes, int], int] | None = None) -> dict:
    """What a stream holds: tags, table, frames as offsets and sizes (without the table's), samples, hertz, duration in
    seconds as a Fraction, bitrates seen, CRCs good, bad and absent, and bytes skipped to find a frame again.

    Empty or foreign bytes have no frames and last no time. checked keeps the CRCs of protected parts already seen.
    """
    checked = {} if checked is None else checked
    at, end, tags = _tags(data)
    offsets, sizes, bitrates = [], [], {}
    total = hertz = good = bad = absent = skipped = 0
    table = None
    duration = Fraction(0)
    synced, first = False, True
    known: dict[bytes, tuple | None] = {}
    while at + 4 <= end:
        four = data[at : at + 4]
        if four in known:
            head = known[four]
        else:
            head = known[four] = parse_header(four)
        if head and at + head[5] <= end:
            after = at + head[5]
            # A header alone may be chance: unless the frame before led here, another must follow, or the end.
            if not synced and after + 4 <= end and not parse_header(data[after : after + 4]):
                head = None
        else:
            head = None
        if head is None:
            synced = False
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            skipped += step - at
            at = step
            continue
        version, layer, kbits, own_hertz, channels, size, protected = head
        frame_at, at, synced = at, at + size, True
        if protected:
            covered = _protected(data[frame_at:at], version, layer, kbits, own_hertz, channels)
            if covered not in checked:
                if len(checked) > 4096:
                    checked.clear()
                checked[covered] = _crc(*covered)
            if checked[covered] == data[frame_at + 4] << 8 | data[frame_at + 5]:
                good += 1
            else:
                bad += 1
        else:
            absent += 1
        if first:
            first = False
            table = _table(data[frame_at:at], version, channels, protected) if layer == 3 else None
            if table:
                continue
        offsets.append(frame_at)
        sizes.append(size)
        bitrates[kbits] = bitrates.get(kbits, 0) + 1
        n = samples(version, layer)
        if hertz and own_hertz != hertz:
            duration += Fraction(total, hertz)
            total = 0
        hertz, total = own_hertz, total + n
    duration += Fraction(total, hertz) if hertz else 0
    return {"tags": tags, "table": table, "offsets": offsets, "sizes": sizes, "hertz": hertz, "duration": duration, "bitrates": bitrates, "crc_good": good, "crc_bad": bad, "crc_absent": absent, "skipped": skipped + max(0, end - at if at < end else 0)}


def padded(raw: bytes) -> bytes:
    """The payload of some bytes: spaces up to a positive multiple of UNIT."""
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """An MPEG audio stream that holds payload, whole units, of which n_bytes come from the document."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    front = np.frombuffer(HEADER + struct.pack(">H", crc16(HEADER[2:] + bytes(17))) + bytes(17), np.uint8)
    frames = np.zeros((len(units), FRAME), np.uint8)
    frames[:, :FRONT] = front
    frames[:, FRONT : FRONT + UNIT] = units
    audio = frames.tobytes()
    seek = bytes(min(255, i * 256 // 100) for i in range(100))
    table = front.tobytes() + b"Info" + struct.pack(">III", 7, len(units), FRAME + len(audio)) + seek
    body = TAG_ID + b"\0" + struct.pack(">Q", n_bytes)
    tag = b"PRIV" + _safe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _safe(len(tag)) + tag + table.ljust(FRAME, b"\0") + audio


def _safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def read_payload(data: bytes, found: dict) -> bytes:
    """The payload of a stream that write_stream made, from its parsed frames."""
    if not found["offsets"]:
        return b""
    at = np.array(found["offsets"])
    return np.frombuffer(data, np.uint8)[at[:, None] + np.arange(FRONT, FRONT + UNIT)].tobytes()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the stream that holds the whole text as UTF-8, for each row of docs (doc_id, text, more).

    A null text is an empty one, one unit of spaces. Equal texts give equal streams, and repeated rows a row each. An empty
    table gives no rows. A batch's streams are in memory at once.
    """

    def start() -> Callable[[dict], dict]:
        def apply(batch: dict) -> dict:
            raws = [(t or "").encode() for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "media": [write_stream(padded(r), len(r)) for r in raws]}

        return apply

    return map_rows(docs.select("doc_id", "text"), start, "doc_id long, media binary")


def store_media(docs: DataFrame, folder: str) -> DataFrame:
    """Writes encode_media's streams as zstandard-packed Parquet in folder, a URI that all executors reach, and returns the
    table read back: doc_id, media."""
    made = encode_media(docs)
    made.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def media_features(media: DataFrame) -> DataFrame:
    """What the streams of media (doc_id, media) hold, from their bytes alone: n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, n_frames, duration_samples and duration_hertz (the exact duration is their
    quotient; 0 and 1 without frames), duration_ms (cut), frame_offsets (each frame's place) and feature (rate, frames,
    exact duration, bitrates, CRCs, table and a hash of the offsets). A null stream is an empty one; an empty table gives
    no rows."""

    def start() -> Callable[[dict], dict]:
        checked: dict[tuple[bytes, int], int] = {}

        def one(data: bytes) -> tuple:
            found = parse(data, checked)
            payload = read_payload(data, found)
            own = found["tags"].get(f"PRIV:{TAG_ID.decode()}", bytes(8))
            offsets = np.array(found["offsets"], np.int64)
            seconds = found["duration"]
            rates = ",".join(f"{k}x{n}" for k, n in sorted(found["bitrates"].items()))
            table = found["table"] or {}
            feature = f"hz={found['hertz']};frames={len(offsets)};seconds={seconds.numerator}/{seconds.denominator};kbps={rates};crc={found['crc_good']}/{found['crc_bad']}/{found['crc_absent']};skipped={found['skipped']};table={table.get('kind', '-')}:{table.get('frames', '-')};seek={zlib.crc32(offsets.astype('<i8').tobytes()):08x}"
            return struct.unpack(">Q", own)[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(offsets), seconds.numerator, seconds.denominator, int(seconds * 1000), offsets, feature

        def apply(batch: dict) -> dict:
            rows = list(zip(*(one(m or b"") for m in batch["media"]), strict=True)) or [[]] * 12
            return dict(zip(("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_samples", "duration_hertz", "duration_ms", "frame_offsets", "feature"), (batch["doc_id"], *rows), strict=True))

        return apply

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, duration_samples long, duration_hertz long, duration_ms long, frame_offsets array<long>, feature string"
    return map_rows(media.select("doc_id", "media"), start, schema)
