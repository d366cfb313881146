"""Matroska media columns: EBML writer and parser, packet tables with timestamps, tracks and byte ranges.

``encode_media`` turns texts into Matroska files with one 8-bit PCM track; ``packet_tables`` parses any
Matroska bytes column into a packet table beside each file, ``packets`` makes that one row per frame;
``media_features`` reads stored files through their packet tables.

Defined cases: a null text counts as empty; an empty text gives one 576-byte frame of 255s; equal
texts give equal files; damaged and foreign files raise ``ValueError`` in ``parse``, and ``packets`` gives them
one row with a null track and the message in ``error``; extra columns are left out of the results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, written

#: Element IDs of the EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, LACING_FLAG, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, TRACKS, TRACK_ENTRY, AUDIO, INFO, CUES, CUE_POINT, CUE_TRACK_POSITIONS, BLOCK_GROUP}
TOP = {CLUSTER, CUES, INFO, TRACKS}

FRAME, RATE, LACE, BLOCKS = 576, 48_000, 8, 32
FRAME_NS = FRAME * 1_000_000_000 // RATE


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones is kept for an unknown size."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(i: int, body: bytes) -> bytes:
    return _id(i) + vint(len(body)) + body


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> tuple[int, bytes]:
    """Flags and body of a laced block: kind 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == 3:
        sizes = [len(f) for f in frames]
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
            head += vint(d + (1 << 7 * w - 1) - 1, w)
    return kind << 1, head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit mono track; the payload is whole frames of 576 bytes."""
    frames = len(payload) // FRAME
    ms = FRAME_NS // 1_000_000
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * ms)) + element(MUXING_APP, b"shelfmatch") + element(WRITING_APP, b"shelfmatch"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING_FLAG, 1) + uint(DEFAULT_DURATION, FRAME_NS) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, frames, LACE * BLOCKS):
        body = [uint(TIMESTAMP, c * ms)]
        for b in range(c, min(frames, c + LACE * BLOCKS), LACE):
            n = min(LACE, frames - b)
            data = payload[b * FRAME : (b + n) * FRAME]
            rel = struct.pack(">h", (b - c) * ms)
            laced = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"  # a keyframe, with fixed lacing where there is more than one frame
            body.append(element(SIMPLE_BLOCK, b"\x81" + rel + laced + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c * ms) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(b: bytes, at: int, marker: bool) -> tuple[int, int]:
    """Value and end; an ID keeps its length marker, an unknown size is -1."""
    if at >= len(b) or not b[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    w = 9 - b[at].bit_length()
    if at + w > len(b):
        raise ValueError(f"integer cut off at byte {at}")
    n = int.from_bytes(b[at : at + w], "big")
    if marker:
        return n, at + w
    n ^= 1 << 7 * w
    return (-1 if n == (1 << 7 * w) - 1 else n), at + w


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(ID, body start, body end) of each child; an element of unknown size ends where one of a higher level starts."""
    while at < end:
        i, p = read_vint(b, at, True)
        n, p = read_vint(b, p, False)
        stop = p + n
        if n < 0:
            stop = end
            if i == CLUSTER:
                for j, q, r in elements(b, p, end):
                    if j in TOP:
                        stop = q - len(_id(j)) - next(w for w in range(1, 9) if q - w >= 0 and b[q - w] and 9 - b[q - w].bit_length() == w)
                        break
        if stop > end:
            raise ValueError(f"element {i:x} at byte {at} runs over its parent")
        yield i, p, stop
        at = stop


def _uint(b: bytes, p: int, q: int) -> int:
    return int.from_bytes(b[p:q], "big")


def frames_of(b: bytes, p: int, q: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of a block's frames."""
    track, p = read_vint(b, p, False)
    rel, flags = struct.unpack_from(">hB", b, p)
    p += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, rel, flags, [(p, q)]
    n, p = b[p] + 1, p + 1
    if kind == 2:
        size, left = divmod(q - p, n)
        if left:
            raise ValueError("a fixed lace doesn't divide its block")
        return track, rel, flags, [(p + k * size, p + (k + 1) * size) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while b[p] == 255:
                size, p = size + 255, p + 1
            size, p = size + b[p], p + 1
        else:
            at = p
            size, p = read_vint(b, p, False)
            if k:
                size = sizes[-1] + size - ((1 << 7 * (p - at) - 1) - 1)
        sizes.append(size)
    sizes.append(q - p - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes run over their block")
    out = []
    for size in sizes:
        out.append((p, p + size))
        p += size
    return track, rel, flags, out


def parse(b: bytes) -> dict:
    """tracks, packets (track, time in ns, byte from, byte to, keyframe), cues (time, track, byte), clusters, and starts (their first bytes).

    ValueError where the bytes are no Matroska file, are damaged, or hold a cue whose cluster or packet isn't there.
    """
    out: dict = {"tracks": {}, "packets": [], "cues": [], "clusters": 0, "starts": [], "scale": 1_000_000}
    if int.from_bytes(b[:4], "big") != EBML:
        raise ValueError("no EBML header")
    try:
        for i, p, q in elements(b, 0, len(b)):
            if i == SEGMENT:
                _segment(b, p, q, out)
    except (IndexError, struct.error) as e:
        raise ValueError(f"a block is cut off: {e}") from e
    starts, known = set(out["starts"]), {x[:2] for x in out["packets"]}
    for time, track, at in out["cues"]:
        if at not in starts or (track, time) not in known:
            raise ValueError(f"the cue to byte {at} leads nowhere")
    return out


def _segment(b: bytes, start: int, end: int, out: dict) -> None:
    at, next_at = start, start
    for i, p, q in elements(b, start, end):
        at, next_at = next_at, q  # where the element itself begins
        if i == INFO:
            for j, r, s in elements(b, p, q):
                if j == TIMESTAMP_SCALE:
                    out["scale"] = _uint(b, r, s)
        elif i == TRACKS:
            for j, r, s in elements(b, p, q):
                if j == TRACK_ENTRY:
                    e = {k: b[u:v] for k, u, v in elements(b, r, s)}
                    out["tracks"][int.from_bytes(e.get(TRACK_NUMBER, b""), "big")] = {"codec": e.get(CODEC_ID, b"").decode("ascii", "replace"), "type": int.from_bytes(e.get(TRACK_TYPE, b""), "big"), "frame_ns": int.from_bytes(e.get(DEFAULT_DURATION, b""), "big")}
        elif i == CUES:
            for _, r, s in elements(b, p, q):
                time, found = 0, []
                for k, u, v in elements(b, r, s):
                    if k == CUE_TIME:
                        time = _uint(b, u, v)
                    elif k == CUE_TRACK_POSITIONS:
                        e = {x: _uint(b, y, z) for x, y, z in elements(b, u, v)}
                        found.append((e.get(CUE_TRACK, 0), start + e.get(CUE_CLUSTER_POSITION, 0)))
                out["cues"] += [(time * out["scale"], t, x) for t, x in found]
        elif i == CLUSTER:
            out["clusters"] += 1
            out["starts"].append(at)
            base = 0
            for j, r, s in elements(b, p, q):
                if j == TIMESTAMP:
                    base = _uint(b, r, s)
                elif j == SIMPLE_BLOCK:
                    _block(b, r, s, base, out, None)
                elif j == BLOCK_GROUP:
                    for k, u, v in elements(b, r, s):
                        if k == BLOCK:
                            _block(b, u, v, base, out, True)


def _block(b: bytes, p: int, q: int, base: int, out: dict, key: bool | None) -> None:
    track, rel, flags, ranges = frames_of(b, p, q)
    at, step = (base + rel) * out["scale"], out["tracks"].get(track, {}).get("frame_ns", 0)
    key = bool(flags & 0x80) if key is None else key
    out["packets"] += [(track, at + k * step, u, v, key) for k, (u, v) in enumerate(ranges)]


def encode_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes and the Matroska file (binary column ``media``) of each text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, files, ids, held = [], [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (t.as_py() or "").encode()
                pad = -len(raw) % FRAME if raw else FRAME
                files.append(write(raw + b"\xff" * pad))
                n.append(len(raw))
                ids.append(i)
                held += len(raw)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])
                    n, files, ids, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


#: A packet table as a column: one entry for each frame, in order.
PACKETS = "array<struct<track:bigint,time_ns:bigint,byte_from:bigint,byte_to:bigint,keyframe:boolean>>"


def _packet_array(tables: list[list[tuple]]) -> pa.ListArray:
    names = ["track", "time_ns", "byte_from", "byte_to", "keyframe"]
    flat = list(zip(*(p for t in tables for p in t))) or [()] * 5
    entries = pa.StructArray.from_arrays([pa.array(c, pa.bool_() if n == "keyframe" else pa.int64()) for n, c in zip(names, flat)], names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tables])]), pa.int32()), entries)


def packet_tables(df: DataFrame, id_col: str, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, media, packets, clusters, cues (all checked against clusters and packets), error and the kept columns of every file; null: no bytes."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            tables, clusters, cues, errors = [], [], [], []
            for b in batch.column(1):
                try:
                    found, error = parse(b.as_py() or b""), None
                except ValueError as e:
                    found, error = {"packets": [], "clusters": 0, "cues": []}, str(e)
                tables.append(found["packets"])
                clusters.append(found["clusters"])
                cues.append(len(found["cues"]))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packet_array(tables), pa.array(clusters, pa.int64()), pa.array(cues, pa.int64()), pa.array(errors, pa.string()), *(batch.column(2 + k) for k in range(len(keep)))], ["id", "media", "packets", "clusters", "cues", "error", *keep])

    rows = df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{media_col}` as media", *(f"`{c}`" for c in keep))
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"id long, media binary, packets {PACKETS}, clusters long, cues long, error string{kept}").withColumnRenamed("id", id_col)


def packets(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row for each frame: id, packet, track, time_ns, byte_from, byte_to, keyframe, error; a damaged file is one row with its error."""
    each = packet_tables(df, id_col, media_col).select(id_col, "error", F.posexplode_outer("packets").alias("packet", "p")).where("p is not null or error is not null")
    return each.select(id_col, F.coalesce("packet", F.lit(0)).cast("long").alias("packet"), *(F.col(f"p.{c}").alias(c) for c in ("track", "time_ns", "byte_from", "byte_to", "keyframe")), "error")


def features(payload: bytes, times: np.ndarray, clusters: int, cues: int) -> str:
    """Sample statistics over all packets of the track, as text."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    v = np.arange(256) - 128.0
    mean, power = float(n @ v) / len(x), float(n @ (v * v)) / len(x)
    p = n[n > 0] / len(x)
    turns = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    return f"packets={len(times)};clusters={clusters};cues={cues};ms={(int(times[-1]) + FRAME_NS) // 1_000_000};mean={mean:.4f};rms={power**0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};crossings={turns}"


def media_features(df: DataFrame, id_col: str) -> DataFrame:
    """Digests of the payload that the packet tables of stored files point to (columns of packet_tables, and n_bytes); damaged files are left out."""
    ship(df.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            table = batch.column(2)
            entry, cut = table.flatten(), table.offsets.to_numpy() - table.offsets[0].as_py()
            time, start, end = (entry.field(c).to_numpy() for c in (1, 2, 3))
            for k, (i, m, clusters, cues, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                b, own = m.as_py(), slice(cut[k], cut[k + 1])
                payload = b"".join([b[x:y] for x, y in zip(start[own].tolist(), end[own].tolist())])
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), features(payload, time[own], clusters, cues)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    good = df.where("error is null").selectExpr(f"`{id_col}` as id", "media", "packets", "clusters", "cues", "n_bytes")
    return good.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text of documents as a Matroska file in a written table, and reads the features back through its packet table."""
    return media_features(packet_tables(written(encode_media(docs, "doc_id", "text")), "doc_id", keep=("n_bytes",)), "doc_id")
