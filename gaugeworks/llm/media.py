"""Interleaved sequences of text and media, and media stored as images.

A page becomes an ordered list of items: text, or a reference to media by the
digest of its stored form, with its caption.  References are resolved by a join
on the digest, and each comes back at its position with its caption.

Media are made from bytes: padded with spaces to a positive multiple of 192 and
stored as an 8-bit RGB image (PNG) of 64 pixels a row, which loses nothing.
Media alone are stored; the pages of :func:`interleaved_pages` are made from
them when they are read, a whole text with the image between its paragraphs.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._store import settle
from gaugeworks.llm._words import slices, texts_of, tidy

ROW, WIDTH, LEVEL = 192, 64, 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    return data + b" " * (ROW * max(1, -(-len(data) // ROW)) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An image of 64 RGB pixels a row whose samples are the payload (a multiple of 192 bytes)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    plain = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Rows x 192 samples of an image of :func:`to_png`; checks each chunk's sum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[0] != WIDTH or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not an 8-bit RGB image of 64 pixels a row")
    plain = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head[1], ROW + 1)
    if plain[:, 0].any():
        raise ValueError("rows are filtered")
    return plain[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean of each channel in thousandths, and counts of the samples in eight equal ranges."""
    means = samples.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // max(1, samples.size // 3)
    counts = np.bincount(samples.reshape(-1) >> 5, minlength=8)
    return f"{WIDTH}x{len(samples)};" + ",".join(map(str, means.tolist())) + ";" + ",".join(map(str, counts.tolist()))


def interleaved_page(digest: str, n_bytes: int, text: str) -> str:
    """A page of a whole text, a paragraph for each line that is not blank; the media made from it stand behind the first half of them."""
    parts = [f"<p>{html.escape(line)}</p>" for line in text.split("\n") if line.strip()]
    figure = f'<figure><img src="sha256:{digest}" width="{WIDTH}" data-bytes="{n_bytes}"><figcaption>text of {n_bytes} bytes in {len(parts)} paragraphs</figcaption></figure>'
    half = (len(parts) + 1) // 2
    return f"<article>{''.join(parts[:half])}{figure}{''.join(parts[half:])}</article>"


_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<!--.*?(?:-->|\Z)|([^<]+)|(<)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
# Elements that are media, and elements that end a text item.
_MEDIA = frozenset("img audio video source embed".split())
_BREAKS = frozenset("p div section article figure h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre br hr main body".split())
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,n_bytes:long>>"


def parse_items(page: str | None) -> list[dict]:
    """Items of a page in order: ``position``, ``kind`` (text or media), ``text`` (of media its caption), ``digest``, ``n_bytes``.

    A caption belongs to the media of its figure; without one, media have the
    text of their ``alt``, or none.  A reference that is no digest stays as it
    is written.  Empty texts are no items.
    """
    items, text, caption, open_media = [], [], None, []

    def flush() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            items.append({"position": len(items), "kind": "text", "text": words, "digest": None, "n_bytes": None})

    for m in _TAG.finditer(page or ""):
        close, name, attributes, plain, stray = m.groups()
        if plain or stray:
            (text if caption is None else caption).append(plain or stray)
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "figcaption":
            if close and caption is not None:
                words = " ".join(html.unescape("".join(caption)).split())
                for item in open_media:
                    item["text"] = words
                caption = None
            elif not close:
                flush()
                caption = []
        elif name in _MEDIA and not close:
            found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            if "src" in found:
                flush()
                size = found.get("data-bytes", "")
                items.append({"position": len(items), "kind": "media", "text": found.get("alt"), "digest": found["src"].removeprefix("sha256:"), "n_bytes": int(size) if size.isdigit() else None})
                open_media.append(items[-1])
        elif name in _BREAKS:
            flush()
            if name == "figure":
                open_media = []
    flush()
    return items


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, digest, n_bytes, media binary)`` in the shared folder: each text as media.  Null texts are empty."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = texts_of(batch.column("text"))
                media = [to_png(pad(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["id", "digest", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return settle(own.mapInArrow(tidy(run), f"id {kind}, digest string, n_bytes long, media binary"), "media")


def interleaved_pages(stored: DataFrame) -> DataFrame:
    """``(id, page)``: the page of each stored text, which is read back from its media.  Nothing is written."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "media"):
                digests, sizes = batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist()
                texts = [from_png(m).tobytes()[:n].decode("utf-8") for m, n in zip(batch.column("media").to_pylist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([interleaved_page(*x) for x in zip(digests, sizes, texts, strict=True)], pa.string())], ["id", "page"])

    return stored.mapInArrow(tidy(run), f"id {stored.schema['id'].dataType.simpleString()}, page string")


FEATURES = "media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """``(digest, media)`` -> one row per digest with what is read back from the stored bytes.

    Features are computed before equal digests meet, so a hot one is a partial
    aggregate of a short row.  Bytes that do not have their digest are an error.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "media"):
                rows = []
                for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                    if hashlib.sha256(stored).hexdigest() != digest:
                        raise ValueError("stored media do not have their digest")
                    samples = from_png(stored)
                    payload = samples.tobytes()
                    rows.append((digest, len(stored), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature(samples)))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["digest", "media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    found = media.select("digest", "media").mapInArrow(tidy(run), "digest string, " + FEATURES)
    return settle(found.groupBy("digest").agg(F.min(F.struct("media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")).alias("f")).select("digest", "f.*"), "features")


def sequences(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, items)``: the ordered items of each page; a null page has none."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "page"):
                items = [parse_items(p) for p in batch.column("page").to_pylist()]
                kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, kind)], ["id", "items"])

    return df.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("page")).mapInArrow(tidy(run), f"id {df.schema[id_col].dataType.simpleString()}, items {ITEM}")


def media_items(found: DataFrame) -> DataFrame:
    """The media items of ``(id, items)``: ``id, position, caption, n_bytes, digest`` and ``n_items`` of the whole sequence."""
    media = found.select("id", F.size("items").alias("n_items"), F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i"))
    return media.select("id", "i.position", F.col("i.text").alias("caption"), "i.n_bytes", "i.digest", "n_items")


def resolve(found: DataFrame, features: DataFrame) -> DataFrame:
    """:func:`media_items` joined with a table by ``digest``: :func:`media_features`, or the payloads themselves (:func:`payloads`).

    One row per media item, at its position and with its caption; what the
    table has is null where it lacks the digest.
    """
    return media_items(found).join(features, "digest", "left")


def payloads(stored: DataFrame) -> DataFrame:
    """``(digest, media)``: the stored bytes, once per digest."""
    return stored.groupBy("digest").agg(F.first("media").alias("media"))
