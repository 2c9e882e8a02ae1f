"""Media columns: interleaved document sequences.

HTML becomes an ordered sequence of structs, text or a media reference with its caption; a reference names its payload by
digest, and a join on the digest resolves it against a media table, positions and captions kept. Payloads are stored
losslessly as 8-bit grey PNG images, 64 samples a row, and features are computed from the bytes read back.

A reference whose digest is unknown keeps its place with null media columns; a null payload counts as empty; empty payloads
are one row of zeros; equal payloads are stored once per batch and resolve alike; repeated rows stay; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, mark, release, rows_of, staged, table
from .htmltree import BLOCK, scan

WIDTH, SCHEME, LEVEL, SALT, HOT = 64, "digest:", 1, 16, 10_000
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of the width, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, WIDTH to a row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; every check sum is verified."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("not a PNG image")
    at, data, height = len(_SIGNATURE), [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("another kind of image")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered image")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples, and shares of the four quarters of their range."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / n.sum()
    level = np.arange(256)
    mean = float((p * level).sum())
    sd = float(np.sqrt((p * (level - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    quarters = ",".join(f"{x:.4f}" for x in p.reshape(4, 64).sum(1))
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};sd={sd:.4f};entropy={entropy:.4f};quarters={quarters}"


def sequence_of(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption) in page order; a figure's caption, wherever in it and of however many blocks, goes to all its references."""
    items: list[list] = []
    parts: list[str] = []
    figures: list[tuple[list[list], list[str]]] = []  # references and caption of the figures that are open
    captioning = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text and captioning and figures:
            figures[-1][1].append(text)
        elif text:
            items.append([0, "text", text, None, None])

    def shut() -> None:
        references, caption = figures.pop()
        text = "\n".join(caption)
        if text and not references:  # nothing to belong to: text like any other
            items.append([0, "text", text, None, None])
        for x in references if text else ():
            x[4] = text

    for kind, node, text in scan(page or ""):
        if kind == "text":
            if not any(n.name in ("script", "style", "title") for n in [node] if n is not None):
                parts.append(text)
            continue
        if node.name in BLOCK or node.name == "br" and captioning:
            flush()
        elif node.name == "br":
            parts.append(" ")
        if node.name == "figure":
            if kind == "open":
                figures.append(([], []))
            elif kind == "close" and figures:
                shut()
        elif node.name == "figcaption":
            captioning += 1 if kind == "open" else -1 if kind == "close" else 0
        if kind != "close" and node.name in ("img", "video", "audio", "source") and (src := node.get("src")):
            flush()
            digest = src.removeprefix(SCHEME) if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "surrogatepass")).hexdigest()
            items.append([0, "media", None, digest, node.get("alt") or None])
            if figures:
                figures[-1][0].append(items[-1])
    flush()
    while figures:
        shut()
    return [(i, *x[1:]) for i, x in enumerate(items)]


def interleave(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, position, kind, text, digest, caption): the sequence of each page, a row per item."""
    kind = T.StructType([T.StructField("key", pages.schema[key].dataType), *T._parse_datatype_string(f"items {ITEM}").fields])

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            names = ("position", "kind", "text", "digest", "caption")
            return {"key": batch.column(0), "items": [[dict(zip(names, x, strict=True)) for x in sequence_of(p)] for p in rows_of(batch, "page")]}

        return run

    out = map_batches(pages.select(F.col(key).alias("key"), F.col(page).alias("page")), make, kind)
    return out.select(F.col("key").alias(key), F.inline("items"))


def resolve(items: DataFrame, media: DataFrame, by: str, salt: int = SALT, hot: int = HOT) -> DataFrame:
    """Items with the media table's columns by digest; media has one row per digest.

    A digest that more than `hot` items name is spread by a hash of the column `by`, its media row copied `salt` times; the media row of
    any other is one. The items are read twice; the digests that are spread, at most one for `hot` items, are broadcast."""
    turn = F.pmod(F.xxhash64(by), F.lit(salt))
    many = F.broadcast(items.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > hot) & F.col("digest").isNotNull()).select("digest", F.lit(True).alias("_many")))
    spread = media.join(many, "digest", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_many"), F.lit(salt - 1)).otherwise(F.lit(0)).cast("long")))).drop("_many")
    placed = items.join(many, "digest", "left").withColumn("_salt", F.when(F.col("_many") | F.col("digest").isNull(), turn).otherwise(F.lit(0).cast("long"))).drop("_many")
    return placed.join(spread, ["digest", "_salt"], "left").drop("_salt")


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, media): payloads of the texts as images, once per batch and digest."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            got = {}
            for t in rows_of(batch, "text"):
                payload, _ = payload_of(t)
                if (digest := hashlib.sha256(payload).hexdigest()) not in got:
                    got[digest] = to_png(payload)
            return {"digest": list(got), "media": list(got.values())}

        return run

    return map_batches(docs.select(F.col(text).alias("text")), make, "digest string, media binary")


def describe(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: one row per digest."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out: dict[str, list] = {k: [] for k in names}
            for m in rows_of(batch, "media"):
                p = from_png(m)
                for k, v in zip(names, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(p)), strict=True):
                    out[k].append(v)
            return {"digest": batch.column(0), **out}

        return run

    return map_batches(media, make, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").dropDuplicates(["digest"])


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is the payload of a figure, captioned by its length, between a heading and a second reference to it: the figure's row is the answer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    since = mark()
    described = staged(spark, describe(staged(spark, store(docs), "media")), "media-described")
    release(spark, since, keep=1)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            pages = []
            for t in rows_of(batch, "text"):
                payload, n = payload_of(t)
                src = f"{SCHEME}{hashlib.sha256(payload).hexdigest()}"
                pages.append(f'<h1>Payload</h1><figure><figcaption>{n}</figcaption><img src="{src}"></figure><p>See also <img src="{src}"></p>')
            return {"doc_id": batch.column(0), "page": pages}

        return run

    pages = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, page string")
    items = interleave(pages, "doc_id", "page").filter("kind = 'media' AND caption IS NOT NULL AND position = 1").select("doc_id", "digest", "caption")
    items = staged(spark, items, "media-items")
    return resolve(items, described, "doc_id").select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
