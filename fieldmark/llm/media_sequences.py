"""Interleaved document sequences of text and media.

HTML is parsed into an ordered sequence of text and media-reference structs (position, kind, text, uri,
digest, caption, n_bytes); media payloads live in a store, which may hold a digest more than once
(`document_media` writes the payload of each row); references are resolved by a join on the digest, so payloads
never travel with the sequences, and positions and captions stay with their references.

The stored form of a payload is a binary grey map (PGM, P5): WIDTH 8-bit samples a row.

Defined results: a null or empty page is an empty sequence; a reference whose digest is not in the store
keeps its place with null features; repeated rows are resolved each; the bytes of a null text are empty and
padded to one row of zeros.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.shared import join_counted, stored

WIDTH = 64
SCHEME = "cas:"
ITEM = T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("n_bytes", T.LongType()),
])
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
SKIPPED = {"script", "style", "template", "noscript", "head"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var", "font", "label"}


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.open: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.figures: list[int] = []  # where each open figure's references begin

    def flush(self):
        text = " ".join("".join(self.open).split())
        self.open.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        a = dict(attrs)
        if tag in MEDIA_TAGS and a.get("src"):
            self.flush()
            uri = a["src"]
            digest = uri[len(SCHEME) :] if uri.startswith(SCHEME) else a.get("data-digest")
            size = a.get("data-bytes")
            self.items.append({"kind": "media", "uri": uri, "digest": digest, "caption": a.get("alt") or None, "n_bytes": int(size) if size and size.isdigit() else None})
        elif tag == "figure":
            self.flush()
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag not in INLINE:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            begin = self.figures[-1] if self.figures else 0
            for item in self.items[begin:]:
                if item["kind"] == "media":
                    item["caption"] = text or item["caption"]
        elif tag == "figure":
            self.flush()
            if self.figures:
                self.figures.pop()
        elif tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.open if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The ordered items of a page; positions are gapless from 0."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{f.name: item.get(f.name) for f in ITEM.fields} | {"position": k} for k, item in enumerate(parser.items)]


@F.pandas_udf(T.ArrayType(ITEM))
def sequences(html: pd.Series) -> pd.Series:
    return html.map(sequence)


def payload_of(text: Column) -> Column:
    """The UTF-8 bytes of a text with zeros up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH))
    return F.rpad(raw, (rows * WIDTH).cast("int"), F.lit(b"\0"))


def as_media(payload: Column) -> Column:
    """The payload's stored form."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "UTF-8"), payload)


def samples(media: bytes) -> np.ndarray:
    """The rows of samples of a stored grey map."""
    magic, size, depth, body = media.split(b"\n", 3)
    width, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255":
        raise ValueError("not an 8-bit binary grey map")
    return np.frombuffer(body, np.uint8, rows * width).reshape(rows, width)


def feature(x: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit difference hash of eight bands of rows."""
    bands = np.array_split(x, 8) if len(x) >= 8 else [x] * 8
    cells = np.stack([b.reshape(len(b), 8, -1).mean((0, 2)) for b in bands])
    bits = np.packbits((np.roll(cells, -1, axis=1) > cells).reshape(-1)).tobytes().hex()
    return f"{x.shape[1]}x{x.shape[0]};mean={x.mean():.4f};std={x.std():.4f};dhash={bits}"


FEATURES = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


@F.pandas_udf(FEATURES)
def features(digest: pd.Series, media: pd.Series) -> pd.DataFrame:
    """What the stored bytes say, read back; once for the copies of a payload in a batch."""
    known: dict[str, tuple] = {}
    for d, m in zip(digest, media, strict=True):
        if d not in known:
            x = samples(m)
            p = x.tobytes()
            known[d] = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature(x))
    return pd.DataFrame([known[d] for d in digest], columns=FEATURES.names)


def resolve(references: DataFrame, store: DataFrame) -> DataFrame:
    """references (with a column digest) and the features of their payloads; store has (digest, media), a digest possibly more than once.

    Both sides are counted by digest first; a digest that many references share meets them by broadcast.
    """
    wanted = references.groupBy("digest").agg(F.count("*").alias("n"))
    known = store.select("digest", features("digest", "media").alias("f")).groupBy("digest").agg(F.first("f").alias("f"))
    known = stored(known.join(wanted, "digest").select("digest", "f", "n"), "media-features")
    return join_counted(references, known, "digest", how="left").select(*references.columns, "f.*")


def document_media(documents: DataFrame) -> DataFrame:
    """Every document as a page that names its size, shows its payload and tells the payload's rows: (doc_id, position, before, caption, after, digest, n_bytes) with the payload's features.

    position is the reference's place among the page's items, before and after are the texts around it.  The payloads and the pages are written as one table; the pages are parsed and the payloads read back
    from it, and only digests and features meet in the join.
    """
    payload = documents.select(F.col("doc_id").alias("doc_id"), F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("n"), as_media(payload_of(F.col("text"))).alias("media"))
    named = payload.withColumn("digest", F.sha2("media", 256))
    rows = (F.greatest(F.lit(1), F.ceil(F.col("n") / WIDTH))).cast("string")
    page = F.concat(
        F.lit("<article><h1>text of "), F.col("n").cast("string"), F.lit(' bytes</h1><figure><img src="' + SCHEME), F.col("digest"), F.lit('" data-bytes="'), F.col("n").cast("string"),
        F.lit('"><figcaption>payload '), F.substring("digest", 1, 16), F.lit("</figcaption></figure><p>"), rows, F.lit(" rows of samples</p></article>"),
    )
    kept = stored(named.select("doc_id", "digest", "media", page.alias("html")), "media-store")
    items = kept.select("doc_id", sequences("html").alias("items")).select("doc_id", "items", F.explode("items").alias("i")).filter("i.kind = 'media'")
    around = [F.get("items", F.col("i.position") + k)["text"].alias(side) for k, side in ((-1, "before"), (1, "after"))]
    shown = stored(items.select("doc_id", "i.position", around[0], "i.caption", around[1], "i.digest", "i.n_bytes"), "media-references")
    return resolve(shown, kept.select("digest", "media"))
