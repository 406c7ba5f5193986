"""Media columns: interleaved sequences of text and media, parsed from HTML, with payloads resolved by digest.

A page becomes an ordered array of items: text blocks and references to media, with captions from figcaption or else alt. A
reference names a digest (`sha256:...`), or else an address (`src`). Payloads live in a media table, keyed by digest; a join brings what is known of a
payload to each reference, and the items of a page are gathered again by position, so that positions and captions stay aligned.

Payloads are stored as binary greyscale images (PGM) WIDTH samples wide, one byte a sample: lossless. Properties of a payload
are computed from the stored form, once read back, and only they are joined; the bytes themselves aren't shuffled.

A text becomes a page of all its lines, in sections of SECTION lines. Each section ends with a figure that shows the text's image, with a
caption that says which lines stand above it, so that text and references alternate over the whole page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_slices, columns, iterator_udf, series_slices, stored, unused

WIDTH = 192
#: Lines of a section of a text's page.
SECTION = 8

BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul br body html".split())
#: Elements whose content is no text of the page.
RAW = ("title", "script", "style")
RAW_START = re.compile(r"<(title|script|style)\b[^>]*>", re.IGNORECASE)
MEDIA = frozenset("img video audio source embed".split())

#: Fields of an item besides its position: text of a block; of a reference its caption, address and digest.
FIELDS = ("kind", "text", "caption", "src", "digest")
MEDIA_SCHEMA = "n_bytes long, html string, digest string, media binary"
PROPERTIES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


BLOCK_START = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})\b", re.IGNORECASE)


def closed(page: str) -> str:
    """The page with an end tag for every title, script and style that lacks one: before the next block, or at the end."""
    lower, parts, at, place = page.lower(), [], 0, 0
    last = {tag: lower.rfind("</" + tag) for tag in RAW}
    while start := RAW_START.search(page, place):
        tag = start[1].lower()
        if last[tag] >= start.end():
            place = lower.index("</" + tag, start.end())
            continue
        block = BLOCK_START.search(page, start.end())
        place = block.start() if block else len(page)
        parts += [page[at:place], f"</{tag}>"]
        at = place
    return "".join([*parts, page[at:]])


class Sequence(HTMLParser):
    """Collects items in reading order.

    The content of title, script and style is no text; one without an end tag ends at the next block. That of noscript and template is text of the page.

    A figcaption captions all media of its figure, wherever it stands there. It ends with its own end tag, with the figure, with the page, or with the
    next block once it has text. Outside a figure it is a text block. Of several captions in a figure, the first counts and the others are text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figures: list[dict] = []  # open figures: their media and caption
        self.caption: list[str] | None = None

    def add(self, kind: str, **values) -> dict:
        self.items.append(dict.fromkeys(FIELDS) | {"position": len(self.items), "kind": kind} | values)
        return self.items[-1]

    def end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add("text", text=text)

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if text and self.figures and self.figures[-1]["caption"] is None:
            self.figures[-1]["caption"] = text
        elif text:
            self.add("text", text=text)

    def end_figure(self) -> None:
        figure = self.figures.pop()
        for item in figure["media"]:
            item["caption"] = figure["caption"] or item["caption"]

    def block(self) -> None:
        self.end_block()
        if self.caption is not None and "".join(self.caption).strip():
            self.end_caption()

    def handle_starttag(self, tag, attrs):
        if tag in RAW:
            self.silent += 1
        if tag in BLOCKS:
            self.block()
        if tag == "figure":
            self.figures.append({"media": [], "caption": None})
        elif tag == "figcaption":
            self.end_block()
            self.end_caption()
            self.caption = []
        elif tag in MEDIA:
            values = dict(attrs)
            source = values.get("src") or ""
            if source:
                self.block()
                item = self.add("media", caption=values.get("alt") or None, src=source, digest=source.removeprefix("sha256:") if source.startswith("sha256:") else None)
                if self.figures:
                    self.figures[-1]["media"].append(item)

    def handle_endtag(self, tag):
        if tag in RAW and self.silent:
            self.silent -= 1
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag in BLOCKS:
            self.block()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)

    def close(self):
        super().close()
        self.end_caption()
        self.end_block()
        while self.figures:
            self.end_figure()


def items_of(page: str | None) -> list[dict]:
    """The items of a page, with positions from 0; none if it is null or empty."""
    parser = Sequence()
    parser.feed(closed(page or ""))
    parser.close()
    return parser.items


def sequences(df: DataFrame, html: str = "html", items: str = "items") -> DataFrame:
    """Adds `items`, the interleaved sequence of each page (empty for a null page); a column of that name is replaced."""

    def parsed(batches):
        import pandas as pd

        for pages in series_slices(batches):
            yield pd.Series([items_of(p) for p in pages], dtype=object)

    return df.withColumn(items, iterator_udf(parsed, _items_type())(F.col(html)))


def _items_type():
    from pyspark.sql import types as T

    return T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in FIELDS]]))


def to_pgm(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of WIDTH as a binary greyscale image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(media: bytes) -> bytes:
    kind, size, depth, rest = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not a whole binary greyscale image of one byte a sample")
    return rest


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded with spaces to a positive multiple of WIDTH, and their number before."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % WIDTH if data else WIDTH), len(data)


def page_of(text: str, digest: str, shared: str | None = None) -> str:
    """A page of all lines of a text, in sections that each end with a figure of the text's image; with a shared text, its image stands at the top."""
    lines, parts = text.split("\n"), []
    if shared is not None:
        parts.append(f'<figure><img src="sha256:{digest_of(shared)}"><figcaption>{entities.escape(shared, quote=False)}</figcaption></figure>')
    for at in range(0, len(lines), SECTION):
        own = lines[at : at + SECTION]
        parts += [f"<p>{entities.escape(line, quote=False)}</p>" for line in own]
        parts.append(f'<figure><img src="sha256:{digest}"><figcaption>lines {at + 1} to {at + len(own)} of {len(lines)}</figcaption></figure>')
    return "<body>" + "".join(parts) + "</body>"


def digest_of(text: str | None) -> str:
    return hashlib.sha256(padded(text)[0]).hexdigest()


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", shared: str | None = None) -> DataFrame:
    """(key, n_bytes, html, digest, media) of each row: its payload as a stored image, its digest, and the page of the text, in which the image is shown.

    `shared` is a column of texts whose images many pages may show besides.
    """

    def encoded(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            rows = []
            for t, top in zip(*columns(batch, "text", "shared"), strict=True):
                payload, plain = padded(t)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((plain, page_of(t or "", digest, top), digest, to_pgm(payload)))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["key", *[x.split()[0] for x in MEDIA_SCHEMA.split(", ")]])

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(shared) if shared else F.lit(None)).cast("string").alias("shared"))
    return source.mapInArrow(encoded, f"key {source.schema[0].dataType.simpleString()}, {MEDIA_SCHEMA}")


def feature(samples: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and how many values occur."""
    import numpy as np

    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.flatnonzero(counts)
    mean = float((share * values).sum())
    deviation = float(np.sqrt((share * (values - mean) ** 2).sum()))
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={-float((share * np.log2(share)).sum()):.4f};values={len(values)}"


def properties(media: DataFrame) -> DataFrame:
    """One row for each digest of a media table (digest, media): what its bytes, read back, give."""

    def read(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in PROPERTIES.split(", ")]
        for batch in (part for whole in batches for part in batch_slices(whole, "media")):
            rows, seen = [], set()
            for digest, stored_form in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                image = stored_form.as_py()
                payload = from_pgm(image)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"payload {digest} has changed")
                rows.append((digest, len(payload), found, zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    rest = [x.split()[0] for x in PROPERTIES.split(", ")][1:]
    return media.select("digest", "media").mapInArrow(read, PROPERTIES).groupBy("digest").agg(F.min(F.struct(*rest)).alias("payload"))


def resolve(df: DataFrame, payloads: DataFrame, row: str, items: str = "items") -> DataFrame:
    """`items` with a further field `payload`: what `payloads` (digest, payload) says of the digest; null for text and unknown digests.

    `row` must name each row uniquely. Items stay in order of position; rows without items keep an empty array. A row's references are
    gathered by digest first, so that a digest that is referred to often in one row is joined once for it.
    """
    of_row, found = unused(df, "row", "found")
    digests = F.array_distinct(F.transform(F.filter(items, lambda i: i["digest"].isNotNull()), lambda i: i["digest"]))
    references = df.select(F.col(row).alias(of_row), F.explode(digests).alias("digest"))
    known = references.join(payloads.select("digest", "payload"), "digest").groupBy(of_row).agg(F.map_from_entries(F.collect_list(F.struct("digest", "payload"))).alias(found))
    aligned = F.transform(items, lambda i: i.withField("payload", F.when(i["digest"].isNotNull(), F.try_element_at(found, i["digest"]))))
    return df.join(known, F.col(row) == F.col(of_row), "left").withColumn(items, aligned).drop(of_row, found)


def columns_of_texts(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True, shared: str | None = None) -> DataFrame:
    """Stores every text as media and parses its page, and returns (key, n_bytes, items): the resolved interleaved sequence of each row.

    The values of the column `shared` are stored, too, each once; the page of a row that has one begins with a reference to it, so that many rows refer to
    one digest.

    Null counts as empty; an empty payload is padded to WIDTH spaces. Equal texts share one digest and so all properties. Rows
    with equal or null keys stay apart. Only the two columns named are read. An empty table gives no rows. Pages are parsed as they are made and not
    stored; without keep_text, items have the number of characters of a block, `n_chars`, in the place of its text, which then isn't stored or shuffled.
    """
    made = sequences(encode(df, key, text, shared)).drop("html")
    if not keep_text:
        fields = ("position", "kind", "caption", "digest")
        made = made.withColumn("items", F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in fields], F.length(i["text"]).alias("n_chars"))))
    table = stored(made.withColumn("row", F.monotonically_increasing_id()), "media-table")
    media = table.select("digest", "media")
    if shared:
        own = df.where(F.col(shared).isNotNull()).select(F.col(shared).cast("string").alias("value")).distinct()
        media = media.unionByName(encode(own, "value", "value").select("digest", "media"))
    payloads = stored(properties(media), "media-properties")  # stored, so that the join on digests stands alone in its stage, where Spark can split a frequent digest
    resolved = resolve(table.select("row", "key", "n_bytes", "items"), payloads, "row")
    return resolved.select(F.col("key").alias(key), "n_bytes", "items")
