"""Quality rules: base counts of a text and zstandard compression bands.

The whole text and its chunks of CHUNK bytes are compressed; where the length isn't a multiple of CHUNK, the last chunk is the
text's last CHUNK bytes and overlaps the one before, so that every byte is judged at the same length. The ratio of compressed to plain bytes must lie
in a band that depends on the plain length, since short texts compress less; a text that compresses too
well repeats itself, one that hardly compresses is noise. A chunk fails if it leaves the band of its
own length, and a text fails if over BAD_CHUNKS of its chunks do.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_slices, columns

CHUNK = 4096
LEVEL = 3
BAD_CHUNKS = 0.2
#: From so many bytes on: least and most ratio of compressed to plain bytes. Under 64 bytes the frame outweighs the text, so anything goes.
BANDS = ((0, 0.0, 9.0), (64, 0.35, 1.25), (256, 0.35, 1.0), (512, 0.33, 0.85), (1024, 0.30, 0.78), (4096, 0.25, 0.72), (16384, 0.22, 0.70))
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def repeated_words(words: list) -> int:
    """How many words stand in a 5-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    covered, total = 0, 0  # covered: first word after the windows so far
    for at, w in enumerate(windows):
        if w in again:
            total += at + 5 - max(covered, at)
            covered = at + 5
    return total


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes.split() cuts at the six ASCII spaces only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def in_band(plain: int, packed: int, bands=BANDS) -> bool:
    _, least, most = bands[bisect_right(bands, plain, key=lambda b: b[0]) - 1]
    return least * plain <= packed <= most * plain


def compression(text: bytes, pack) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of chunks and of bad ones, and whether all is within limits. A text of at most CHUNK bytes has no chunks besides itself."""
    if not text:
        return 0.0, 0, 0, False
    packed = len(pack(text))
    chunks = [text[(at := min(k, len(text) - CHUNK)) : at + CHUNK] for k in range(0, len(text), CHUNK)] if len(text) > CHUNK else []
    bad = sum(not in_band(len(c), len(pack(c))) for c in chunks)
    return packed / len(text), len(chunks), bad, in_band(len(text), packed) and bad <= BAD_CHUNKS * len(chunks)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: the key, the base counts, the compression figures and the verdict.

    Null counts as empty. An empty text has no words, fails the base rule and isn't kept. Equal texts get equal verdicts, whole
    texts are read, and only the two columns named are used, so others can't clash.
    """

    def judged(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in (part for whole in batches for part in batch_slices(whole, "text")):
            keys, texts = batch.column(0), columns(batch, "text")[0]
            rows = []
            for t in texts:
                t = t or ""
                base = base_counts(t)
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                ratio, n, bad, good = compression(t.encode(), pack)
                rows.append((*base, failed, ratio, n, bad, good and not failed))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], [key, *names])

    source = df.select(F.col(key), F.col(text).alias("text"))
    return source.mapInArrow(judged, f"`{key}` {source.schema[0].dataType.simpleString()}, {SCHEMA}")
