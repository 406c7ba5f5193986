"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model holds one piece for each vocabulary entry, its bytes mapped to printable characters one to
one, with the negative rank as its score, so that the highest score merges first, which is the lowest
rank. Normalisation is the identity: no prefix, no whitespace changes. Text is first cut by a pattern;
each match is encoded separately. The serialised model is about 1 MB, whatever the corpus, and is
broadcast.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import iterator_udf, series_slices

#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """A printable, non-space character for each byte: itself where Latin-1 prints it, else one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}
    return [chr(shifted.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    vocabulary = [b""] * len(pairs)
    for piece, rank in pairs:
        vocabulary[int(rank)] = base64.b64decode(piece)
    return vocabulary


def serialised_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece that every model must have comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    characters = byte_characters()
    model = pb.ModelProto()
    for rank, piece in enumerate(vocabulary):
        model.pieces.add(piece="".join(characters[b] for b in piece), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(vocabulary) + 1
    model.trainer_spec.unk_id = len(vocabulary)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


def unicode_spaces(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out as Unicode's White_Space, which the regex module widens by four control characters."""
    spaces = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    # inside [^...] the class members stand without brackets
    return pattern.replace(r"[^\s", "[^" + spaces).replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")


class Encoder:
    """Packed ids of texts; remembers pre-tokens."""

    def __init__(self, model: bytes, vocabulary: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(unicode_spaces(pattern)).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.characters = byte_characters()
        self.whole = {piece: rank.to_bytes(4, "little") for rank, piece in enumerate(vocabulary)}
        self.known: dict[str, bytes] = {}

    def piece(self, token: str) -> bytes:
        data = token.encode()
        ids = self.whole.get(data)
        if ids is None:
            mapped = "".join([self.characters[b] for b in data])
            ids = b"".join([i.to_bytes(4, "little") for i in self.processor.encode(mapped)])
        return ids

    def encode(self, text: str) -> bytes:
        tokens = self.split(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for token in set(tokens):
            if token not in known:
                known[token] = self.piece(token)
        return b"".join([known[token] for token in tokens])


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`: the token ids of the whole text, packed as little-endian unsigned 32-bit integers.

    No special tokens. Null and empty texts get no ids (empty binary). All other columns are kept,
    but a column that is already called `ids` is replaced. Equal texts get equal ids; texts of any length
    are encoded whole.
    """
    vocabulary = read_ranks(vocabulary_path)
    sent = df.sparkSession.sparkContext.broadcast((serialised_model(vocabulary), vocabulary))

    def packed(batches):
        import pandas as pd

        model, pieces = sent.value
        encoder = Encoder(model, pieces, pattern)
        for texts in series_slices(batches):
            yield pd.Series([encoder.encode(t) if t else b"" for t in texts], dtype=object)

    return df.withColumn(ids, iterator_udf(packed, T.BinaryType())(F.col(text)))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded`: the bytes that the packed ids stand for, by inverse mapping. Null ids give empty bytes; an id outside the vocabulary raises."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))

    def joined(batches):
        import numpy as np
        import pandas as pd

        pieces = sent.value
        for packed in series_slices(batches):
            yield pd.Series([b"".join([pieces[i] for i in np.frombuffer(p, "<u4").tolist()]) if p else b"" for p in packed], dtype=object)

    return df.withColumn(decoded, iterator_udf(joined, T.BinaryType())(F.col(ids)))
