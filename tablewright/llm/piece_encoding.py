"""Encoding with a SentencePiece model that keeps, for every token, its bytes in the source text.

1. A text is normalised by the longest matching prefix of the model's compiled character map;
   every character of the result remembers the source byte it comes from (for a model without a
   map both are the same but for the space put in front).
2. The result is cut where no piece crosses: before spaces that follow other characters, and
   around characters that are in no longer piece. What lies between is merged on its own, so a
   task merges each distinct word once and remembers tokens and their lengths in bytes.
3. Token lengths add up to places in the normalised text, and these are projected to the source.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .piece_model import PieceModel

REMEMBERED = 300_000  #: words kept; beyond, those not met since are forgotten at the next time
WORD_CHARACTERS = 64  #: longer ones are merged each time

_encoders: dict[str, "Encoder"] = {}


def _encoder(data: bytes) -> Encoder:
    """One per model and worker process, so that later tasks know the words of earlier ones."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(PieceModel(data))
    return _encoders[key]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Encoder:
    """Tokens of whole texts; remembers words as (ids, sizes of tokens, text when decoded).

    Sizes are bytes of the source for a model without a character map, else characters of the
    normalised text.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.bare = model.plain and bool(model.bytes)  # characters stay as they are, and no token is joined with the next
        self.known: dict[str, tuple[str, bytes, str]] = {}
        self.older: dict[str, tuple[str, bytes, str]] = {}

    def _part(self, whole: str, raw: str) -> tuple[str, bytes, str]:
        """A word that pieces may fill, merged; its characters are whole, so it decodes alone."""
        model = self.model
        parts = model.merged_parts(whole)
        names = [model.names.get(p) for p in parts]
        if None not in names and raw.isascii():  # all are pieces, a byte for each character
            return ",".join(names), array("H", map(len, parts)).tobytes(), raw
        tokens, sizes, at = model.tokens(parts), [], 0
        for _, n in tokens:
            sizes.append(len(raw[at: at + n].encode()) if self.bare else n)
            at += n
        text = b"".join([model.piece_text(t) for t, _ in tokens]).decode()
        return ",".join([str(t) for t, _ in tokens]), array("H", sizes).tobytes(), raw if text == raw else text

    def _word(self, word: str) -> tuple[str, bytes, str]:
        entry = self.older.get(word)
        if entry is None:
            whole, inner = word.replace(" ", self.model.space), self.model.inner
            cuts = [i + 1 for i, pair in enumerate(map(add, whole, whole[1:])) if pair not in inner]
            if not cuts:
                entry = self._part(whole, word)
            else:
                own = []
                for a, b in zip([0, *cuts], [*cuts, len(whole)]):
                    raw = word[a:b]
                    own.append(self.known.get(raw) or self.older.get(raw) or self._keep(raw, self._part(whole[a:b], raw)))
                entry = ",".join([e[0] for e in own]), b"".join([e[1] for e in own]), "".join([e[2] for e in own])
                entry = entry[0], entry[1], word if entry[2] == word else entry[2]
        return self._keep(word, entry)

    def _keep(self, word: str, entry: tuple[str, bytes, str]) -> tuple[str, bytes, str]:
        if len(word) <= WORD_CHARACTERS:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[word] = entry
        return entry

    def _entries(self, text: str) -> list[tuple[str, bytes, str]]:
        known, own = self.known.get, self._word
        return [known(w) or own(w) for w in self.model.words.findall(text)]

    def encoded(self, text: str) -> tuple[str, int, str, np.ndarray]:
        """Ids, comma-joined; their number; the text they decode to; source bytes where tokens begin and, last, where they end."""
        if not text:
            return "", 0, "", np.zeros(1, np.int64)
        model = self.model
        if self.bare:
            entries = self._entries(" " + text if model.add_space else text)
            sizes = np.frombuffer(b"".join([e[1] for e in entries]), np.uint16)
            bounds = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=bounds[1:])
            bounds[1:] -= model.add_space  # the space put in front takes no bytes
            return ",".join([e[0] for e in entries]), len(sizes), "".join([e[2] for e in entries])[model.add_space:], bounds
        normalised, source = model.normalised(text)
        entries = self._entries(normalised)
        tokens = model.joined_unknowns([(int(t), n) for e in entries for t, n in zip(e[0].split(","), np.frombuffer(e[1], np.uint16).tolist())])
        bounds = np.array(source)[np.cumsum([0, *(n for _, n in tokens)])]
        return ",".join([str(t) for t, _ in tokens]), len(tokens), model.decoded([t for t, _ in tokens]), bounds


def encode(docs: DataFrame, model: bytes, *, text: str = "text", tokens: bool = True) -> DataFrame:
    """All columns plus n_tokens, ids_sha256, decoded_sha256, n_bytes, stops_sha256 and, with `tokens`, ids and stops.

    Texts are encoded whole, without begin and end ids. Tokens follow each other in the source: each begins
    at the stop of the one before, the first at 0 (after leading spaces, if the model drops them), and
    ends before its own, in UTF-8 bytes; the digest is of decimal stops joined by commas. Of a
    character that is no piece, the last byte token has all bytes and the others none; the space put in
    front takes none. A null text counts as empty; an empty one has no tokens and decodes to nothing. Repeated
    rows stay. Columns named like an output are replaced. No rows in, no rows out.
    """
    digests = ["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "stops_sha256"]
    kept = [c for c in docs.columns if c.lower() not in (*digests, "ids", "stops")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary file
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", own.schema["row"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("stops_sha256", T.StringType()),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("stops", T.ArrayType(T.LongType()))] if tokens else [])])
    arrow = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()),
                       ("stops_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("stops", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                value = value.as_py() or ""
                ids, n, decoded, bounds = encoder.encoded(value)
                stops = bounds[1:].tolist()
                row = {"n_tokens": n, "ids_sha256": _digest(ids), "decoded_sha256": _digest(decoded), "n_bytes": len(value.encode()),
                       "stops_sha256": _digest(",".join(map(str, stops)))}
                if tokens:
                    row |= {"ids": [int(t) for t in ids.split(",")] if n else [], "stops": stops}
                rows.append(row)
            found = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(found.column(c) for c in schema.names[1:])], schema.names)

    return own.mapInArrow(run, schema).select("row.*", *schema.names[1:])


def decode(tokens: DataFrame, model: bytes, *, ids: str = "ids") -> DataFrame:
    """All columns plus decoded: the text of a column of ids; null ids give null, no ids the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(column):
        own = _encoder(shared.value).model
        return column.map(lambda x: None if x is None else own.decoded([int(i) for i in x]))

    return tokens.withColumn("decoded", text(F.col(f"`{ids}`")))
