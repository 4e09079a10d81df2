"""Language by compression: the language whose dictionary helps zstandard most."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import extended, slices, written

#: Bytes of a language's dictionary, and of the pieces of text that it is made of.
DICT_BYTES = 32 << 10
PIECE = 512
#: Languages that can be told apart: each costs every text a compression, and every worker a dictionary.
LANGUAGES = 256
#: A text is compressed in blocks, so that its own beginning doesn't stand in for the dictionary.
BLOCK = 4 << 10
LEVEL = 6
#: Share of bytes by which the best language must beat the next.
MARGIN = 0.01

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def held_out(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """``docs`` with held_out: crc32 of doc_id as text leaves ``part`` when divided by ``parts``."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.withColumn("held_out", key % parts == part)


def learn(docs: DataFrame, dict_bytes: int = DICT_BYTES, piece: int = PIECE) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``docs`` (text, lang).

    All whole texts are cut into pieces of ``piece`` bytes, letters only. A dictionary is a sample of its language's
    different pieces, those with the smallest hashes, as many as ``dict_bytes`` holds; so every part of every text is as
    likely to be in it, and a much copied text counts once. Tasks keep that many for each language before they meet.
    A text shorter than a piece is one; rows without text, letters or lang are left out; an empty table gives none.
    Over LANGUAGES different values of lang are an error.
    """
    most = max(1, dict_bytes // piece)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, bytes]] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                for t, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                    letters = plain(t.as_py()).strip()
                    own = held.setdefault(lang, {})
                    for i in range(0, len(letters), piece):
                        part = letters[i : i + piece]
                        own[xxhash.xxh3_64_intdigest(part) >> 1] = part
                for lang, own in held.items():
                    if len(own) > most:
                        held[lang] = {h: own[h] for h in heapq.nsmallest(most, own)}
        rows = [(lang, h, part) for lang, own in held.items() for h, part in own.items()]
        types = (pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], ["lang", "h", "part"])

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    few = known.mapInArrow(pieces, "lang string, h long, part binary").groupBy("lang", "h").agg(F.min("part").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = written(few.withColumn("place", place).filter(F.col("place") <= most), "pieces")
    if chosen.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    parts: dict[str, list[bytes]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.h)):  # dict_bytes for each language
        parts.setdefault(r.lang, []).append(bytes(r.part))
    return {lang: b" ".join(p) for lang, p in sorted(parts.items()) if any(p)}


def plain(text: str) -> bytes:
    """Lower-case letters only, with one space for whatever stands between them."""
    return _OTHER.sub(" ", text.lower()).encode()


def sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and sure.

    lang_pred has the smallest compressed size over the whole text, ties by code point of the name; ``und`` if the
    text is null or has no letter, or nothing was learned. score is the share of bytes saved against the next
    language, scaled to 0..1 (1 if only one was learned); sure is false where that share is under ``margin``, the
    rejection: a caller who wants no narrow guesses keeps sure rows only. Only the text is looked at, as a whole,
    however long it is; equal texts get equal results, and a text without letters is ``und`` like a null one. Rows are
    named alone and nothing is shuffled. An empty table gives no rows; columns named like the result's are replaced.
    """
    docs = docs.drop("lang_pred", "score", "sure")
    out = extended(docs.schema, "lang_pred string, score double, sure boolean")
    names = sorted(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast([dictionaries[n] for n in names])  # DICT_BYTES for each language

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = []
        for d in shared.value:
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
            )
        for whole in batches:
            for b in slices(whole, "text"):
                lang, score, sure = [], [], []
                for t in b.column("text"):
                    t = t.as_py()
                    if not t or not names or not _LETTER.search(t):
                        lang.append("und")
                        score.append(0.0)
                        sure.append(False)
                        continue
                    got = sizes(plain(t), compressors)
                    best = int(np.argmin(got))
                    next_best = min([s for i, s in enumerate(got) if i != best], default=None)
                    gain = 1.0 if next_best is None else 1 - got[best] / next_best
                    lang.append(names[best])
                    score.append(min(1.0, max(0.0, gain)))
                    sure.append(gain >= margin)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())],
                    [*b.schema.names, "lang_pred", "score", "sure"],
                )

    return docs.mapInArrow(named, out)
