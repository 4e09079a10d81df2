"""SentencePiece models on the tokenizers library: parse the model file, rebuild it, encode, decode, verify parity."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import extended, slices

#: Fixed values of the model format: the white-space marker, kinds of pieces, kinds of models.
SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Bytes of pre-tokens and ids that a worker remembers, and pre-tokens that are encoded in one string.
REMEMBERED_BYTES, TOGETHER = 16 << 20, 64
#: Bytes of text that are encoded at once: tokens, Python's strings and ids take many times that.
ENCODED_BYTES = 1 << 19


class PieceModel:
    """A parsed SentencePiece model; picklable by its bytes."""

    def __init__(self, raw: bytes):
        self.raw = raw
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self.kind = proto.trainer_spec.model_type
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.charsmap = proto.normalizer_spec.precompiled_charsmap
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.squeeze = proto.normalizer_spec.remove_extra_whitespaces
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be rebuilt")
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("user-defined symbols are not rebuilt")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with a space marker before words are rebuilt")
        if proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("denormalisers are not rebuilt")

    def __reduce__(self):
        return PieceModel, (self.raw,)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model file on the driver; tasks get its bytes."""
        with open(path, "rb") as f:
            return cls(f.read())

    @cached_property
    def cuts(self) -> bool:
        """Whether text may be cut before each run of spaces: no piece has a space after another character."""
        crosses = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")
        return self.kind == BPE and self.dummy_prefix and not self.charsmap and not self.squeeze and not any(crosses.search(p) for p, _, _ in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, best score first; among equal scores the longer left part, as a
        run that grows from the left does."""
        normal = {p for p, _, kind in self.pieces if kind == NORMAL}
        found = [
            (score, i, len(p) - i, p)
            for p, score, kind in self.pieces
            if kind == NORMAL
            for i in range(1, len(p))
            if p[:i] in normal and p[i:] in normal
        ]
        return [(p[:i], p[i:]) for _, i, _, p in sorted(found, key=lambda x: x[:3], reverse=True)]

    @cached_property
    def normalizer(self):
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE_MARK))
        return normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE_MARK)])

    @cached_property
    def core(self) -> Tokenizer:
        """The model alone, for normalised text."""
        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback))
        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        return Tokenizer(models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The whole tokenizer: normaliser, space marker, model and decoder."""
        out = Tokenizer.from_str(self.core.to_str())
        out.normalizer = self.normalizer
        if self.cuts:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE_MARK}+[^{SPACE_MARK}]*"), "isolated")
        steps = [decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else steps)
        return out

    def decode_parts(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each part of a text, which have so many of the ids; it keeps the space that a text begins with, and
        an unknown piece is written as the original library does."""
        spelt, ends = [self.piece_bytes[i] for i in ids.tolist()], np.cumsum(lengths).tolist()
        return [b"".join(spelt[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)]

    @cached_property
    def marker(self) -> int:
        """The id of the lone space marker."""
        return [p for p, _, _ in self.pieces].index(SPACE_MARK)

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.raw)

    def pre_tokens(self, text: str) -> list[str]:
        """The parts that are encoded one by one, in normalised form. Joined they are the whole normalised text."""
        if not text:
            return []
        normal = self.normalizer.normalize_str(text)
        return _RUNS.findall(normal) if self.cuts else [normal]

    def cut_plainly(self, text: str) -> list[str]:
        """The same as pre_tokens; where a model has cuts, its normaliser only puts the marker, which is quicker done here."""
        return _RUNS.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text and self.cuts else self.pre_tokens(text)

    @cached_property
    def piece_bytes(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        out = []
        for p, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(SPACE_MARK, " ").encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join([self.piece_bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_RUNS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*")


class Encoder:
    """Encodes texts by their distinct pre-tokens and remembers those that it has met, as arrays of bounded size."""

    def __init__(self, model: PieceModel, verify: bool = True):
        self.model, self.verify = model, verify
        #: whether pre-tokens can be compared with the original library one by one; otherwise whole texts are
        self.by_pre_token = bool(model.cuts and model.byte_fallback)
        #: UTF-8 bytes that each id covers in normalised text; a byte piece covers one
        self.covers = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in model.pieces], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.tokens = self.decoded = pa.array([], pa.large_string())
        self.begin, self.length, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.bank = np.zeros(0, np.int32)

    def _fresh(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, how many each has, and whether the original library gives the same.

        Pre-tokens are encoded in strings of many, as nothing joins across their borders; which ids belong to which
        is read off the bytes that ids cover. That needs byte fallback: an unknown piece covers any number of bytes.
        """
        texts = tokens.to_pylist()
        if not self.by_pre_token:  # compared text by text in encode()
            each = [e.ids for e in self.model.core.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.array([len(x) for x in each], dtype=np.int64)
            return np.array([i for x in each for i in x], dtype=np.int32), lengths, np.ones(len(texts), bool)
        joined = _together(texts)
        ids = _flat(e.ids for part in few(joined) for e in self.model.core.encode_batch_fast(part, add_special_tokens=False))
        lengths = self._lengths(ids, tokens)
        if not self.verify:
            return ids, lengths, np.ones(len(texts), bool)
        theirs = _flat(x for part in few(joined) for x in self._theirs(part))
        same = np.ones(len(texts), bool)
        if len(theirs) != len(ids) or (theirs != ids).any():
            own, other = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(self._lengths(theirs, tokens))])
            same = np.array([np.array_equal(ids[a:b], theirs[c:d]) for a, b, c, d in zip(own[:-1], own[1:], other[:-1], other[1:], strict=True)])
        return ids, lengths, same

    def _theirs(self, joined: list[str]) -> list[list[int]]:
        raw = [x[1:].replace(SPACE_MARK, " ") for x in joined]  # the library puts the first space itself, but not before nothing
        return [x if r else [self.model.marker] for r, x in zip(raw, self.model.library.encode(raw, num_threads=1), strict=True)]

    def _lengths(self, ids: np.ndarray, tokens: pa.Array) -> np.ndarray:
        ends = np.cumsum(pc.binary_length(tokens).to_numpy().astype(np.int64))
        return np.diff(np.searchsorted(np.cumsum(self.covers[ids]), ends) + 1, prepend=0)

    def look_up(self, tokens: pa.Array) -> np.ndarray:
        """Where each pre-token stands in the remembered arrays."""
        at = pc.index_in(tokens, self.tokens)
        new = tokens.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            ids, lengths, same = self._fresh(new)
            at[at < 0] = len(self.tokens) + np.arange(len(new))
            self.tokens = pa.concat_arrays([self.tokens, new])
            self.decoded = pa.concat_arrays([self.decoded, pa.array(self.model.decode_parts(ids, lengths), pa.large_string())])
            self.begin = np.concatenate([self.begin, len(self.bank) + np.cumsum(lengths) - lengths])
            self.length, self.same = np.concatenate([self.length, lengths]), np.concatenate([self.same, same])
            self.bank = np.concatenate([self.bank, ids])
        return at

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """All ids one after another, offsets of each text's first, each text's parity, and what its ids decode to."""
        if self.tokens.nbytes + self.decoded.nbytes + self.bank.nbytes + 17 * len(self.tokens) > REMEMBERED_BYTES:
            self._forget()
        parts = [self.model.pre_tokens(t or "") for t in texts]
        flat = pa.array([t for p in parts for t in p], pa.large_string()).dictionary_encode()
        ends = np.cumsum([0, *map(len, parts)])
        at = self.look_up(flat.dictionary)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        lengths, begins = self.length[at], self.begin[at]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.bank[np.repeat(begins - sums[:-1], lengths) + np.arange(sums[-1])]
        bad = np.concatenate([[0], np.cumsum(~self.same[at])])
        parity = np.diff(bad[ends]) == 0
        if self.verify and not self.by_pre_token:
            theirs = self.model.library.encode([t or "" for t in texts])
            parity = np.array([np.array_equal(ids[a:b], x) for a, b, x in zip(sums[ends[:-1]], sums[ends[1:]], theirs, strict=True)], dtype=bool)
        lists = pa.LargeListArray.from_arrays(pa.array(ends), self.decoded.take(pa.array(at)))
        decoded = pc.binary_join(lists, pa.scalar("", pa.large_string()))
        return ids, sums[ends], parity, pc.replace_substring_regex(decoded, "^ ", "") if self.model.dummy_prefix else decoded


def _together(tokens: list[str]) -> list[str]:
    """Pre-tokens in strings of up to TOGETHER; one that is spaces to its end is the last, as more spaces would join it."""
    out: list[str] = []
    current: list[str] = []
    for t in tokens:
        current.append(t)
        if len(current) == TOGETHER or t.endswith(SPACE_MARK):
            out.append("".join(current))
            current = []
    return [*out, "".join(current)] if current else out


def one_thread() -> None:
    """Tasks share the cores already; each thread of the tokenizers library would keep memory of its own in every worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def few(strings: list[str]) -> Iterator[list[str]]:
    """Strings in lists of TOGETHER: what a library returns for a string takes many times its size."""
    return (strings[i : i + TOGETHER] for i in range(0, len(strings), TOGETHER))


def _flat(lists: Iterable[list[int]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in lists)])


def encode(docs: DataFrame, model: PieceModel, verify: bool = True) -> DataFrame:
    """``docs`` with ids, n_tokens, decoded_sha256, round_trip and parity.

    ids are the whole text's, without special tokens; a null or empty text has none. decoded_sha256 (lowercase hex,
    UTF-8) is of the text that the ids decode to, round_trip says that it is the input (the marker character itself
    decodes as a space), parity that the original library gives the same ids: for each of the text's pre-tokens, or for
    the whole text where the model has no safe cuts or no byte fallback; it is null without ``verify``, as nothing is
    compared. Rows are encoded alone: nothing is shuffled, copies, repeated rows and ties get equal results, a long text
    is encoded whole by one task; an empty table gives no rows; columns named like the result's are replaced.
    """
    docs = docs.drop("ids", "n_tokens", "decoded_sha256", "round_trip", "parity")
    out = extended(docs.schema, "ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean, parity boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model.raw)  # the model file

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        encoder = Encoder(PieceModel(shared.value), verify)
        for whole in batches:
            for b in slices(whole, "text", ENCODED_BYTES):
                ids, ends, parity, decoded = encoder.encode(b.column("text").to_pylist())
                trips = pc.equal(decoded, pc.fill_null(b.column("text"), "").cast(pa.large_string()))
                arrays = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded.cast(pa.large_binary()).to_pylist()], pa.string()),
                    trips,
                    pa.array(parity, pa.bool_()) if verify else pa.nulls(b.num_rows, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns, *arrays], out.names)

    return docs.mapInArrow(encoded, out)
