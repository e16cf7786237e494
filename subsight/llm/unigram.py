"""Unigram pieces: Aho-Corasick and Viterbi. Token counts (operator 2), and SentencePiece
encoding and decoding (operator 9).

An Aho-Corasick automaton over the vocabulary's pieces reads a text once; at each position its
output links give the pieces that end there, longest first, and each relaxes the best score of
that position (strictly better wins, so of equal scores the longest last piece, the tie rule of
the tokenizer libraries). A character that no single piece covers may be unknown, at the lowest
score less 10; a run of unknown characters is written as its UTF-8 byte pieces.

The texts are cut where no piece can reach across: before a space mark that follows another
character, and around line feeds. This is checked against the vocabulary when it is loaded
(a vocabulary that has such pieces gets whole texts instead). The best path passes through every
such place, so equal stretches are solved once and remembered. Scores are summed in double
precision; those of the given vocabulary are whole numbers, so the sums are exact.

The vocabulary file is a SentencePiece model; its pieces and scores are read as a unigram
vocabulary. Its path is a parameter and must exist on every machine.

Cases: a null or empty text has no pieces; a very long stretch without spaces takes time and
memory in proportion to its length; ties follow the rule above; repeated rows are rows of their
own; an empty table gives an empty result; other columns are not read by the queries, and
``encode`` and ``decode`` refuse a table that already has a column of the name they add.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 500_000  # remembered stretches per Python worker and kind
LONGEST = 64  # longer stretches are not remembered
ROWS = 500  # texts that are Python objects at a time


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A unigram vocabulary with its automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        plain = [i for i in range(len(self.names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown_score = min(sp.get_score(i) for i in plain) - UNKNOWN_PENALTY
        self.unknown_id = sp.unk_id()
        self.singles = {self.names[i] for i in plain if len(self.names[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.names[i], (len(self.names[i]), float(sp.get_score(i)), i))
        self.automaton.make_automaton()
        crosses = any(b == SPACE != a for i in plain for a, b in zip(self.names[i], self.names[i][1:]))
        isolated = not any("\n" in self.names[i] for i in plain)
        if crosses:
            self._cut = lambda text: [text]
        else:
            pattern = f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if isolated else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
            self._cut = re.compile(pattern).findall
        # what each id decodes to
        self.plain_bytes = [b"" if sp.is_control(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        for value, i in self.bytes.items():
            self.plain_bytes[i] = bytes([value])
        self.counts = _Memory(self.count_stretch)
        self.ids = _Memory(self.encode_stretch)

    def cut(self, text: str) -> list[str]:
        """The stretches of a text, with the space mark written and put in front."""
        return self._cut(SPACE + text.replace(" ", SPACE)) if text else []

    def best(self, s: str) -> tuple[list[int], list[int], list[int]]:
        """For each end position of ``s``: the start and id (-1: unknown) of the last piece of the
        best path, and the number of pieces on it (a run of unknown characters: of its bytes)."""
        n = len(s)
        score, start, last, count = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        singles, unknown = self.singles, self.unknown_score
        found = self.automaton.iter(s)
        at, piece = next(found, (n, None))
        for end in range(n):
            top, where, which = None, 0, -1
            while at == end:
                length, gain, i = piece
                new = score[end + 1 - length] + gain
                if top is None or new > top:
                    top, where, which = new, end + 1 - length, i
                at, piece = next(found, (n, None))
            if s[end] not in singles:
                new = score[end] + unknown
                if top is None or new > top:
                    top, where, which = new, end, -1
            score[end + 1], start[end + 1], last[end + 1] = top, where, which
            count[end + 1] = count[where] + (1 if which >= 0 else self._unknown_count(s, end, last[end]))
        return start, last, count

    def _unknown_count(self, s: str, end: int, before: int) -> int:
        if self.bytes:
            return len(s[end].encode("utf-8", "surrogatepass"))
        return int(end == 0 or before >= 0)  # without byte pieces a run is one unknown piece

    def count_stretch(self, s: str) -> int:
        """Count only: no path is kept."""
        return self.best(s)[2][-1]

    def encode_stretch(self, s: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        start, last, _ = self.best(s)
        out: list[int] = []
        end = len(s)
        while end:
            if last[end] >= 0:
                out.append(last[end])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(s[start[end]:end].encode("utf-8", "surrogatepass")))
            elif not out or out[-1] != self.unknown_id or end == len(s) or last[end + 1] >= 0:
                out.append(self.unknown_id)
            end = start[end]
        return np.array(out[::-1], "<u4").tobytes()

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.cut(text or "")))

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.cut(text or "")))

    def decode(self, ids) -> str:
        text = b"".join(map(self.plain_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Memory(dict):
    """Results by stretch; long stretches are not kept, and a full memory starts anew."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, s: str):
        value = self.solve(s)
        if len(s) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[s] = value
        return value


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document."""

    def run(batches):
        p = load(path)
        for b in batches:
            counts = [p.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select("doc_id", text)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema)


def _slices(batches):
    """Arrow batches in slices of few rows, so that only few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _id_lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "piece_ids") -> DataFrame:
    """The rows of ``docs`` with the pieces of their text, an array of ids."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into}")

    def run(batches):
        p = load(path)
        for b in _slices(batches):
            coded = [p.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, _id_lists(coded)], [*b.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for."""
    if into in rows.columns:
        raise ValueError(f"the table already has a column {into}")

    def run(batches):
        p = load(path)
        for b in _slices(batches):
            lists = b.column(b.schema.get_field_index(ids))
            texts = [p.decode(x.values.to_pylist() if x.is_valid else ()) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_pieces, piece_ids and round_trip (the decoded pieces are the
    text again, the space mark itself read as a space; a null text is empty)."""
    new = ["n_pieces", "piece_ids", "round_trip"]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"the table already has columns {sorted(clash)}")

    def run(batches):
        p = load(path)
        for b in _slices(batches):
            coded, same = [], []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                coded.append(p.encode(t))
                same.append(p.decode(np.frombuffer(coded[-1], "<u4").tolist()) == (t or "").replace(SPACE, " "))
            counts = pa.array([len(c) // 4 for c in coded], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, counts, _id_lists(coded), pa.array(same, pa.bool_())], [*b.schema.names, *new])

    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds))]))


def coded_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_pieces, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), decoded_chars and round_trip (the decoded text is the text, with
    the space mark itself read as a space)."""

    def run(batches):
        p = load(path)
        for b in batches:
            n, crc, chars, same = [], [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                coded = p.encode(t)
                back = p.decode(np.frombuffer(coded, "<u4").tolist())
                n.append(len(coded) // 4)
                crc.append(zlib.crc32(coded))
                chars.append(len(back))
                same.append(back == t.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(chars, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_pieces", "ids_crc32", "decoded_chars", "round_trip"])

    rows = docs.select("doc_id", "text")
    kinds = [("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("decoded_chars", T.LongType()), ("round_trip", T.BooleanType())]
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(*k) for k in kinds)])
    return rows.mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return token_counts(read(spark, sf_dir, "documents"), default_model())


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return coded_digest(read(spark, sf_dir, "documents"), default_model())
