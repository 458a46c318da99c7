"""SentencePiece encoding and decoding by vectorised merge rounds.

The distinct words of a task are merged together: flat symbol arrays, the least pair rank of each word, all leftmost places
at once, until no pair remains. Byte-pair merges never cross a word here, as no piece has a space after another character.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay.llm.bpe import Merges, merge_rounds
from rowassay.llm.common import Words, list_array, map_texts, ragged, slices, sums_by_run, text_array, vocabulary

_SPACE = "▁"


class Pieces:
    """Pieces, byte pieces and merges of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.control = [model.is_control(i) for i in ids]
        self.unknown = [model.is_unknown(i) for i in ids]
        self.byte = [model.is_byte(i) for i in ids]
        normal = {self.pieces[i]: i for i in ids if not (self.control[i] or self.unknown[i] or self.byte[i] or model.is_unused(i))}
        if sum(self.byte) != 256 or any(model.is_unused(i) for i in ids):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        if any(_SPACE in p.lstrip(_SPACE) for p in normal) or any(c not in normal for p in normal for c in p):
            raise ValueError("a piece crosses a word or has a character that is no piece")
        if model.normalize("  ﬁ A ") != _SPACE * 3 + "ﬁ" + _SPACE + "A" + _SPACE:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        self.byte_id = np.array([next(i for i in ids if self.byte[i] and self.pieces[i] == f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.size = len(self.pieces)
        self.of_char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)  # unknown characters keep their own number
        for piece, i in normal.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        scores = np.array([model.get_score(i) for i in ids], np.float32)
        ranks = np.unique(-scores, return_inverse=True)[1]
        parts = [(normal[p[:k]], normal[p[k:]], i, ranks[i]) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        self.merges = Merges(*zip(*parts))

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with one more mark before it: the space that ended the word before, or the dummy prefix."""
        codes = np.frombuffer((_SPACE + _SPACE.join(words)).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        symbols, sizes = merge_rounds(self.of_char[codes], lengths, self.merges)
        unknown = np.flatnonzero(symbols >= self.size)
        if not len(unknown):
            return symbols, sizes
        spelled = [self.byte_id[list(chr(c).encode())] for c in symbols[unknown] - self.size]
        long = np.ones(len(symbols), np.int64)
        long[unknown] = [len(x) for x in spelled]
        out = np.repeat(symbols, long)
        out[np.repeat(symbols >= self.size, long)] = np.concatenate(spelled)
        return out, sums_by_run(long, sizes)


_RUNS = re.compile("^ +| {2,}")


def _marked(text: str) -> str:
    """The text with further spaces of a run, and all at its start, as marks: a word is then what one space ends."""
    text = text.replace(_SPACE, " ")
    if "  " in text or text.startswith(" "):
        return _RUNS.sub(lambda m: _SPACE * len(m[0]) if m.start() == 0 else " " + _SPACE * (len(m[0]) - 1), text)
    return text


class Encoder:
    """Ids of whole texts, through the distinct words of a task."""

    def __init__(self, pieces: Pieces):
        self.words = Words(pieces.solve)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        split = pc.split_pattern(pa.array([_marked(t) or None for t in texts.to_pylist()], pa.string()), " ")
        flat, lengths = self.words.numbers(split.flatten())
        return flat, sums_by_run(lengths, pc.fill_null(pc.list_value_length(split), 0).to_numpy())


class Decoder:
    def __init__(self, pieces: Pieces):
        self.control, self.byte = np.array(pieces.control), np.array(pieces.byte)
        self.marked = np.array([p.startswith(_SPACE) for p in pieces.pieces])
        self.spell = [b"" if pieces.control[i] else " ⁇ ".encode() if pieces.unknown[i] else bytes([int(p[1:-1], 16)]) if pieces.byte[i] else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces.pieces)]
        self.table = np.frombuffer(b"".join(self.spell), np.uint8)
        self.sizes = np.array([len(s) for s in self.spell])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each list of ids; the lists lie one after another."""
        long = self.sizes[ids]
        raw = ragged(self.table, self.starts[ids], long).tobytes()
        texts, at, start = [], 0, 0
        for n, size in zip(lengths.tolist(), sums_by_run(long, lengths).tolist()):
            own, part = ids[at : at + n], raw[start : start + size]
            at, start = at + n, start + size
            try:
                text = part.decode()
            except UnicodeDecodeError:
                text = self._by_run(own)
            if n and self.control[own[0]]:
                own = own[~self.control[own]]
            texts.append(text[1:] if len(own) and self.marked[own[0]] else text)
        return texts

    def _by_run(self, ids: np.ndarray) -> str:
        """As the library reads bytes that are no UTF-8: each wrong byte of a run of byte pieces on its own."""
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.byte[i]:
                run += self.spell[i]
                continue
            while run:
                try:
                    out.append(run.decode())
                    run = b""
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "\ufffd")
                    run = run[e.start + 1 :]
            if i is not None:
                out.append(self.spell[i].decode())
        return "".join(out)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Piece ids of every whole text, as the sentencepiece library gives them without begin and end ids.

    Returns ``id_col`` and ``piece_ids`` (array of int), one row per input row. Null and empty texts have no ids; repeated
    rows and ids are kept; other columns are not read. The model must be BPE with byte fallback and identity normalisation.
    """
    path = model or vocabulary("piece_bpe_32k.model")

    def begin():
        encoder = Encoder(Pieces(path))
        return lambda texts: [list_array(*encoder(texts))]

    return map_texts(df, [id_col], text_col, "piece_ids array<int>", begin)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "piece_ids", model: str | None = None) -> DataFrame:
    """The text of every list of piece ids, as the library's ``decode`` gives it.

    Returns ``id_col`` and ``decoded``. A null or empty list decodes to the empty text. Marks become spaces, the dummy
    prefix goes, runs of byte pieces are read as UTF-8 (each wrong byte as U+FFFD) and unknown ids as " ⁇ ".
    """
    path = model or vocabulary("piece_bpe_32k.model")
    kept = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))

    def run(batches):
        decoder = Decoder(Pieces(path))
        for batch in batches:
            lists = batch.column(1)
            for a, b in slices(pc.list_value_length(lists).to_pylist(), 1 << 20):
                part = lists.slice(a, b - a)
                texts = decoder(part.flatten().to_numpy(), pc.list_value_length(part).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), text_array(texts)], names=[id_col, "decoded"])

    return kept.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Piece ids of every whole text and what they decode to, in one pass: ``id_col``, piece_ids, decoded."""
    path = model or vocabulary("piece_bpe_32k.model")

    def begin():
        pieces = Pieces(path)
        encoder, decoder = Encoder(pieces), Decoder(pieces)

        def work(texts):
            ids, lengths = encoder(texts)
            return [list_array(ids, lengths), text_array(decoder(ids, lengths))]

        return work

    return map_texts(df, [id_col], text_col, "piece_ids array<int>, decoded string", begin)
