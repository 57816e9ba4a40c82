"""SentencePiece encoding and decoding through a distinct-chunk table.

In a piece vocabulary where no piece holds a whitespace marker after another
character, merges cannot cross the start of a marked word.  A text is then a
sequence of independent chunks (a run of markers and the characters up to the
next marker), and the ids of the text are the ids of its chunks in order.
Each task keeps a table of the distinct chunks it has met, segments a new
chunk once with the sentencepiece library, and joins the ids back to the texts
by position.  The table is bounded (``MAX_CHUNKS``; it is started anew when
full, which costs time only).  A vocabulary that does not have the property
is encoded text by text.

A global chunk table joined back with a shuffle gives the same ids but moves
every word occurrence; the per-task table moves nothing.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
MAX_CHUNKS = 400_000
# texts handled at a time inside a task
SLICE_CHARS = 2_000_000


class ChunkEncoder:
    """Exact encoder of one piece model; built once per task."""

    def __init__(self, model_path: str, add_end: bool = True, max_chunks: int = MAX_CHUNKS):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.separable = (not any(MARK in p.lstrip(MARK) for p in pieces)
                          and self.sp.encode("a  b", out_type=str) and self._keeps_whitespace())
        self.end = [self.sp.eos_id()] if add_end else []
        self.add_end = add_end
        self.mark_id = self.sp.piece_to_id(MARK)
        self.max_chunks = max_chunks
        self.table: dict[str, bytes] = {}      # chunk -> its ids as packed C ints
        self.decimals = [str(i) for i in range(self.sp.get_piece_size())]

    def _keeps_whitespace(self) -> bool:
        """The normaliser only marks spaces and adds one leading marker."""
        probe = "  a\u2581 \ufb01  b\t\n "
        return "".join(self.sp.encode(probe, out_type=str)).startswith(MARK * 3) and self.sp.decode(
            self.sp.encode(probe)) == probe.replace(MARK, " ")

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def _fill(self, split: list[list[str]]) -> None:
        """Segment the chunks that are new to the table, each once."""
        new = set(chain.from_iterable(split)) - self.table.keys()
        if len(self.table) + len(new) > self.max_chunks:
            self.table.clear()
            new = set(chain.from_iterable(split))
        new = list(new)
        # the library adds the first marker itself; a lone marker has no text
        for c, ids in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1)):
            self.table[c] = array("i", ids if len(c) > 1 else [self.mark_id]).tobytes()

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.separable:
            return [self.sp.encode(t) + self.end for t in texts]
        split = [self.chunks(t) for t in texts]
        self._fill(split)
        packed = self.table.__getitem__
        return [array("i", b"".join(map(packed, cs))).tolist() + self.end for cs in split]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 add_end: bool = True) -> DataFrame:
    """(id, ids array<int>) of every text; null counts as empty, whose ids are
    the end id alone.  Repeated rows give repeated rows; other columns are
    ignored."""
    schema = df.select(F.col(id_col)).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches):
        enc = ChunkEncoder(model_path, add_end)
        for b in batches:
            texts = [t or "" for t in b[text_col]]
            for i, j in _slices(texts):
                yield pd.DataFrame({id_col: b[id_col].iloc[i:j].array, "ids": enc.encode(texts[i:j])})

    return df.select(id_col, text_col).mapInPandas(run, f"{schema}, ids array<int>")


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every id list, by the library's own decode."""
    schema = df.select(F.col(id_col)).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches):
        enc = ChunkEncoder(model_path)
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col].array, "text": [
                enc.decode([int(x) for x in ids]) if ids is not None else "" for ids in b[ids_col]]})

    return df.select(id_col, ids_col).mapInPandas(run, f"{schema}, text string")


def round_trip_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                       add_end: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, lossless): encode and decode
    in one pass, so the id lists never leave the task."""
    schema = df.select(F.col(id_col)).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches):
        enc = ChunkEncoder(model_path, add_end)
        for b in batches:
            texts = [t or "" for t in b[text_col]]
            for i, j in _slices(texts):
                rows = []
                for t, ids in zip(texts[i:j], enc.encode(texts[i:j])):
                    back = enc.decode(ids)
                    decimal = " ".join(map(enc.decimals.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(),
                                 hashlib.sha256(back.encode("utf-8")).hexdigest(), back == t))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "lossless"])
                out.insert(0, id_col, b[id_col].iloc[i:j].array)
                yield out

    return df.select(id_col, text_col).mapInPandas(
        run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
