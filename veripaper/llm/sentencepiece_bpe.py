"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking.

A sequence of pieces is the model's encoding exactly when each two neighbours, merged anew from their
characters, come apart again as these two. So the longest piece at a position (found by an Aho-Corasick
automaton) is tried first; if it is not compatible with the piece before it, a shorter one is, and if none
is left the position is marked as failed and the search takes one step back. A bit field of failed
positions keeps the search linear.

Pieces never hold white space behind other characters, so a text is encoded chunk by chunk, a chunk being
white space with the letters or the other characters behind it; a worker remembers the chunks it has seen.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

#: How the model writes a space.
SPACE = "▁"
#: Chunks and pairs of pieces that a Python worker remembers.
REMEMBERED = 400_000

_MODELS: dict[str, "Model"] = {}


class Model:
    """Vocabulary of a model file, with the searches that encoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        plain = [i for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.pieces = {i: library.id_to_piece(i) for i in plain}
        self.ids = {piece: i for i, piece in self.pieces.items()}
        self.score = {piece: library.get_score(i) for i, piece in self.pieces.items()}
        self.bytes = {int(library.id_to_piece(i)[3:-1], 16): i for i in ids if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.chars = frozenset(piece for piece in self.pieces.values() if len(piece) == 1)
        # Chunks are encoded apart, which is exact only where no piece crosses from a word into white space.
        joined = {(piece[i], piece[i + 1]) for piece in self.pieces.values() for i in range(len(piece) - 1)}
        if any(right == SPACE != left for left, right in joined):
            raise ValueError("pieces of this model hold white space behind other characters")
        # Where no piece joins a letter to another kind of character either, marks and digits are chunks apart.
        letters = re.escape("".join(sorted(c for c in self.chars if c.isalpha())))
        mixed = any(SPACE not in pair and pair[0].isalpha() != pair[1].isalpha() for pair in joined)
        words = f"{SPACE}*[^{SPACE}]+" if mixed else f"{SPACE}*(?:[{letters}]+|[^{SPACE}{letters}]+)"
        self.split = re.compile(f"{words}|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces.values():
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """``text`` merged from its characters: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when their text is merged anew."""
        pair = (left, right)
        found = self.compatible.get(pair)
        if found is None:
            if len(self.compatible) > REMEMBERED:
                self.compatible.clear()
            found = self.compatible[pair] = self.merged(left + right) == [left, right]
        return found

    def matches(self, text: str) -> list[list[str]]:
        """For every position the pieces that start there, the longest first."""
        found: list[list[str]] = [[] for _ in text]
        for last, piece in self.automaton.iter(text):
            found[last - len(piece) + 1].append(piece)
        return [pieces[::-1] for pieces in found]

    def longest(self, text: str) -> list[str] | None:
        """The longest piece at each place in turn, where all neighbours are compatible; else None."""
        pieces = [piece for _, piece in self.automaton.iter_long(text)]
        if sum(map(len, pieces)) != len(text):
            return None
        for i in range(len(pieces) - 1):
            if not self.fits(pieces[i], pieces[i + 1]):
                return None
        return pieces

    def searched(self, text: str) -> list[str] | None:
        """Pieces of ``text`` by backtracking; None if no sequence of compatible pieces covers it.

        A search that never has to step back is what ``longest`` finds at once.
        """
        if (found := self.longest(text)) is not None:
            return found
        choices = self.matches(text)
        failed = bytearray(len(text) // 8 + 1)
        chosen: list[str] = []
        tried = [0]
        at = 0
        while at < len(text):
            left = chosen[-1] if chosen else None
            for k in range(tried[-1], len(choices[at])):
                piece = choices[at][k]
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1 and (left is None or self.fits(left, piece)):
                    tried[-1] = k + 1
                    chosen.append(piece)
                    tried.append(0)
                    at = to
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                tried.pop()
                if not chosen:
                    return None
                at -= len(chosen.pop())
        return chosen

    def encoded(self, text: str) -> list[int]:
        """Ids of a chunk with its spaces already written as the model writes them.

        Characters outside the vocabulary are never merged: they part the text and become their bytes.
        """
        if self.chars.issuperset(text):
            pieces = self.searched(text)
            return [self.ids[p] for p in (pieces if pieces is not None else self.merged(text))]
        ids: list[int] = []
        begin = 0
        for at in [*(i for i, c in enumerate(text) if c not in self.ids), len(text)]:
            if at > begin:
                pieces = self.searched(text[begin:at])
                ids += [self.ids[p] for p in (pieces if pieces is not None else self.merged(text[begin:at]))]
            if at < len(text):
                ids += [self.bytes.get(b, self.unknown) for b in text[at].encode()] if self.bytes else [self.unknown]
            begin = at + 1
        return ids

    def chunk(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits) and decoded text of a chunk, remembered."""
        found = self.known.get(text)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            ids = self.encoded(text)
            found = self.known[text] = (struct.pack(f"<{len(ids)}I", *ids), self.decoded(ids))
        return found

    def decoded(self, ids: list[int]) -> str:
        """Text of the ids, with all spaces; control ids are nothing."""
        if self.pieces.keys() >= set(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            out.append(self.pieces[i] if i in self.pieces else " ⁇ " if i == self.unknown else "")
        out.append(pending.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text with begin and end, and their decoded text.

        The model puts a space in front of every text that is not empty; decoding takes it away again.
        """
        written = (SPACE + text.replace(" ", SPACE)) if text else ""
        chunk, known = self.chunk, self.known
        parts = [known.get(c) or chunk(c) for c in self.split.findall(written)]
        edges = [np.array([i], "<u4").tobytes() for i in (self.begin, self.end)]
        return edges[0] + b"".join([p[0] for p in parts]) + edges[1], "".join([p[1] for p in parts])[1:]


def sentencepiece_encoded(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, ids, decoded``; or, without ids, their SHA-256.

    ``path`` is the model file, at the same place on every machine. Null is encoded like the empty text, as
    begin and end; repeated rows and null identifiers are rows like all others; other columns are ignored.
    Without ``with_ids`` the columns are ``ids_sha256`` and ``decoded_sha256`` (ids as little-endian unsigned
    32-bit integers, text as UTF-8), and no ids leave the task. An empty table gives no rows; a very long text
    is encoded whole, chunk by chunk.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["doc_id"]]).add("n_tokens", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType())).add("decoded", "string")
    else:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _MODELS:
            _MODELS[path] = Model(path)
        model = _MODELS[path]
        for batch, _, _ in small_batches(batches, "text"):
            found = [model.encode(text or "") for text in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([len(ids) // 4 for ids, _ in found], pa.int64())]
            if with_ids:
                columns.append(pa.array([np.frombuffer(ids, "<u4").astype(np.int64) for ids, _ in found], pa.list_(pa.int64())))
                columns.append(pa.array([text for _, text in found], pa.string()))
            else:
                columns.append(pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()))
                columns.append(pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return slim.mapInArrow(work, schema)
