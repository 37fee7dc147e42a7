"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton holds all pieces of a given model. One pass over a text yields, at
each position, the pieces that end there (its output links); each relaxes the
best score of that position. Characters without a piece become byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm.memo import Memo

SPACE = "▁"  # stands for a blank
UNKNOWN_PENALTY = 10.0
MEMO = 300_000  # stretches of text whose pieces a task remembers
AT_ONCE = 128  # texts encoded together
_UNKNOWN = (1, -1, 0.0)  # one character without a piece


class PieceModel:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.singles: set[str] = set()
        lowest, inside = 0.0, False
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
                continue
            self.bytes_of.append(piece.replace(SPACE, " ").encode())
            score = float(model.get_score(i))
            self.automaton.add_word(piece, (len(piece), i, score))
            lowest = min(lowest, score)
            inside = inside or SPACE in piece.lstrip(SPACE)
            if len(piece) == 1:
                self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        # no piece goes on from other characters into a blank, so texts can be cut there
        self.cuts = not inside

    def best(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation; among equals the longer last piece wins."""
        n = len(text)
        score, back = [-np.inf] * (n + 1), [_UNKNOWN] * (n + 1)
        score[0] = 0.0
        strange = [k for k, c in enumerate(text) if c not in self.singles] if not self.singles.issuperset(text) else []
        at = 0
        for end, found in self.automaton.iter(text):
            while at < len(strange) and strange[at] < end:
                self._unknown_step(strange[at], score, back)
                at += 1
            value = score[end + 1 - found[0]] + found[2]
            if value > score[end + 1]:
                score[end + 1], back[end + 1] = value, found
            if at < len(strange) and strange[at] == end:
                self._unknown_step(end, score, back)
        for k in strange[at:]:
            self._unknown_step(k, score, back)
        ids: list[int] = []
        place = n
        while place > 0:
            length, ident, _ = back[place]
            if ident >= 0:
                ids.append(ident)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[place - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown_id)
            place -= length
        return ids[::-1], score[n]

    def _unknown_step(self, k: int, score: list[float], back: list[tuple[int, int, float]]) -> None:
        if score[k] + self.unknown > score[k + 1]:
            score[k + 1], back[k + 1] = score[k] + self.unknown, _UNKNOWN

    def stretches(self, text: str | None) -> list[str]:
        """The text cut before every blank that follows another character; each stretch lacks its first blank.

        The text's leading blank is the first of them. A missing or empty text
        has no stretch.
        """
        if not text:
            return []
        plain = text.replace(SPACE, " ")
        if not self.cuts:
            return [plain]
        parts = plain.split(" ")
        if "" not in parts:
            return parts
        out: list[str] = []
        blanks = ""
        for part in parts:
            if part:
                out.append(blanks + part)
                blanks = ""
            else:
                blanks += " "
        if blanks:
            out.append(blanks[:-1])
        return out

    def best_stretch(self, stretch: str) -> tuple[list[int], float]:
        return self.best(SPACE + stretch.replace(" ", SPACE))

    def encode(self, text: str | None) -> tuple[list[int], float]:
        """Ids and score of one text; a missing or empty text has no ids."""
        made = [self.best_stretch(stretch) for stretch in self.stretches(text)]
        return [i for ids, _ in made for i in ids], sum((score for _, score in made), 0.0)

    def decode(self, ids: list[int]) -> str:
        """Pieces in a row without the leading blank; broken byte pieces become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


def encoded(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, score, restored) of every row of ``docs``, over whole texts.

    ``restored`` says that decoding gives back the text; it is false where a
    text holds U+2581, which stands for a blank. A missing text counts as empty,
    has no ids and is restored as empty. Repeated rows are encoded alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_file)
        memo = Memo(model.best_stretch, MEMO)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = part.column(1).to_pylist()
                ids, edges, scores = memo.encode([model.stretches(t) for t in texts])
                flat, cuts = ids.tolist(), edges.tolist()
                same = [model.decode(flat[a:b]) == (t or "") for t, a, b in zip(texts, cuts, cuts[1:])]
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(scores, pa.float64()), pa.array(same, pa.bool_())],
                    [doc_id, "ids", "score", "restored"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>, score double, restored boolean")
