"""Token ids of whole texts by way of their distinct words, for vocabularies that drop white space.

Arrow splits a batch of texts at ASCII white space, and the distinct words into
letters and marks; only distinct parts meet Python. A worker remembers the ids of words from task to
task and lets go of the rarely used ones when it holds too many.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from claimloom.llm.memo import Remembered, laid_out
from claimloom.llm.token_files import byte_alphabet
from claimloom.llm.worker import held


# letters whose lower case and composed form are plain, then marks that make one token with their like
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?]*)$"
_ONE_TOKEN = re.compile(r"[a-zß-öø-ÿ]+|[.,;:!?]+")


class WordEncoder:
    """The ids that the tokenizer at ``path`` gives to whole texts, without special tokens added.

    Its tokens never reach across white space and its normalizer joins nothing
    across it, so the ids of a text are those of its words in a row. A word of
    plain letters and marks has the ids of both parts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.parts = Remembered(self._learn)

    def _learn(self, parts: list[str]) -> tuple[list[int], list[int]]:
        model, alphabet, one = self.tokenizer.model, self.alphabet, _ONE_TOKEN.fullmatch
        ids: list[int] = []
        sizes: list[int] = []
        for part in parts:
            before = len(ids)
            if one(part):
                ids += [t.id for t in model.tokenize(part.encode("utf-8").decode("latin-1").translate(alphabet))]
            elif part:
                ids += self.tokenizer.encode(part, add_special_tokens=False).ids
            sizes.append(len(ids) - before)
        return ids, sizes

    def _codes(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        places = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return self.parts.known(distinct, np.bincount(places, minlength=len(distinct)))[places]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; a missing text has none."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        edges = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        split = pc.extract_regex(coded.dictionary, _PLAIN)
        first = pc.coalesce(pc.utf8_lower(pc.struct_field(split, 0)), coded.dictionary)
        marks = pc.fill_null(pc.struct_field(split, 1), "")
        self.parts.make_room()
        codes = np.stack([self._codes(first), self._codes(marks)], axis=1).ravel()
        word_ids, word_edges = laid_out(self.parts.starts, self.parts.ids, codes)
        ids, total = laid_out(word_edges[::2], word_ids, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, np.diff(total[edges - edges[0]])


def word_encoder(path: str) -> WordEncoder:
    return held("words", path, lambda: WordEncoder(path))
