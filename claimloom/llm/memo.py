"""Equal stretches of text, worked out once and laid out again for every text that holds them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np

MOST_PIECES = 600_000  # pieces whose ids a worker remembers

class Codes(dict):
    """stretch -> number, given out as stretches turn up; ``new`` collects those."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        code = self[stretch] = len(self)
        self.new.append(stretch)
        return code


def laid_out(starts: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all codes in a row, and the running number of values before each code and after the last."""
    lengths = starts[codes + 1] - starts[codes]
    total = np.cumsum(lengths)
    places = np.arange(total[-1] if total.size else 0) + np.repeat(starts[codes] - (total - lengths), lengths)
    return values[places], np.concatenate((np.zeros(1, dtype=np.int64), total))


class Remembered:
    """Ids of pieces of text by ``learn``; beyond ``most`` pieces the less used half goes."""

    def __init__(self, learn: Callable[[list[str]], tuple[list[int], list[int]]], most: int = MOST_PIECES) -> None:
        self.learn, self.most = learn, most
        self.codes: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.uses = np.zeros(0, dtype=np.int64)

    def known(self, pieces: Sequence[str], uses: np.ndarray) -> np.ndarray:
        """The code of each of some distinct pieces, which turn up ``uses`` times."""
        found = np.fromiter(map(self.codes.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        unknown = np.flatnonzero(found < 0)
        if unknown.size:
            new = [pieces[k] for k in unknown.tolist()]
            found[unknown] = np.arange(len(self.codes), len(self.codes) + len(new))
            ids, sizes = self.learn(new)
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.array(sizes, dtype=np.int64))))
            self.ids = np.concatenate((self.ids, np.array(ids, dtype=np.uint32)))
            self.uses = np.concatenate((self.uses, np.zeros(len(new), dtype=np.int64)))
        self.uses[found] += uses
        return found

    def make_room(self) -> None:
        """Codes given out before are void after this."""
        if len(self.codes) <= self.most:
            return
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        names = list(self.codes)
        self.ids, edges = laid_out(self.starts, self.ids, stay)
        self.starts, self.uses = edges, self.uses[stay] // 2
        self.codes = {names[k]: n for n, k in enumerate(stay.tolist())}


class Memo:
    """Ids and score of stretches by ``learn``, remembered up to ``most`` of them."""

    def __init__(self, learn: Callable[[str], tuple[list[int], float]], most: int) -> None:
        self.learn, self.most = learn, most
        self.forget()

    def forget(self) -> None:
        self.codes = Codes()
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.scores = np.zeros(0)

    def encode(self, texts: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts given as stretches: all ids in a row, their edges per text, and the score of each text."""
        if len(self.codes) > self.most:
            self.forget()
        flat = [stretch for text in texts for stretch in text]
        codes = np.fromiter(map(self.codes.__getitem__, flat), dtype=np.int64, count=len(flat))
        if self.codes.new:
            new, self.codes.new = self.codes.new, []
            made = [self.learn(stretch) for stretch in new]
            sizes = np.fromiter((len(ids) for ids, _ in made), dtype=np.int64, count=len(made))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, np.array([i for ids, _ in made for i in ids], dtype=np.int32)))
            self.scores = np.concatenate((self.scores, np.array([score for _, score in made])))
        ids, total = laid_out(self.starts, self.ids, codes)
        cuts = np.cumsum([0, *map(len, texts)])
        owner = np.repeat(np.arange(len(texts)), np.diff(cuts))
        return ids, total[cuts], np.bincount(owner, weights=self.scores[codes], minlength=len(texts))
