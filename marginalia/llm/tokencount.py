"""Token counts by a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists the pieces that end at each place; dynamic programming
carries the best score and its number of pieces. Scores are single-precision numbers
that add up in double precision from the text's start, as in the library (0.2.3), and
of equal scores the path whose last piece starts first stays. While sums are exact,
chunks that no piece reaches over count alike wherever they stand, and a worker counts
each once; where sums could get too large for that, the rest of a text is run through
in one go.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import spmodel
from marginalia.llm.packing import text_runs

#: Chunks that a worker keeps; what an unknown character scores below the least piece.
KEPT_CHUNKS, UNKNOWN_PENALTY = 700_000, 10.0


class Counter:
    def __init__(self, data: bytes):
        import ahocorasick

        self.model = spmodel.parse(data)
        if self.model.model_type != spmodel.UNIGRAM:
            raise ValueError("not a unigram vocabulary")
        normal = [p for p in self.model.pieces if p.kind == spmodel.NORMAL]
        self.found = ahocorasick.Automaton()
        for p in normal:
            self.found.add_word(p.text, (len(p.text), p.score))
        self.found.make_automaton()
        self.single = {p.text for p in normal if len(p.text) == 1}
        self.unknown = float(np.float32(min(p.score for p in normal) - UNKNOWN_PENALTY))
        self.tile = self.model.chunks().findall
        steps = next((s for s in range(50) if all((p.score * 2**s).is_integer() for p in normal)), 53)
        #: Sums below it in size are exact.
        self.exact = 2.0 ** (53 - steps)
        self.known: dict[str, tuple[int, float]] = {}

    def run(self, text: str, score: float) -> tuple[int, float]:
        """Pieces of the best path through ``text`` and its score, on from ``score``."""
        best, count = [score], [0]
        ends = iter(self.found.iter(text))
        end, piece = next(ends, (-1, None))
        for at, char in enumerate(text):
            top, pieces = None, 0
            while end == at:
                size, value = piece
                new = best[at + 1 - size] + value
                if top is None or new > top:
                    top, pieces = new, count[at + 1 - size] + 1
                end, piece = next(ends, (-1, None))
            if char not in self.single:
                new = best[at] + self.unknown
                if top is None or new > top:
                    top, pieces = new, count[at] + len(char.encode())
            best.append(top)
            count.append(pieces)
        return count[-1], best[-1]

    def count(self, text: str) -> int:
        total, score, known = 0, 0.0, self.known
        chunks = self.tile(self.model.normalise(text))
        for i, c in enumerate(chunks):
            got = known.get(c)
            if got is None:
                got = known[c] = self.run(c, 0.0)
            if -(score + got[1]) - self.unknown * len(c) >= self.exact:
                return total + self.run("".join(chunks[i:]), score)[0]
            total, score = total + got[0], score + got[1]
        return total

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT_CHUNKS:
            self.known.clear()
        return [self.count(t) for t in texts]


@functools.lru_cache(2)
def _counter(path: str, convert: bool) -> Counter:
    data = spmodel.read(path)
    return Counter(spmodel.as_unigram(data) if convert else data)


def count_tokens(docs: DataFrame, path: str, convert: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: how many ids the unigram model of the file gives each whole text (null: 0).

    ``convert``: read the vocabulary of another kind of file as a unigram model (see
    spmodel.as_unigram). Repeated rows are counted each; an empty table stays empty; ids may have any type.
    """
    kind = docs.schema[id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, convert)
        for keys, texts in text_runs(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(counter.counts(texts.to_pylist()), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id), F.col(text)).mapInArrow(work, f"doc_id {kind}, n_tokens long")
