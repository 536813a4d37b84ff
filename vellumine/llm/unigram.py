"""Token counts of unigram tokenizers by a Viterbi pass that carries only a score and a piece count.

Aho-Corasick finds each vocabulary piece that ends at a character; the best way to reach that character
is the best of the ways to the pieces' starts, and of equal scores the earliest start wins, as in the
public library. A character that no single-character piece covers is unknown, at the least score of the
vocabulary less ten; with byte fallback it counts its UTF-8 bytes, otherwise a run of unknown characters
counts once.

Where no piece holds a space mark after another character, and all scores are whole numbers (so that
sums are exact in any order), the best way splits at each word start: words are then counted apart,
equal ones of an Arrow batch once, and kept in a bounded memo. Otherwise the pass runs over the whole text.

Nulls and empty texts count no tokens. Repeated rows give equal rows; extra columns do not pass through
unless named; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.store import Shared, slices

MEMO_WORDS = 100_000
#: Rows and bytes of an Arrow batch that are counted together: the more, the more words are equal.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
UNKNOWN_PENALTY = 10.0
MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that may match text with their scores; the least score of all pieces, special ones included."""

    pieces: tuple[tuple[str, float], ...]
    least: float
    byte_fallback: bool


def load_sentencepiece(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(tuple((model.id_to_piece(i), model.get_score(i)) for i in plain), min(model.get_score(i) for i in ids), any(model.is_byte(i) for i in ids))


class Counter:
    """Counts pieces, unknown characters among them, and the best score."""

    def __init__(self, vocabulary: Vocabulary):
        self.fallback = vocabulary.byte_fallback
        self.unknown = vocabulary.least - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        whole = all(float(score).is_integer() for _, score in vocabulary.pieces) and float(vocabulary.least).is_integer()
        self.splits = whole and not any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary.pieces)
        # What words give, by their bytes with spaces for marks: a young table, and the one before it.
        self.young: dict[bytes, tuple[int, int, float]] = {}
        self.old: dict[bytes, tuple[int, int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, int, float]:
        """Pieces, unknown characters, score."""
        n = len(text)
        score, count, strange = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        open_run = bytearray(n + 1)
        matches: list[list | None] = [None] * (n + 1)
        for end, found in self.automaton.iter(text):
            if matches[end + 1] is None:
                matches[end + 1] = [found]
            else:
                matches[end + 1].append(found)
        for end in range(1, n + 1):
            best, start, length = None, 0, 0
            # Longest first, as the automaton's links lead from a match to its ends.
            for length, value in matches[end] or ():
                reached = score[end - length] + value
                if best is None or reached > best:
                    best, start = reached, end - length
            matches[end] = None
            if length != 1 and (best is None or score[end - 1] + self.unknown > best):
                score[end], start = score[end - 1] + self.unknown, end - 1
                counted = len(text[start].encode("utf-8", "surrogatepass")) if self.fallback else 1 - open_run[start]
                count[end], strange[end], open_run[end] = count[start] + counted, strange[start] + 1, 1
            else:
                score[end], count[end], strange[end] = best, count[start] + 1, strange[start]
        return count[n], strange[n], score[n]

    def _word(self, word: bytes) -> tuple[int, int, float]:
        known = self.old.get(word)
        if known is None:
            known = self.viterbi(word.decode("utf-8").replace(" ", MARK))
        if len(word) <= 64:
            self.young[word] = known
        return known

    def count_all(self, texts: pa.Array, prefix: bool = True) -> list[np.ndarray]:
        """Pieces, unknown characters and scores of whole texts; none of nulls and empty ones."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        filled = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        out = [np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))]
        if not len(filled):
            return out
        texts = texts.take(pa.array(filled))
        if prefix:
            texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        if not self.splits:
            for i, text in zip(filled.tolist(), texts, strict=True):
                out[0][i], out[1][i], out[2][i] = self.viterbi(text.as_py().replace(" ", MARK))
            return out
        # Words begin where marks follow something else, and where texts do.
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        mark = data == 32
        first = np.concatenate(([True], mark[1:] & ~mark[:-1]))
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        known = self.young.get
        counted = [known(word) or self._word(word) for word in words.dictionary.to_pylist()]
        if len(self.young) >= MEMO_WORDS:
            self.old, self.young = self.young, {}
        codes, places = words.indices.to_numpy(), np.searchsorted(starts, offsets[:-1])
        for column, values in zip(out, zip(*counted, strict=True), strict=True):
            column[filled] = np.add.reduceat(np.array(values)[codes], places)
        return out


_made: dict = {}


def counts(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", prefix: bool = True) -> DataFrame:
    """Per document: id, ``n_tokens``, ``n_unknown`` (characters) and ``best_score`` of its whole text.

    Spaces become marks, one mark goes in front (``prefix``); nothing else is normalised.
    """
    shared = Shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _made:
            _made.clear()
            _made[shared.id] = Counter(shared.value)
        counter = _made[shared.id]
        for part in (part for batch in batches for part in slices(batch, SLICE_ROWS, SLICE_BYTES)):
            tokens, unknown, score = counter.count_all(part.column(1), prefix)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.array(unknown), pa.array(score)], ["id", "n_tokens", "n_unknown", "best_score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, n_unknown long, best_score double").withColumnRenamed("id", id_col)
