"""Token counts by a Viterbi pass that carries scores and counts only.

The vocabulary is a list of pieces with scores. An Aho-Corasick automaton lists
all pieces that end at each place of a word; the dynamic program keeps, for each
place, the best score of a segmentation that ends there and its number of
pieces. No segmentation is built. Ties go as in the tokenizer that walks over
starts from left to right and replaces a place's best only by a better one: the
longest piece stays. A character that is no piece gets the least score less ten
and counts as its bytes where the vocabulary has byte pieces, or else runs of
such characters count as one.

Words begin at blanks, each blank is part of the word after it and one is put
before the text (the Metaspace rule), so a text's count is the sum over its
words, and counts of words that occur again come from a bounded cache.
"""

from __future__ import annotations

import re
import sys
import types

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words in a worker's cache.
CACHE = 600_000
_PLAIN = r"A-Za-z0-9ß-ɏ"
#: A stop or comma before a blank that does not follow a plain letter or digit.
_ODD_MARK = re.compile(rf"[.,](?<![{_PLAIN}][.,]) ")


def piece_scores(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, by id; the first is the unknown piece."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.scores = {p: s for p, s in reversed(pieces)}  # of equal pieces the first counts
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for p, s in self.scores.items():
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        joined = "".join(f"{p}\0" for p in self.scores)
        #: No piece joins a plain character and a mark, or a line end and anything: such places always part.
        self.marks_part = not re.search(rf"[{_PLAIN}][.,]", joined)
        self.lines_part = "\n" not in joined

    def count(self, text: str) -> int:
        """Pieces of the best segmentation of one word (or of any text, as it stands)."""
        n = len(text)
        best: list[float] = [0.0] + [float("-inf")] * n
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)
        single = bytearray(n + 1)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text):
            at[end + 1].append(found)
            if found[0] == 1:
                single[end + 1] = 1
        for end in range(1, n + 1):
            top, count, odd = float("-inf"), 0, False
            for length, score in sorted(at[end], reverse=True):
                s = best[end - length] + score
                if s > top:
                    top, count, odd = s, pieces[end - length] + 1, False
            if not single[end]:
                s = best[end - 1] + self.unknown
                if s > top:
                    more = len(text[end - 1].encode()) if self.bytes else 0 if unknown[end - 1] else 1
                    top, count, odd = s, pieces[end - 1] + more, True
            best[end], pieces[end], unknown[end] = top, count, odd
        return pieces[n]


def counter(model_path: str):
    """A function from texts to token counts. The vocabulary and the counts of words stay with the worker process."""
    kept = sys.modules.setdefault("lagoon_llm_unigram", types.ModuleType("lagoon_llm_unigram")).__dict__
    if model_path not in kept:
        kept[model_path] = (Unigram(piece_scores(model_path)), {})
    model, cache = kept[model_path]

    def words_of(text: str) -> tuple[list[str], int, int]:
        """(words without their leading blank, stops, commas) of a text; a word that begins with a line end has no blank."""
        text = text.replace(SPACE, " ")
        text = text[1:] if text.startswith(" ") else text
        stops = commas = 0
        if model.lines_part:
            text = text.replace("\n", " \n")
        if model.marks_part:
            text += " "
            if not _ODD_MARK.search(text):
                stops, commas = text.count(". "), text.count(", ")
                text = text.replace(". ", " ").replace(", ", " ")
            text = text[:-1]
        return text.split(" "), stops, commas

    def one(word: str) -> int:
        return model.count(word if model.lines_part and word.startswith("\n") else SPACE + word)

    def counts(texts: list[str]) -> list[int]:
        if len(cache) > CACHE:
            cache.clear()
        parts = [words_of(t) if t else ([], 0, 0) for t in texts]
        for w in set().union(*(p[0] for p in parts)).difference(cache):
            cache[w] = one(w)
        dot, comma = model.count("."), model.count(",")
        return [sum(map(cache.__getitem__, words)) + stops * dot + commas * comma for words, stops, commas in parts]

    return counts


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row. Null and empty texts have no tokens. model_path names a file that every executor has."""

    def run(batches):
        import pyarrow as pa

        counts = counter(model_path)
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts([t or "" for t in part.column("t").to_pylist()]), pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")
