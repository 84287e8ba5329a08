"""A unigram vocabulary with scores, read from a public tokenizer file."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import sentencepiece
from pyspark import cloudpickle

PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space in pieces.
MARK = "▁"
#: What an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
#: Lower scores in a file are placeholders; such pieces get the worst real score.
PLACEHOLDER = -1e8


@dataclass(frozen=True)
class Vocabulary:
    """Text pieces with scores, and the score of a character that no piece covers."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]

    @classmethod
    def read(cls, path: str = PIECE_FILE) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [
            i for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        scores = [sp.get_score(i) for i in ids]
        worst = min((s for s in scores if s > PLACEHOLDER), default=0.0)
        return cls(tuple(sp.id_to_piece(i) for i in ids), tuple(max(s, worst) for s in scores))

    @cached_property
    def unknown(self) -> float:
        return min(self.scores, default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def automaton(self):
        """Aho-Corasick automaton whose values are the places of the pieces."""
        found = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            found.add_word(piece, i)
        found.make_automaton()
        return found


cloudpickle.register_pickle_by_value(sys.modules[__name__])
