"""A public byte-level BPE vocabulary, read from files that the environment offers."""

from __future__ import annotations

import base64

import regex

#: Where the vocabulary's ranks are, on every executor; a parameter of all that use it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Characters encoded at once; the encoder's stack and memory grow with a single piece.
STEP = 200_000

_PIECES = regex.compile(PATTERN)
_OPEN: dict[str, object] = {}


class Vocabulary:
    def __init__(self, ranks: str = RANKS):
        self.ranks = ranks

    def open(self) -> _Encoder:
        if self.ranks not in _OPEN:
            _OPEN[self.ranks] = _Encoder(self.ranks)
        return _OPEN[self.ranks]


class _Encoder:
    def __init__(self, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("lf", pat_str=PATTERN, mergeable_ranks=held, special_tokens={})

    def encode(self, text: str):
        """The ids of a text, as a numpy array of uint32.

        A long text goes in runs of whole pieces of the pattern that end after a character that is no space (a run's
        own end would join white space that the text's does not), so that its ids are those of the whole; a single
        long piece goes past the pattern.
        """
        import numpy as np

        if len(text) <= STEP:
            return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        out, at, loose = [], 0, []  # from ``at`` on nothing is encoded; ``loose``: the last pieces of white space

        def run(end: int) -> None:
            if end > at:
                out.append(self.encoding.encode_to_numpy(text[at:end], allowed_special=set(), disallowed_special=()))

        for m in _PIECES.finditer(text):
            if m.end() - m.start() > STEP:
                run(loose[0].start() if loose else m.start())
                out += [np.array(self.encoding._encode_single_piece(x[0]), dtype=np.uint32) for x in (*loose, m)]
                at, loose = m.end(), []
                continue
            if not loose and m.end() - at > STEP:
                run(m.start())
                at = m.start()
            loose = [*loose, m] if text[m.end() - 1].isspace() else []
        run(len(text))
        return np.concatenate(out)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(self.encode(t)) for t in texts]
