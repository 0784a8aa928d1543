"""Coders of other vocabulary files, with the ways of ByteBpe: distinct pieces are encoded once and kept from part to part."""

from __future__ import annotations

from functools import cache

import numpy as np

from .bpe import ByteBpe, Part, byte_characters

BLANK_PIECE = "▁"


class FileBpe(ByteBpe):
    """Byte-level BPE of a file of the tokenizers library. Strings of special tokens within a text are plain text for encode(),
    and ids of their own for encode_special()."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [t.encode() for t in sorted(added)]
        self.char_of_byte = byte_characters()
        self.byte_of_char = {c: b for b, c in enumerate(self.char_of_byte)}
        vocab = self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = t.encode() if t in added else bytes(self.byte_of_char[c] for c in t)
        self.tokenizer.encode_special_tokens = True
        self._tables(tokens)

    def encode_special(self, text: str) -> np.ndarray:
        """Ids of a text in which strings of special tokens are those tokens."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        finally:
            self.tokenizer.encode_special_tokens = True


class PieceBpe(ByteBpe):
    """BPE of a sentencepiece file that puts a blank before a text and falls back to bytes. Only for parts that are cut before
    blanks and whose texts start with one: a piece is encoded without its first blank, which the library adds. No merge
    spans a cut, as no piece of the vocabulary holds a blank behind another character (else there is a ValueError)."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            if BLANK_PIECE in piece.lstrip(BLANK_PIECE):
                raise ValueError(f"{piece!r} holds a blank within")
            if self.processor.is_byte(i):
                tokens.append(bytes([int(piece[3:5], 16)]))
            elif self.processor.is_control(i) or self.processor.is_unknown(i):
                tokens.append(b"")
            else:
                tokens.append(piece.replace(BLANK_PIECE, " ").encode())
        self._tables(tokens)

    def _encode(self, part: Part, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw, begin, size = part.data.tobytes(), part.start[first].tolist(), part.size[first].tolist()
        flat, n = [], np.empty(len(first), np.int64)
        for at in range(0, len(first), 4096):  # the library's lists are many times the size of their ids
            texts = [raw[a + 1 : a + k].decode() for a, k in zip(begin[at : at + 4096], size[at : at + 4096], strict=True)]
            # a piece that is only the blank: of an empty text the library makes nothing
            made = [ids if t else self._blank() for t, ids in zip(texts, self.processor.encode(texts, num_threads=1), strict=True)]
            n[at : at + len(made)] = [len(x) for x in made]
            flat.append(np.fromiter((i for x in made for i in x), np.int32))
        return np.concatenate(flat), np.cumsum(n) - n, n

    def _blank(self) -> list[int]:
        return [self.processor.piece_to_id(BLANK_PIECE)]


@cache
def file_bpe(path: str) -> FileBpe:
    """One instance for each Python worker."""
    return FileBpe(path)


@cache
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)
