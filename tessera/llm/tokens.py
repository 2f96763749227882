"""Token ids of whole texts, by the tokenizers library with a bounded cache of pieces.

A byte-level BPE never merges across its pre-token borders, and there is always such a border where
white space follows something else and where a run of letters ends.  A text is therefore cut there,
each distinct piece is encoded once, and the ids of the pieces are joined; a text with white space other than
blank, tab and line ends, or with an added token of the vocabulary, is encoded in one go.  The result is that of encoding the whole
text with the library.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from tessera.llm import caches

#: Name of the vocabulary in the public tokenizers folder; a path works too.
VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept by a worker at most; the cache starts afresh beyond.
CACHE_PIECES = 1_500_000
#: Texts whose new pieces are encoded together.
TEXTS_AT_ONCE = 128
#: New pieces that are encoded as lines of one text.
LINES_AT_ONCE = 500
#: White space and a run of Latin letters that an ASCII sign or the end follows, or all up to the next space.
_PIECE = re.compile(r"[ \n\t\r]*(?:[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7f])|[^ \n\t\r]+)|[ \n\t\r]+\Z")
_ODD_SPACE = re.compile(r"[^\S \n\t\r]")


class Encoder:
    def __init__(self, vocabulary: str):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) if added else r"(?!)")
        self.known: dict[str, bytes] = {}
        end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = end[0] if len(end) == 1 else -1

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces: most of them many at a time, as lines of one text, which cuts them apart just
        as well; pieces with other white space than one leading blank, one by one."""
        lines = [p for p in pieces if p[0] not in "\n\t\r" and p[1:2] not in (" ", "\n", "\t", "\r")]
        rest = [p for p in pieces if p[0] in "\n\t\r" or p[1:2] in (" ", "\n", "\t", "\r")]
        groups = [lines[i : i + LINES_AT_ONCE] for i in range(0, len(lines), LINES_AT_ONCE)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            breaks = np.flatnonzero(ids == self.line_end)
            if len(breaks) == len(group) - 1:
                raw = ids.tobytes()
                starts, ends = [0, *(4 * breaks + 4).tolist()], [*(4 * breaks).tolist(), len(raw)]
                self.known.update(zip(group, (raw[a:b] for a, b in zip(starts, ends))))
            else:
                rest += group
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4")
            counts = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(part)) if len(ids) else np.zeros(len(part), int)
            raw, ends = ids.tobytes(), np.cumsum(counts) * 4
            self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for null."""
        caches.hold(self.known)
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            out += self._encode(texts[at : at + TEXTS_AT_ONCE])
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        waiting, new, known = [], set(), self.known
        for i, text in enumerate(texts):
            if text and self.added.search(text):
                out[i] = self._whole(text)
            elif text:
                pieces = _PIECE.findall(text)
                found = list(map(known.get, pieces))
                if None in found:
                    holes = [k for k, ids in enumerate(found) if ids is None]
                    new.update([pieces[k] for k in holes])
                    waiting.append((i, pieces, found, holes))
                else:
                    out[i] = b"".join(found)
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
        self._learn([p for p in new if not _ODD_SPACE.search(p)])
        for i, pieces, found, holes in waiting:
            for k in holes:
                found[k] = known.get(pieces[k])
            # a piece with odd white space is never known: such a text is encoded in one go
            whole = None in found
            out[i] = self._whole(texts[i]) if whole else b"".join(found)
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One a worker process."""
    return Encoder(vocabulary)
