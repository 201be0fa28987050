"""Exact encoding by chunk: a text's ids are the concatenation of the ids of
chunks that no pre-token or merge crosses, so each distinct chunk is encoded
once per worker and found in a dictionary afterwards.

Texts for which the cut is not certain to agree with the library (special-token
strings, separators on whose class regex engines disagree) go to the library
whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

#: Entries a worker's cache may hold; beyond them it starts anew.  A chunk over
#: MAX_KEY characters is encoded each time and never kept.
CACHE_ENTRIES = 500_000
MAX_KEY = 64

#: Characters that one engine counts as white space and another does not.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎​  ﻿]")


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> re.Pattern | None:
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, names))) if names else None


class ChunkCache:
    """``values(text)`` gives one value per chunk.  ``encode`` maps a list of
    chunks to their values; ``frequent`` is the tier that is never evicted."""

    def __init__(self, encode: Callable[[list[str]], list], frequent: dict | None = None, entries: int = CACHE_ENTRIES):
        self.encode, self.frequent, self.entries = encode, frequent or {}, entries
        self.kept: dict = dict(self.frequent)

    def values(self, chunks: list[str]) -> list:
        out = list(map(self.kept.get, chunks))
        if None in out:
            missing = list({c for c, v in zip(chunks, out, strict=True) if v is None})
            found = dict(zip(missing, self.encode(missing), strict=True))
            out = [found[c] if v is None else v for c, v in zip(chunks, out, strict=True)]
            if len(self.kept) + len(found) > self.entries + len(self.frequent):
                self.kept = dict(self.frequent)
            if len(found) <= self.entries:
                self.kept.update((c, v) for c, v in found.items() if len(c) <= MAX_KEY)
        return out


    def many(self, lists: list[list[str]]) -> list[list]:
        """``values`` of each list, encoding what is missing from all of them at once."""
        outs = [list(map(self.kept.get, chunks)) for chunks in lists]
        gaps = [(i, [j for j, v in enumerate(out) if v is None]) for i, out in enumerate(outs) if None in out]
        missing = {lists[i][j] for i, at in gaps for j in at}
        if missing:
            names = list(missing)
            found = dict(zip(names, self.encode(names), strict=True))
            for i, at in gaps:
                out, chunk = outs[i], lists[i]
                for j in at:
                    out[j] = found[chunk[j]]
            if len(self.kept) + len(found) > self.entries + len(self.frequent):
                self.kept = dict(self.frequent)
            if len(found) <= self.entries:
                self.kept.update((c, v) for c, v in found.items() if len(c) <= MAX_KEY)
        return outs


def unsure(text: str) -> bool:
    return not text.isascii() and _UNSURE.search(text) is not None or text.isascii() and _CONTROL.search(text) is not None


_CONTROL = re.compile("[\x1c-\x1f]")
