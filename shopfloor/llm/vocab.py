"""Vocabulary of a BPE file and the merging of one word.

A word is a doubly linked list of symbols; a priority queue holds the
ranks of its neighbouring pairs.  The lowest rank is merged first, the
pairs it made are queued, and entries whose pair has changed meanwhile
are skipped as stale.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

from .common import process_cache

CHUNK = 1 << 20                 # code points of a text that are split at once

# Fixed values of the vocabulary file: contractions and classes of its splitting
# pattern.  Letters come first here; no other branch can start with one.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPLIT = r"\p{L}+|" + CONTRACTIONS + r"|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
# The same for text below U+0250, written out for the faster standard module.
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
SPLIT_LATIN = re.compile(f"[{_L}]+|{CONTRACTIONS}|[{_N}]|[^{_S}{_L}{_N}]+")
# Below U+0250 NFC changes nothing; U+0130 and four controls are left to the general way.
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]")
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable bytes stand
    for themselves, the others take code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Vocabulary:
    """Vocabulary file with merges: ids, strings, ranks and special tokens."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        ids = spec["model"]["vocab"]
        self.strings = {i: s for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.size = max(self.strings) + 1
        # pair of ids -> rank and id of the merged symbol, both in one integer
        self.merge = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merge.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        symbols = byte_symbols()
        self.byte_id = [ids[c] for c in symbols]
        self.last_byte_id = [ids[c + WORD_END] for c in symbols]
        self.split = regex.compile(SPLIT)
        self.runs = regex.compile(r"[^\p{White_Space}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None

    def word(self, word: str) -> list[int]:
        """Ids of one word: lowest rank first, leftmost of equal ranks."""
        data = word.encode("utf-8")
        symbols = [self.byte_id[b] for b in data]
        symbols[-1] = self.last_byte_id[data[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        merge = self.merge.get
        queue = []
        for i in range(n - 1):
            m = merge(symbols[i] << 20 | symbols[i + 1])
            if m is not None:
                queue.append((m >> 20) << 40 | i)
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFFFF
            a = symbols[i]
            j = after[i]
            if a < 0 or j >= n:
                continue                              # stale: merged away, or last now
            m = merge(a << 20 | symbols[j])
            if m is None or m >> 20 != entry >> 40:
                continue                              # stale: another pair stands here now
            symbols[i] = a = m & 0xFFFFF
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = merge(a << 20 | symbols[k])
                if m is not None:
                    push(queue, (m >> 20) << 40 | i)
            h = before[i]
            if h >= 0:
                m = merge(symbols[h] << 20 | a)
                if m is not None:
                    push(queue, (m >> 20) << 40 | h)
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """(special token or None, runs without white space) in the order of the text."""
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield part, []
            elif part:
                yield from ((None, runs) for runs in self._runs(part))

    def _runs(self, text: str) -> Iterator[list[str]]:
        if NOT_LATIN.search(text):
            # one character at a time: no rule here depends on its neighbours
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
            find = self.runs.findall
        else:
            text = text.lower()
            find = str.split
        at, n = 0, len(text)
        while n - at > CHUNK:                         # bounded lists of runs, cut at a blank
            cut = text.rfind(" ", at, at + CHUNK)
            cut = cut if cut > at else text.find(" ", at + CHUNK)
            if cut < 0:
                break
            yield find(text[at:cut])
            at = cut
        yield find(text[at:])

    def words(self, run: str) -> list[str]:
        return (self.split if NOT_LATIN.search(run) else SPLIT_LATIN).findall(run)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, runs in self.pieces(text):
            if special is not None:
                out.append(self.special[special])
            for r in runs:
                for w in self.words(r):
                    out += self.word(w)
        return out

    def decode(self, ids) -> str:
        """Vocabulary strings, joined as the file's missing decoder has it: by a blank."""
        return " ".join([self.strings[i] for i in ids])


def vocabulary(path: str) -> Vocabulary:
    return process_cache(f"vocabulary {path}", lambda: Vocabulary(path))
