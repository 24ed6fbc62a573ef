"""Token ids of whole texts, by pieces that the vocabulary's own pre-tokenizer can't join.

A text is cut at white space, each distinct piece is encoded once by the ``tokenizers`` library and
its ids are reused.  That gives the ids of the whole text because no pre-token spans such a cut.
"""

from __future__ import annotations

import re
import string

import numpy as np

from frostline.llm.common import kept, one_thread

#: Where a space or line break stands beside other white space, the run decides how it is split.
_RUNS = ("  ", "\n\n", " \n", "\n ")
_ENDS = (" ", "\n")
#: White space beside the two, and the mark at which texts are cut.
_ODD = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and c not in _ENDS) | {"\0"}


_ODD_ONE = re.compile("[" + re.escape("".join(sorted(_ODD))) + "]")
#: Trailing marks that every pre-tokenizer here parts from letters and digits before them; an apostrophe may not be.
_MARKS = "".join(c for c in string.punctuation if c != "'")


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``drops_space``: the vocabulary drops white space (cut at any of it); else a space belongs to the
    word after it, and only texts whose white space is single spaces and line breaks are cut.  ``specials``:
    the strings of special tokens in a text become those tokens, as in a plain call of the library, and a
    text that holds one stays whole; else they are ordinary text.
    ``max_pieces`` bounds the pieces held in memory between calls: beyond, all go; where space is kept, there are more pieces.
    Null and empty texts have no ids.
    """

    def __init__(self, path: str, drops_space: bool, specials: bool = False, max_pieces: int | None = None):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.marks = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()) if specials else ()
        self.drops_space, self.max_pieces = drops_space, max_pieces or (600_000 if drops_space else 800_000)
        self.known: dict[str | bytes, bytes] = {"": b""}
        self.between = " \x01 " if drops_space else "\n"
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        (self.between_id,) = ids(self.between)
        self.lowers = drops_space and all(ids(c) == ids(c.lower()) for c in string.ascii_uppercase)
        # By which ids a run of words falls apart without marks between: the last of a word, or the first behind a space.
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(names.values()) + 1, bool)
        self.edge[[i for t, i in names.items() if (t.endswith("</w>") if drops_space else t.startswith("Ġ"))]] = True

    def cut(self, text: str) -> list | None:
        """A text's pieces, or None where it must stay whole."""
        if any(m in text for m in self.marks):
            return None
        if self.drops_space:
            raw = text.encode()
            return (raw.lower() if self.lowers else raw).split()  # at U+0009..U+000D and space; of ASCII letters
        if text.startswith(_ENDS) or text.endswith(_ENDS) or any(r in text for r in _RUNS) or _ODD_ONE.search(text):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cuts, whole = [self.cut(t) if t else [] for t in texts], set()
        for i, c in enumerate(cuts):
            if c is None:
                cuts[i] = [texts[i]]
                whole.add(texts[i])
        self._know(set().union(*cuts).difference(self.known), whole)
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cuts]
        if len(self.known) > self.max_pieces:
            self.known = {"": b""}
        return out

    def _know(self, pieces: set, whole: set) -> None:
        """Put pieces into the store: words with marks behind them from their parts, which are met more often.

        A word of letters and digits and the marks behind it are parts.
        """
        known, made, todo = self.known, [], list(pieces.intersection(whole))
        new = pieces.difference(whole)
        if self.drops_space:
            marks = _MARKS.encode()
            for p in new:
                base = p.rstrip(marks)
                if base != p and (base.isalnum() or (base and base.decode().lower().isalnum())):
                    made.append((p, base, p[len(base) :]))
                else:
                    todo.append(p)
        else:
            for p in new:
                base = p.rstrip(_MARKS)
                if base != p and (base[1:] if base[:1] == " " else base).isalnum():
                    made.append((p, base, p[len(base) :]))
                else:
                    todo.append(p)
        parts = {b for _, b, _ in made}.union(t for _, _, t in made).difference(known, todo)
        self._learn([*todo, *parts], whole)
        for p, base, tail in made:
            known[p] = known[base] + known[tail]

    def _learn(self, pieces: list, whole: set) -> None:
        """Encode pieces, many at once; words fall apart by their ids, others by a pre-token of their own between; ``whole`` ones apart."""
        known = self.known
        if self.drops_space:
            named = [(p, p.decode() if isinstance(p, bytes) else p) for p in pieces]
            words = [(p, t) for p, t in named if t.isalpha() and p not in whole]
            rest = [(p, t) for p, t in named if not t.isalpha() or p in whole]
            single, between = [x for x in rest if x[0] in whole or "\x01" in x[1]], " "
        else:
            words = [(p, p) for p in pieces if p[:1] == " " and p not in whole]
            rest = [(p, p) for p in pieces if p[:1] != " " or p in whole]
            single, between = [x for x in rest if x[1] == self.between or x[0] in whole], ""
        single += self._together(words, between, lambda ids: self.edge[np.minimum(ids, len(self.edge) - 1)], False)
        apart = {p for p, _ in single}
        single += self._together([x for x in rest if x[0] not in apart], self.between, lambda ids: ids == self.between_id, True)
        for i in range(0, len(single), 10_000):
            part = single[i : i + 10_000]
            for (piece, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                known[piece] = np.array(e.ids, "<u4").tobytes()

    def _together(self, pieces: list, between: str, edges, marks: bool) -> list:
        """Encode runs of a thousand pieces, cut at ``edges`` of their ids; the pieces of runs that don't fall apart as expected."""
        known, failed = self.known, []
        runs = [pieces[i : i + 1_000] for i in range(0, len(pieces), 1_000)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([between.join([t for _, t in r]) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(edges(ids))
            if marks:  # a mark stands between two pieces
                starts, ends = np.append(0, at + 1), np.append(at, len(ids))
            elif self.drops_space:  # a word's last id
                starts, ends = np.append(0, at[:-1] + 1), at + 1
            else:  # a word's first id
                starts, ends = at, np.append(at[1:], len(ids))
            if len(starts) != len(run) or (not marks and (starts[0] or ends[-1] != len(ids))):
                failed += run
                continue
            raw = ids.tobytes()
            known.update(zip([p for p, _ in run], [raw[s:e] for s, e in zip((4 * starts).tolist(), (4 * ends).tolist())]))
        return failed


def vocabulary_size(path: str) -> int:
    """Number of ids of a vocabulary, special tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoder(path: str, drops_space: bool, specials: bool = False) -> PieceEncoder:
    """The worker process's own encoder for a vocabulary; kept from task to task."""
    key = (path, drops_space, specials)
    return kept("encoding", key, lambda: PieceEncoder(*key))  # one vocabulary's pieces at a time


def slices(values: list, most_chars: int = 4_000_000):
    """Index ranges of a batch whose texts sum to a bounded number of characters."""
    start, total = 0, 0
    for i, v in enumerate(values):
        total += len(v) if v else 0
        if total >= most_chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(values):
        yield start, len(values)
