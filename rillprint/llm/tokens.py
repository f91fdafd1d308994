"""Token ids by the ``tokenizers`` library, with each distinct piece of text encoded once.

A byte-level BPE file pre-splits text so that a literal space followed by a non-space always
begins a new pre-token, and so does the first line break after a non-space.  Texts are therefore cut
at those places, every distinct piece is encoded by the library once per worker, and the ids
are joined.  Texts with any other white space pattern (runs of spaces, tabs, three line breaks, two before
a space or the end) or an added token go to the library whole, so ids always equal ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import functools
import os

import numpy as np

#: Pieces kept per worker; further pieces are encoded again when they recur.
CACHE_PIECES = 700_000
#: Pieces encoded by one call of the library.
LEARN_PIECES = 20_000


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> "PieceEncoder":
    return PieceEncoder(path)


class PieceEncoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit, self.known = cache_pieces, {}
        self.marks = {}
        rules = self._rules(path)
        self.cut, self.added = rules is not None, rules or []
        if self.cut:
            self.marks = {m: self._whole(m) for m in (",", ".", "\n")}
            self.line = int(np.frombuffer(self.marks["\n"], self.type)[0])
            self.cut = len(self.marks["\n"]) == self.type.itemsize

    @staticmethod
    def _rules(path: str) -> list[str] | None:
        """The added tokens.  Pieces are only cut for the byte-level pre-tokenizer without normalizer or prefix space."""
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        # an added token that eats white space or holds any would reach over a cut
        bare = all(not a["lstrip"] and not a["rstrip"] and not any(c.isspace() for c in a["content"]) for a in added)
        return [a["content"] for a in added] if plain and bare and not spec.get("normalizer") and not spec.get("post_processor") else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """The text cut before each space and line break, or None where cuts are not safe.

        A piece that begins with a line break or the text has no space before it; all others have one.
        """
        # an added token ends the text before it, as two line breaks at an end are one pre-token
        if not self.cut or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n") or any(a in text for a in self.added):
            return None
        spaced = text.replace("\n", " \n")
        if "  " in spaced or spaced.endswith(" "):
            return None
        # no white space but spaces and line breaks
        if len(text) != text.count(" ") + text.count("\n") + sum(map(len, text.split())):
            return None
        pieces = spaced.split(" ")
        if pieces[0]:
            pieces[0] = " " + pieces[0]  # the key of a piece without a space before it
        else:
            del pieces[0]
        return pieces

    def _learn(self, new: list[str], fresh: dict[str, bytes]) -> None:
        """Encode pieces, many to a call with line breaks between; a comma or full stop after a letter is its own pre-token."""
        known, marks, ask, tails, heads = self.known, self.marks, {}, [], []
        for key in new:
            if key[:1] == "\n":
                heads.append(key)
                key = " " + key[1:]
                if key == " " or key in known:
                    continue
            if key[-1] in ",." and key[-2:-1].isalpha():
                tails.append(key)
                key = key[:-1]
                if key in known:
                    continue
            ask[key] = None
        keys = list(ask)
        for at in range(0, len(keys), LEARN_PIECES):
            part = keys[at : at + LEARN_PIECES]
            text = "".join([("\n" + k[1:] if k[0] == " " else "\n " + k) for k in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(ids == self.line)
            size, raw = self.type.itemsize, ids.tobytes()
            ends = [*(ends * size).tolist(), len(raw)]
            if len(ends) != len(part) + 1:
                raise ValueError("the vocabulary does not keep line breaks apart")
            for i, key in enumerate(part):
                fresh[key] = raw[ends[i] + size : ends[i + 1]]
        at = lambda key: fresh[key] if key in fresh else known[key]
        for key in tails:
            fresh[key] = at(key[:-1]) + marks[key[-1]]
        for key in heads:
            fresh[key] = marks["\n"] + (at(" " + key[1:]) if len(key) > 1 else b"")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none of a null."""
        out: list[np.ndarray | None] = [None] * len(texts)
        cut = [self._pieces(t) if t else None for t in texts]
        known, fresh = self.known, {}
        new = set().union(*(p for p in cut if p)).difference(known) if any(cut) else set()
        if new:
            self._learn(list(new), fresh)
            if len(known) < self.limit:
                known.update(fresh)
                fresh = {}
        get = known.__getitem__
        for i, (t, p) in enumerate(zip(texts, cut)):
            if p is not None:
                joined = b"".join([known[k] if k in known else fresh[k] for k in p] if fresh else map(get, p))
                out[i] = np.frombuffer(joined, self.type)
            elif t:
                out[i] = np.frombuffer(self._whole(t), self.type)
            else:
                out[i] = np.zeros(0, self.type)
        return out
