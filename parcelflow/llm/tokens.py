"""Whole-text tokenisation inside tasks, by the tokenizers library.

White space separates what the tokenizer sees (its normaliser folds white space to one blank, its
pre-tokeniser drops it), so a text's ids are those of its blank-separated chunks, one after another.
Each distinct chunk is encoded by the library once in a worker and kept in a bounded memo; the tests
hold the result against ``Tokenizer.encode`` of whole texts. A file with other rules (see ``cuts_at_blanks``) has its
texts encoded whole.
"""

from __future__ import annotations

import json

import numpy as np

from . import common

#: Chunks that a worker keeps; the memo starts afresh beyond it (this bounds memory, not the result).
MEMO_ENTRIES = 600_000
#: Longer chunks are encoded each time.
MEMO_CHUNK_BYTES = 48
#: Words given to the library in one string.
JOINED = 500

_PUNCTUATION = b",.!?;:"


def cuts_at_blanks(rules: dict) -> bool:
    """Whether a tokenizer file's rules never look across white space: its normaliser composes, folds white space and lowers
    case, its pre-tokeniser keeps what matches a pattern of letters, digits and signs and drops the rest, and its merges end
    with the word."""
    normal, cut, model = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [normal]) if n]
    allowed = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    parts = cut.get("pretokenizers", [cut])
    split = parts[0] if parts else {}
    pattern = (split.get("pattern") or {}).get("Regex", "\\s")
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and r"[^\s\p{L}\p{N}]+" in pattern and "\\s" not in pattern.replace(r"[^\s", "")
    bytes_ = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in parts[1:])
    return steps == allowed and drops and bytes_ and model.get("type") == "BPE" and not model.get("dropout") and bool(model.get("end_of_word_suffix"))


class ChunkEncoder:
    """Ids of texts as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = cuts_at_blanks(json.loads(self.tokenizer.to_str()))
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.marks = [t for t in (a.content for a in self.tokenizer.get_added_tokens_decoder().values())]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.path = path

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone: many to a call, told apart by the marks of word ends."""
        found: dict[str, bytes] = {}
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._library([" ".join(g) for g in groups])):
            row = np.array(ids, self.dtype)
            stops = np.flatnonzero(self.ends[row]) + 1
            if len(stops) == len(group):
                raw, at = row.tobytes(), 0
                for word, stop in zip(group, (stops * self.width).tolist()):
                    found[word] = raw[at:stop]
                    at = stop
            else:  # letters that the tokenizer's rules split otherwise
                for word, own in zip(group, self._library(group)):
                    found[word] = np.array(own, self.dtype).tobytes()
        return found

    def _learn(self, chunks: list[bytes], known: dict[bytes, bytes]) -> None:
        split, alone = {}, []
        for chunk in chunks:
            core = chunk.rstrip(_PUNCTUATION)
            if core and (core.isalpha() or (b"'" not in core and core.decode().isalpha())):
                split[chunk] = core, chunk[len(core) :]
            else:
                alone.append(chunk)
        tails = list({t for _, t in split.values() if t and t not in known})
        for chunk, ids in zip(alone + tails, self._library([c.decode() for c in alone + tails])):
            known[chunk] = np.array(ids, self.dtype).tobytes()
        cores = list({c for c, _ in split.values() if c not in known})
        for word, raw in self._words([c.decode() for c in cores]).items():
            known[word.encode()] = raw
        for chunk, (core, tail) in split.items():
            if tail:
                known[chunk] = known[core] + known[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text (null: none), as bytes."""
        if not self.chunked:
            return [np.array(ids, self.dtype).tobytes() for ids in self._library([t or "" for t in texts])]
        known = common.memo(f"chunks {self.path}", MEMO_ENTRIES)
        out: list[bytes | None] = []
        rows: list[list[bytes]] = []
        new: set[bytes] = set()
        for text in texts:
            text = text or ""
            if any(mark in text for mark in self.marks):  # the library finds its own marks in the raw text
                rows.append([])
                out.append(np.array(self._library([text])[0], self.dtype).tobytes())
                continue
            chunks = text.encode("utf-8", "replace").lower().split()  # A-Z only, and ASCII white space only
            rows.append(chunks)
            out.append(None)
            new.update(c for c in chunks if c not in known)
        long: dict[bytes, bytes] = {}
        if new:
            self._learn([c for c in new if len(c) <= MEMO_CHUNK_BYTES], known)
            rare = [c for c in new if len(c) > MEMO_CHUNK_BYTES]
            for chunk, ids in zip(rare, self._library([c.decode() for c in rare])):
                long[chunk] = np.array(ids, self.dtype).tobytes()
        if long:
            return [b"".join([known[c] if c in known else long[c] for c in row]) if o is None else o for row, o in zip(rows, out)]
        get = known.__getitem__
        return [b"".join(map(get, row)) if o is None else o for row, o in zip(rows, out)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; workers live on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
