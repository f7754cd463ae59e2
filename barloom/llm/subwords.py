"""Token ids of whole texts from a public tokenizer, a batch at a time, each different word encoded once."""

from __future__ import annotations

import os

#: Words whose ids a worker remembers between batches (memory only; never changes a result).
REMEMBERED = 600_000
#: Text bytes handled at once.
PIECE = 4 << 20
#: A letter and a mark after it; marks of special tokens and contractions are left out.
_CUT = r"([a-z])([!-&(-/:;=?@\[-`{}~])"


def default_path() -> str:
    """The word-level BPE file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_encoders: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """The worker process's own encoder, loaded once; what it remembers of words serves all of its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and never joins across it.

    Splitting at ASCII white space then leaves the ids unchanged (the tests compare with whole texts), so each
    different word goes through the tokenizer once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers."""
        import numpy as np

        known = self.known
        found = [known.get(w) for w in words]
        new = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            encoded = self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)
            for i, e in zip(part, encoded):
                found[i] = np.array(e.ids, dtype="<u4").tobytes()
                if len(known) < REMEMBERED:
                    known[words[i]] = found[i]
        return found

    def encode(self, texts, end: int | None = None):
        """Flat ids and row offsets of an Arrow string array; null is empty, ``end`` follows each text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # the tokenizer lowers case and cuts between a letter and a mark itself; doing so first leaves fewer words
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=_CUT, replacement=r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        ids = self.word_ids(coded.dictionary.to_pylist())
        index = np.asarray(coded.indices, dtype=np.int64) if len(flat) else np.zeros(0, np.int64)
        size = np.fromiter((len(b) >> 2 for b in ids), dtype=np.int64, count=len(ids))
        first = np.concatenate([[0], np.cumsum(size)])
        stock = np.frombuffer(b"".join(ids), dtype="<u4")
        length = size[index]
        done = np.concatenate([[0], np.cumsum(length)])
        out = stock[np.repeat(first[index] - done[:-1], length) + np.arange(done[-1])] if len(index) else stock[:0]
        rows = done[bounds]
        if end is not None:
            out = np.insert(out, rows[1:], np.uint32(end))
            rows = rows + np.arange(len(rows))
        return out, rows


def pieces(column, size: int = PIECE):
    """Slices ``(from, to)`` of a string column of about ``size`` bytes each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64) + 8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to
