"""Token ids of whole texts by a file of the `tokenizers` library, a run of texts at a time.

Where a vocabulary drops white space before its merges, no token crosses a white-space byte, so a text's ids
are those of its chunks in a row. The chunks of a run are numbered by a dictionary, each distinct one is given to
the library once or looked up among those met before, and the run's ids are gathered by number: what Python
does word by word is done for distinct words alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import per_worker, plain_strings, release_memory, text_runs

#: Punctuation that ends a word; such a run is a piece of its own behind a plain word.
_ENDS = ".,;:!?"
#: Plain words: letters that composition leaves alone and that have a lower case of one character.
_PLAIN = "^[a-zß-öø-ÿ]+$"
_LOWERED = "A-ZÀ-ÖØ-Þ"


def gathered(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[i], start[i] + 1, ... of length[i] each, in a row."""
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - length), length) + np.arange(total)


class WordEncoder:
    """Ids of texts as unsigned 32-bit integers; null is the empty text.

    Words met are kept; where a run finds more than ``most_words`` of them, or more than ``most_ids`` ids, it starts
    afresh. Memory is bounded by that and by a run, whatever the texts hold.
    """

    def __init__(self, path: str, most_words: int = 300_000, most_ids: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: the cores belong to Spark's tasks
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words, self.most_ids = most_words, most_ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = _drops_space(spec)
        end = spec["model"].get("end_of_word_suffix") or ""
        self.words_alone = None
        if self.by_chunk and end and _lowers(spec) and _keeps_words(spec):
            # Plain words in lower case pass the normaliser as they are and are one piece each: their merges are all there is.
            self.words_alone = Tokenizer.from_file(path)
            self.words_alone.normalizer = None
            self.words_alone.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            self.is_end = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.is_end[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(end)]] = True
        self._forget()

    def _forget(self) -> None:
        self.kept = pa.array([b""], pa.binary())
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.n_ids = np.zeros(8192, np.uint32), 0

    def _add(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep distinct words with their ids; they are numbered in their order."""
        n, m = len(self.kept), len(words)
        self.kept = pa.concat_arrays([self.kept, words])
        self.start, self.length = _grown(self.start, n + m), _grown(self.length, n + m)
        self.ids = _grown(self.ids, self.n_ids + len(ids))
        self.length[n : n + m] = lengths
        self.start[n : n + m] = self.n_ids + np.cumsum(lengths) - lengths
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Ask the library for distinct words that are not kept: plain ones together, any other chunk alone. Their numbers."""
        first = len(self.kept)
        plain = pc.match_substring_regex(words.cast(pa.string()), _PLAIN).to_numpy(zero_copy_only=False) if self.words_alone else np.zeros(len(words), bool)
        order = np.argsort(~plain, kind="stable")
        words, n_plain = words.take(pa.array(order)), int(plain.sum())
        ids, lengths = [], []
        for a in range(0, n_plain, 2000):
            part = words.slice(a, min(2000, n_plain - a)).to_pylist()
            ids.append(np.array(self.words_alone.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32))
            lengths.append(np.diff(np.flatnonzero(self.is_end[ids[-1]]), prepend=-1))
        for a in range(n_plain, len(words), 2000):
            part = words.slice(a, 2000).to_pylist()
            each = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(lengths[-1].sum())))
        self._add(words, np.concatenate(ids), np.concatenate(lengths))
        out = np.empty(len(words), np.int64)
        out[order] = np.arange(first, first + len(words))
        return out

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of these distinct words among those kept."""
        words = words.cast(pa.binary())
        found = pc.index_in(words, value_set=self.kept)
        if found.null_count:
            missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            out = found.fill_null(0).to_numpy().astype(np.int64)
            out[missing] = self._learn(words.take(pa.array(missing)))
            return out
        return found.to_numpy().astype(np.int64)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        if len(self.kept) > self.most_words or self.n_ids > self.most_ids:
            self._forget()
        numbered = chunks.dictionary_encode()
        every, number = numbered.dictionary, numbered.indices.to_numpy()
        if self.words_alone:
            bare = pc.utf8_rtrim(every, characters=_ENDS)
            low = pc.utf8_lower(bare)
            same_width = pc.equal(pc.binary_length(low), pc.binary_length(bare))
            apart = pc.and_(pc.match_substring_regex(low, _PLAIN), pc.and_(same_width, pc.match_substring_regex(bare, f"^[{_LOWERED}{_PLAIN[2:]}")))
            base = pc.if_else(apart, low, every).dictionary_encode()
            end = _tails(every, bare, apart).dictionary_encode()
            # Base and end of each distinct chunk in a row.
            both = np.stack([self._numbers(x.dictionary)[x.indices.to_numpy()] for x in (base, end)], axis=1).ravel()
            lengths = self.length[both].reshape(-1, 2).sum(axis=1)
            ids = self.ids[gathered(self.start[both], self.length[both])]
            start = np.cumsum(lengths) - lengths
        else:
            k = self._numbers(every)
            ids, start, lengths = self.ids, self.start[k], self.length[k]
        n = lengths[number]
        return ids[gathered(start[number], n)], n

    def encode_runs(self, texts: pa.Array | pa.ChunkedArray, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of these rows' texts in a row, where each row's begin and the last's end)."""
        texts = plain_strings(texts)
        for a, b in text_runs(texts, most_bytes):
            part = texts.slice(a, b - a)
            if not self.by_chunk:
                each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
                yield a, b, np.concatenate(each), np.cumsum([0, *map(len, each)])
                continue
            chunks = pc.ascii_split_whitespace(part)
            flat, bounds = chunks.flatten(), chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
            # A long text's chunks are taken in turns, so that only its ids grow with it.
            made = [self._chunks(flat.slice(x, 1_000_000)) for x in range(0, len(flat), 1_000_000)]
            ends = np.concatenate([[0], *(n for _, n in made)]).cumsum()
            yield a, b, np.concatenate([ids for ids, _ in made]) if made else np.zeros(0, np.uint32), ends[bounds]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian bytes."""
        for a, b, ids, ends in self.encode_runs(pa.array(list(texts), pa.string())):
            for k in range(b - a):
                yield ids[ends[k] : ends[k + 1]].astype("<u4").tobytes()


def _tails(every: pa.Array, bare: pa.Array, apart: pa.Array) -> pa.Array:
    """What stands behind ``bare`` in each of ``every`` where ``apart`` holds, else nothing."""
    low, high = pc.binary_length(bare).to_numpy().astype(np.int64), pc.binary_length(every).to_numpy().astype(np.int64)
    n = np.where(apart.to_numpy(zero_copy_only=False), high - low, 0)
    offsets = np.frombuffer(every.buffers()[1], "<i4", every.offset + len(every) + 1)[every.offset :].astype(np.int64)
    data = every.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    tail = raw[gathered(offsets[:-1] + low, n)]
    bounds = np.concatenate([[0], n.cumsum()]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(bounds), pa.py_buffer(tail)])


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, len(x) * 3 // 2), x.dtype)
    out[: len(x)] = x
    return out


def _steps(spec: dict, name: str, inner: str) -> list[dict]:
    step = spec.get(name) or {}
    return step.get(inner) or ([step] if step else [])


def _drops_space(spec: dict) -> bool:
    """Whether the file's pre-tokenizer keeps matches of a pattern that matches no white space."""
    first = (_steps(spec, "pre_tokenizer", "pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(kept) and not any(x in pattern.replace(r"[^\s", "") for x in (r"\s", " ", r"\S", r"\P", "."))


def _lowers(spec: dict) -> bool:
    """Whether the normaliser turns letters to lower case and else composes characters and evens out blanks at most."""
    steps = _steps(spec, "normalizer", "normalizers")
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return any(x["type"] == "Lowercase" for x in steps) and all(x["type"] in ("NFC", "Lowercase") or x == blanks for x in steps)


def _keeps_words(spec: dict) -> bool:
    """Whether a run of letters is a piece, a run of punctuation behind it another, and bytes stand for themselves."""
    steps = _steps(spec, "pre_tokenizer", "pretokenizers")
    if [x.get("type") for x in steps] != ["Split", "ByteLevel"] or steps[1].get("add_prefix_space") or steps[1].get("use_regex"):
        return False
    ways = steps[0]["pattern"]["Regex"].split("|")
    return r"[\p{L}]+" in ways and r"[^\s\p{L}\p{N}]+" in ways and not any(w[:1].isalpha() or w[:1] in _ENDS for w in ways)


def _loaded(path: str) -> WordEncoder:
    """An encoder of the file; what reading it took beyond that is given back before the first text."""
    made = WordEncoder(path)
    release_memory()
    return made


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of the file."""
    return per_worker(partial(_loaded, path))
