"""Texts to token ids by way of their distinct words.

For tokenizers that never join text across white space, the ids of a text are
those of its words in order. Each batch is split and reduced to distinct words
in Arrow; ``resolve`` gives the ids of words not seen before; numpy puts the
texts together again.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Callable, Sequence
from itertools import batched
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words kept between batches, and words assembled at a time: both bound a worker's memory.
KEPT_WORDS = 500_000
GATHERED_WORDS = 500_000
WORDS_PER_CALL = 5_000

# The pre-tokenizer's pattern under which words fold as WordIds does.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def folds(tokenizer_file: str) -> bool:
    """Whether the tokenizer ignores case and cuts between letters or digits and what follows."""
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": SPLIT}


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """Something a Python worker keeps from task to task."""
    held = sys.modules.setdefault("_tidelog_worker", types.ModuleType("_tidelog_worker")).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


# Latin letters whose case folds one to one and that no mark after them changes.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


class WordIds:
    """``resolve`` takes distinct words and returns their ids: all in one array, and how many each word has.

    With ``fold``, trailing full stops and commas are looked up apart from the
    letter or digit before them, and words of Latin-1 letters in lower case:
    fewer words to resolve, the same ids. ``lasting`` tells the words that come
    again and again; they stay when others have to go, for most distinct words of
    a corpus are met once or twice.
    """

    def __init__(
        self, resolve: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], fold: bool = False,
        lasting: Callable[[Sequence[str]], np.ndarray] | None = None, kept: int = KEPT_WORDS,
    ):
        self.resolve, self.fold, self.lasting, self.kept = resolve, fold, lasting, kept
        self.slots: dict[str, int] = {"": 0}
        self.forget()

    def forget(self) -> None:
        if self.lasting and len(self.slots) > 1:
            stays = np.concatenate([self.lasting(some) for some in batched(self.slots, WORDS_PER_CALL)])
            stays[0] = True
            # Slots are numbered, and their ids laid out, in the order of the words.
            self.ids, self.counts = self.ids[np.repeat(stays, self.counts)], self.counts[stays]
            self.starts = np.cumsum(self.counts) - self.counts
            self.slots = {w: n for n, w in enumerate(w for w, stay in zip(self.slots, stays.tolist()) if stay)}
            return
        self.slots = {"": 0}
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.counts = np.zeros(1, np.int64)

    def slots_of(self, words: list[str]) -> np.ndarray:
        slots = list(map(self.slots.get, words))
        if None in slots:
            new = {w: None for w, slot in zip(words, slots) if slot is None}
            if len(self.slots) + len(new) > self.kept and len(self.slots) > 1:
                self.forget()
                new = dict.fromkeys(w for w in words if w not in self.slots)
            parts = [self.resolve(some) for some in batched(new, WORDS_PER_CALL)]
            ids, counts = (np.concatenate(p) for p in zip(*parts))
            first = len(self.slots)
            self.slots.update(zip(new, range(first, first + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
            slots = list(map(self.slots.__getitem__, words))
        return np.array(slots, np.int64)

    def folded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's stem and the stops after it."""
        stems = pc.ascii_rtrim(words, characters=".,")
        stems = pc.if_else(pc.match_substring_regex(stems, f"[{LATIN}0-9]$"), stems, words)
        plain = pc.match_substring_regex(stems, f"^[{LATIN}]+$")
        kept, whole = (pc.binary_length(a).to_numpy(zero_copy_only=False) for a in (stems, words))
        stops = np.full(len(words), "", object)
        cut = np.flatnonzero(kept < whole)
        stops[cut] = [w[-n:] for w, n in zip(words.take(pa.array(cut)).to_numpy(zero_copy_only=False), (whole - kept)[cut].tolist())]
        return pc.if_else(plain, pc.utf8_lower(stems), stems).to_numpy(zero_copy_only=False), stops

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, and the offsets of its texts in them. A null text has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        word_of = coded.indices.to_numpy(zero_copy_only=False)
        if self.fold:
            stems, stops = self.folded(coded.dictionary)
            both = self.slots_of(np.concatenate([stems, stops]).tolist())
            slots = np.stack([both[: len(stems)], both[len(stems) :]], axis=1)
        else:
            slots = self.slots_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[:, None]
        counts = self.counts[slots].sum(axis=1)[word_of] if len(word_of) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(ends[-1], np.uint32)
        for at in range(0, len(word_of), GATHERED_WORDS):
            some = slots[word_of[at : at + GATHERED_WORDS]].reshape(-1)
            n = self.counts[some]
            where = np.repeat(self.starts[some] - (np.cumsum(n) - n), n)
            where += np.arange(len(where))
            ids[ends[at] : ends[at] + len(where)] = self.ids[where]
        word_offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return ids, ends[word_offsets]
