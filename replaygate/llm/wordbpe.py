"""The public word-level BPE vocabulary: its pre-tokens, symbols and merge ranks.

Words (runs without ASCII white space) can be handled one by one, since the
vocabulary's pre-tokenizer drops white space and no token, special string or
Unicode composition spans it. Both places are tested against the library.
"""

from __future__ import annotations

import heapq
import itertools
import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

DEFAULT_VOCABULARY = "word_bpe_49k.json"
NO_RANK = np.int64(1 << 40)
#: Words of printable Latin letters, digits and signs: composed already, and lower-cased character by character.
PLAIN = "^[!-~\u00a1-\u00ac\u00ae-\u024f]+$"
#: Sequences of more symbols are merged one by one, looking only where something changed.
LONG = 1000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return [table[b] for b in range(256)]


class WordVocabulary:
    """Vocabulary, pre-tokenizer and merges of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.bytes = byte_alphabet()
        self.size = max(self.strings) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        right = np.array([self.ids[b] for _, b in pairs], np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.size + right)
        self.pair_keys = (left * self.size + right)[order]
        self.pair_rank = order.astype(np.int64)
        self.left, self.right, self.made = left, right, made
        # rank at which a symbol appears (-1 for the alphabet); merges build on earlier ones
        self.born = np.full(self.size, -1, np.int64)
        self.born[made] = np.arange(len(made))
        if not ((self.born[left] < np.arange(len(made))).all() and (self.born[right] < np.arange(len(made))).all()):
            raise ValueError("a merge uses a symbol that is made later")
        self.symbol = {c: self.ids[c] for c in self.bytes}
        self.last_symbol = {c: self.ids[c + self.end] for c in self.bytes}

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, made)."""
        return {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(self.left, self.right, self.made))}

    def pretokens(self, word: str) -> list[str]:
        """Byte-level pre-tokens of a word without special strings."""
        if word.isprintable():
            if word.isascii():
                return self.pattern.findall(word.lower())
            if max(word) < "ɐ":  # Latin letters, already composed: lower case is per character
                return ["".join([self.bytes[b] for b in p.encode()]) for p in self.pattern.findall(word.lower())]
        text = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, word: str) -> list[tuple[str, int]]:
        """(pre-token, -1) or ("", id of a special string), in order."""
        if "<|" not in word:
            return [(p, -1) for p in self.pretokens(word)]
        out = []
        for piece in self.special_split.split(word):
            if piece in self.special:
                out.append(("", self.special[piece]))
            elif piece:
                out += [(p, -1) for p in self.pretokens(piece)]
        return out

    def pretokenize(self, words) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(offsets, codes, distinct): word i has the pre-tokens
        distinct[codes[offsets[i]:offsets[i + 1]]]; a special string stands for itself
        behind a line feed, which no pre-token holds. `words`: a list or an Arrow array.

        Plain words are split by one pass of the pattern over all of them: they hold
        no white space, and the pattern leaves out nothing else, so lengths tell
        which pre-tokens are whose."""
        words = pa.array(words, pa.string()) if isinstance(words, list) else words.cast(pa.string())
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        own = words.filter(pa.array(plain))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_py()
        low = joined.lower()
        if len(low) == len(joined):
            lengths = pc.utf8_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            lengths = np.fromiter(map(len, low.split("\n")), np.int64, len(own))
        found = self.pattern.findall(low)
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if (stops[-1] if len(stops) else 0) != lengths.sum():
            raise ValueError("the pattern leaves out characters of plain words")
        until = np.searchsorted(stops, np.cumsum(lengths)) + 1
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.diff(until, prepend=0)
        coded = pa.array(found, pa.string()).dictionary_encode()
        distinct = [p if p.isascii() else "".join([self.bytes[b] for b in p.encode()]) for p in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        odd = np.flatnonzero(~plain)
        if len(odd):
            rows = [[p if special < 0 else "\n" + self.strings[special] for p, special in self.parts(w)] for w in words.take(pa.array(odd)).to_pylist()]
            counts[odd] = [len(r) for r in rows]
            number = {p: i for i, p in enumerate(distinct)}
            extra = np.array([number.setdefault(p, len(number)) for r in rows for p in r], np.int64)
            distinct = list(number)
            order = np.repeat(plain, counts)
            flat = np.empty(len(order), np.int64)
            flat[order], flat[~order] = codes, extra
            codes = flat
        return np.concatenate([[0], np.cumsum(counts)]), codes, distinct

    def special_id(self, pretoken: str) -> int:
        """The id of a special string that pretokenize() gave, else -1."""
        return self.special[pretoken[1:]] if pretoken[0] == "\n" else -1

    def library_ids(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, sizes) by the library's own merging."""
        tokenize, special = self.library.model.tokenize, self.special_id
        rows = [[t.id for t in tokenize(p)] if p[0] != "\n" else [special(p)] for p in pretokens]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes

    def symbols(self, pretoken: str) -> list[int]:
        return [self.symbol[c] for c in pretoken[:-1]] + [self.last_symbol[pretoken[-1]]]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NO_RANK where the vocabulary has no such merge."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], NO_RANK)


@lru_cache(maxsize=1)
def load(path: str) -> WordVocabulary:
    return WordVocabulary(path)


def merge_long(vocab: WordVocabulary, symbols: list[int]) -> list[int]:
    """The same merging of one long sequence: rank after rank, all occurrences of
    the rank's pair from left to right. A merge makes pairs of later ranks only, so
    each rank is taken once, and only the neighbours of merges are looked at again."""
    sym, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = vocab.ranks(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64))
    places: dict[int, list[int]] = {}
    for i, r in zip(np.flatnonzero(ranks < NO_RANK).tolist(), ranks[ranks < NO_RANK].tolist()):
        places.setdefault(r, []).append(i)
    order = list(places)
    heapq.heapify(order)
    merges, left, right, made = vocab.merges, vocab.left, vocab.right, vocab.made
    while order:
        r = heapq.heappop(order)
        a, b, c = int(left[r]), int(right[r]), int(made[r])
        for i in sorted(places.pop(r)):
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = c, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            h = before[i]
            for at, pair in ((h, (sym[h], c)) if h >= 0 else (-1, None), (i, (c, sym[k])) if k < n else (-1, None)):
                new = merges.get(pair) if pair else None
                if new is not None:
                    if new[0] not in places:
                        places[new[0]] = []
                        heapq.heappush(order, new[0])
                    places[new[0]].append(at)
    return [s for s in sym if s >= 0]


def merge_all(vocab: WordVocabulary, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(flat, sizes) after merging: short rows in rounds together, long ones on their own."""
    short = [r for r in rows if len(r) <= LONG]
    sizes = np.fromiter(map(len, short), np.int64, len(short))
    flat, sizes = merge_synchronously(vocab, np.fromiter(itertools.chain.from_iterable(short), np.int64, int(sizes.sum())), sizes)
    if len(short) == len(rows):
        return flat, sizes
    parts = iter(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    out = [next(parts) if len(r) <= LONG else np.array(merge_long(vocab, r), np.int64) for r in rows]
    return np.concatenate(out), np.array([len(o) for o in out], np.int64)


def merge_synchronously(vocab: WordVocabulary, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair merging of many symbol sequences at once.

    `flat` holds the sequences end to end, `sizes` their lengths (all > 0). In
    each round every unfinished sequence merges all occurrences of its own
    lowest-ranked pair (left to right, not overlapping); a sequence without a
    mergeable pair leaves the working arrays. Returns (flat, sizes) after it.
    """
    n = len(sizes)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(n)
    while len(live):
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(flat), NO_RANK)
        if len(flat) > 1:
            rank[:-1] = vocab.ranks(flat[:-1], flat[1:])
        rank[starts + sizes - 1] = NO_RANK  # no pair reaches into the next sequence
        lowest = np.minimum.reduceat(rank, starts)
        open_ = lowest < NO_RANK
        if not open_.all():
            keep = np.repeat(open_, sizes)
            done.append((live[~open_], sizes[~open_], flat[~keep]))
            live, sizes, flat, rank, lowest = live[open_], sizes[open_], flat[keep], rank[keep], lowest[open_]
            if not len(live):
                break
        hit = rank == np.repeat(lowest, sizes)
        at = np.arange(len(flat))
        first = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
        hit &= (at - first) % 2 == 0  # a run of one symbol: every second pair
        gone = np.concatenate([[False], hit[:-1]])
        flat = np.where(hit, vocab.made[np.minimum(rank, len(vocab.made) - 1)], flat)[~gone]
        owner = np.repeat(np.arange(len(live)), sizes)
        sizes = np.bincount(owner[~gone], minlength=len(live))
    if not done:
        return flat, sizes
    rows = np.concatenate([d[0] for d in done])
    size = np.concatenate([d[1] for d in done])
    data = np.concatenate([d[2] for d in done])
    order = np.argsort(rows, kind="stable")
    starts = np.cumsum(size) - size
    size_in = size[order]
    out = np.cumsum(size_in) - size_in
    take = np.arange(len(data)) + np.repeat(starts[order] - out, size_in)
    return data[take], size_in
