"""SentencePiece (BPE) encoding and decoding in vectorised merge rounds.

Encoding lays the distinct words of a slice out as one flat array of symbols. A round finds
the rank of every adjacent pair, the smallest rank of each word, merges its leftmost
non-overlapping occurrences at once and compacts the array; words without a known pair leave.
An occurrence whose merge would open a pair of at most the same rank ends the round for its
word, so the order of merges is the one-at-a-time order of the library.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftline.llm.common import append_columns

SPACE = "▁"
_SHIFT = np.int64(1 << 21)
_SPREAD, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 19
_NONE = np.int32(2**31 - 1)


class PieceModel:
    """Tables of a BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.end_id, self.unknown_id = sp.eos_id(), sp.unk_id()
        text = [sp.id_to_piece(i) for i in range(self.size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.size)]
        self.byte_ids = np.full(256, -1, np.int32)
        plain: dict[str, int] = {}
        surface: list[bytes] = []
        self.is_byte = np.zeros(self.size, bool)
        for i, piece in enumerate(text):
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = True
                surface.append(bytes([value]))
            elif special[i]:
                surface.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
            else:
                plain[piece] = i
                surface.append(piece.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.numerals = [str(i).encode() for i in range(self.size)]
        self.silent = np.array([sp.is_control(i) for i in range(self.size)])
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_size)[:-1]])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.leads = np.array([s.startswith(b" ") and not special[i] and not self.is_byte[i] for i, s in enumerate(surface)])

        scores = {i: sp.get_score(i) for i in plain.values()}
        places = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        runs = {len(p): i for p, i in plain.items() if not p.strip(SPACE)}
        self.longest_run, self.space_id = max(runs), plain[SPACE]
        last = [p for p in plain if len(p) > 1 and p.strip(SPACE)]
        floor = min(scores[plain[p]] for p in last)
        if any(SPACE in p[1:] for p in last) or any(scores[runs[n]] >= floor for n in runs if n > 1):
            raise ValueError("only models whose runs of spaces come last and whole are supported")

        self.of_char = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in plain.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        pairs = []
        for piece in (p for p in plain if len(p) > 1):
            for k in range(1, len(piece)):
                a, b = self._symbol(plain, piece[:k]), self._symbol(plain, piece[k:])
                if a >= 0 and b >= 0:
                    i = plain[piece]
                    pairs.append((a * int(_SHIFT) + b, places[scores[i]], i))
        pairs = [(-1, 0, 0), *sorted(pairs)]  # entry 0 stands for an empty slot
        self.pair_key, rank, merged = (np.array(x) for x in zip(*pairs))
        self.pair_rank, self.pair_id = rank.astype(np.int32), merged.astype(np.int32)
        self._place()
        # a long run of spaces becomes its longest pieces from the left, then what the rest becomes
        runs_of = [*range(self.longest_run), 3 * self.longest_run]
        flat, first, size = self.merge([SPACE * n for n in runs_of])
        *self.rest_of_run, three = (flat[a : a + n] for a, n in zip(first, size))
        if three.tolist() != [runs[self.longest_run]] * 3:
            raise ValueError("only models whose longest run of spaces is reached from the left are supported")
        self.longest_id = three[0]

    def _place(self) -> None:
        """Open addressing from a pair's key to its entry; a search goes on until an empty slot."""
        self.slots = np.zeros((1 << _SLOT_BITS) + len(self.pair_key), np.int64)
        home = (self.pair_key.astype(np.uint64) * _SPREAD >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.probes = 0
        for entry in range(1, len(home)):
            slot = home[entry]
            while self.slots[slot]:
                slot += 1
            self.slots[slot] = entry
            self.probes = max(self.probes, int(slot - home[entry]))

    def _symbol(self, plain: dict[str, int], piece: str) -> int:
        return int(self.of_char[ord(piece)]) if len(piece) == 1 else plain.get(piece, -1)

    # ------------------------------------------------------------ encoding

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * _SHIFT + right
        slot = (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at = self.slots[slot]
        known = self.pair_key[at] == key
        for _ in range(self.probes):
            miss = np.flatnonzero(~known & (at > 0))
            if not len(miss):
                break
            slot[miss] += 1
            at[miss] = self.slots[slot[miss]]
            known[miss] = self.pair_key[at[miss]] == key[miss]
        return np.where(known, self.pair_rank[at], _NONE), at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words as one array, and each word's first place and number in it.

        The words hold no space symbol but at their start.
        """
        first, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words], np.int64)
        name = np.flatnonzero(size)
        size = size[name]
        symbols = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        out, filled = [np.zeros(0, np.int32)], 0
        word = np.repeat(np.arange(len(name)), size)
        n = len(symbols)
        rank, at = np.full(n, _NONE, np.int32), np.zeros(n, np.int64)
        fresh = np.flatnonzero(word[1:] == word[:-1]) if n > 1 else np.zeros(0, np.int64)
        while len(name):
            rank[fresh], at[fresh] = self._ranks(symbols[fresh], symbols[fresh + 1])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            least = np.minimum.reduceat(rank, starts)
            over = least == _NONE
            if over.any():  # no pair left: these words are done
                gone = over[word]
                first[name[over]] = filled + np.concatenate([[0], np.cumsum(size[over])[:-1]])
                number[name[over]] = size[over]
                out.append(symbols[gone])
                filled += len(out[-1])
                name, size, least = name[~over], size[~over], least[~over]
                symbols, rank, at = symbols[~gone], rank[~gone], at[~gone]
                word = np.repeat(np.arange(len(name)), size)
                if not len(name):
                    break
            n = len(symbols)
            # leftmost occurrences: every second one of a run of touching pairs
            best = rank == least[word]
            spot = np.flatnonzero(best)
            opens = np.concatenate([[True], (np.diff(spot) > 1) | (word[spot[1:]] != word[spot[:-1]])])
            place = np.arange(len(spot))
            spot = spot[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
            made, own = self.pair_id[at[spot]], word[spot]
            # a merge that opens a pair of at most this rank is the last one of its word in this round
            became = symbols.copy()
            became[spot] = made
            joined = np.zeros(n + 1, bool)
            joined[spot + 1] = True
            before, after = np.maximum(spot - 1, 0), np.minimum(spot + 2, n - 1)
            left = np.where(joined[before], became[np.maximum(spot - 2, 0)], symbols[before])
            l_rank, r_rank = self._ranks(left, made)[0], self._ranks(made, symbols[after])[0]
            l_rank[(spot == 0) | (word[before] != own)] = _NONE
            r_rank[(spot + 2 >= n) | (word[after] != own)] = _NONE
            stops = np.minimum(l_rank, r_rank) <= least[own]
            if stops.any():
                limit = np.full(len(name), n, np.int64)
                np.minimum.at(limit, own[stops], spot[stops])
                held = spot <= limit[own]
                spot, made, own = spot[held], made[held], own[held]
            symbols[spot] = made
            keep = np.ones(n, bool)
            keep[spot + 1] = False
            spot -= np.arange(len(spot))  # places after the compaction
            symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
            size = size - np.bincount(own, minlength=len(name))
            rank[spot] = _NONE
            fresh = np.concatenate([spot, spot[spot > 0] - 1])
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
        return np.concatenate(out), first, number

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Symbols that are no pieces become the byte pieces of their character."""
        out: list[int] = []
        for i in ids.tolist():
            out.extend([i] if i < self.size else self.byte_ids[list(chr(i - self.size).encode())].tolist())
        return np.array(out, np.int32)

    def _run(self, n: int) -> np.ndarray:
        whole, rest = divmod(n, self.longest_run)
        return np.concatenate([np.full(whole, self.longest_id, np.int32), self.rest_of_run[rest]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed by the end id, and the offsets."""
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        number = index.__getitem__
        chains: list[list[int]] = []
        for t in texts:
            if not t:
                chains.append([])
                continue
            body = t.replace(" ", SPACE)
            if SPACE * 2 in body or body[0] == SPACE or body[-1] == SPACE:
                chains.append([number(x[1:]) for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + body)])
            else:
                chains.append(list(map(number, body.split(SPACE))))
        words = list(index)
        flat, first, size = self.merge([SPACE + w.lstrip(SPACE) for w in words])
        odd = {i for i, w in enumerate(words) if w[:1] == SPACE}
        if len(strange := np.flatnonzero(flat >= self.size)):
            order = np.argsort(first)
            odd.update(order[np.searchsorted(first[order], strange, side="right") - 1].tolist())
        extra, filled = [], len(flat)
        for i in sorted(odd):
            ids, lead = self._bytes(flat[first[i] : first[i] + size[i]]), len(words[i]) - len(words[i].lstrip(SPACE))
            if lead:
                alone = int(len(ids) > 0 and ids[0] == self.space_id)
                ids = np.concatenate([self._run(lead + alone), ids[alone:]])
            extra.append(ids)
            first[i], size[i] = filled, len(ids)
            filled += len(ids)
        flat = np.concatenate([flat, *extra, [self.end_id]]).astype(np.int32)
        first, size, end = np.append(first, filled), np.append(size, 1), len(words)
        chain = np.fromiter((i for keys in chains for i in (*keys, end)), np.int64)
        ids = flat[_ranges(first[chain], size[chain])]
        ends = np.concatenate([[0], np.cumsum(size[chain])])
        return ids, ends[np.concatenate([[0], np.cumsum([len(k) + 1 for k in chains], dtype=np.int64)])]

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id sequences ids[offsets[i]:offsets[i + 1]]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id out of range")
        size = self.surface_size[ids]
        data = self.surface[_ranges(self.surface_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            piece = data[ends[a] : ends[b]]
            heard = ids[a:b][~self.silent[ids[a:b]]][:1]
            if len(heard) and self.leads[heard[0]]:
                piece = piece[1:]
            try:
                out.append(piece.decode())
            except UnicodeDecodeError:
                out.append(self._decode_broken(ids[a:b].tolist()))
        return out

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte pieces that are no UTF-8 become one replacement character each."""
        out, held, first = [], b"", True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                held += bytes(self.surface[self.surface_at[i] : self.surface_at[i] + 1])
                first = False
                continue
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[:n].decode())
                        held = held[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    held = held[1:]
            if i is None or self.silent[i]:
                continue
            s = bytes(self.surface[self.surface_at[i] : self.surface_at[i] + self.surface_size[i]]).decode()
            out.append(s[1:] if first and self.leads[i] else s)
            first = False
        return "".join(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges starts[i] .. starts[i] + sizes[i], in order."""
    total = int(sizes.sum())
    shift = starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts
    return np.arange(total) + np.repeat(shift, sizes)


def _shared(df: DataFrame, model_file: str):
    """The model's tables, of a size that the vocabulary fixes, on every executor."""
    return df.sparkSession.sparkContext.broadcast(PieceModel(model_file))


def encode(df: DataFrame, model_file: str, column: str = "text", into: str = "ids") -> DataFrame:
    """Adds `into`: the ids of each whole text, closed by the end id.

    A null or empty text has the end id alone. A column of that name is replaced; rows,
    repeated ones included, and all other columns stay as they are.
    """
    model = _shared(df, model_file)

    def make(texts: list[str | None]) -> list:
        ids, offsets = model.value.encode(texts)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    return append_columns(df, column, make, [T.StructField(into, T.ArrayType(T.IntegerType(), True))])


def decode(df: DataFrame, model_file: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds `into`: the text of each id sequence.

    Null sequences decode to null, empty ones to the empty text. Ids outside the vocabulary
    are an error.
    """
    model = _shared(df, model_file)
    kept = df.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                lists = batch.column(column)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                texts = model.value.decode(ids, np.concatenate([[0], np.cumsum(size)]))
                missing = lists.is_null().to_numpy(zero_copy_only=False)
                made = pa.array([None if gone else t for t, gone in zip(texts, missing)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def digests(documents: DataFrame, model_file: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns to keep (ids among them), number of ids, digests of the ids and the decoded text.

    A slice is encoded, decoded and digested in one pass, so that a task has one Python worker.
    """
    model = _shared(documents, model_file)
    carried = [c for c in keep if c != "ids"]

    def make(texts: list[str | None]) -> list:
        ids, offsets = model.value.encode(texts)
        shown = [model.value.numerals[i] for i in ids.tolist()]
        made = [hashlib.sha256(b" ".join(shown[a:b])).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        text = [hashlib.sha256(t.encode()).hexdigest() for t in model.value.decode(ids, offsets)]
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))] if "ids" in keep else []
        return [*lists, pa.array(np.diff(offsets), pa.int64()), made, text]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), True))] if "ids" in keep else []
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    coded = append_columns(documents.select("doc_id", "text", *carried), "text", make, fields)
    return coded.select("doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256")
