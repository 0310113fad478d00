"""Operator 11, BPE encoding and decoding: texts are cut where no vocabulary token can reach across, and the fragments encoded one by one.

A merge only ever builds tokens of the vocabulary. So between two neighbouring symbols that stand next to each other inside no token of it
no merge can happen: a cut there is certain, and what lies between cuts can be encoded by itself, in any order, and concatenated. A
symbol is a byte, or a byte that ends a word; as nothing follows a word's end inside a token, all words are cut apart by the same rule. The
table of pairs has 512 x 512 bits, and is looked up for all bytes of a block at once. Fragments are encoded by merges in order of rank,
leftmost first: short ones many together, a merge of each in every step, and remembered by the worker, about MEMORY of them; long ones from a heap, in n log n steps.

Texts are first split at the special tokens, which stand for themselves; the rest is NFC, white space becomes a space, and every character
is lower-cased by itself. Text is taken in blocks of about BLOCK characters that begin at white space, where none of this reaches across.

One pass, no shuffle: a row's ids need its text only. The driver reads the vocabulary file, whose parts are broadcast (some megabytes, whatever the corpus).

Defined cases: null and empty texts have no ids and decode to an empty string; null ids decode to null; very long texts are encoded whole;
repeated rows are encoded alike; there are no ties, as equal ranks go leftmost first; empty tables give empty results; extra columns are kept, whatever their names, but for those with the
names of the results, which are replaced, and _loom_coded.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

#: Characters of a block; and fragments of at most SHORT bytes that a worker remembers.
BLOCK = 1 << 19
MEMORY, SHORT = 1 << 16, 48
#: What marks the end of a word; and the words of a text.
WORD_END = "</w>"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A byte that UTF-8 never has marks remembered fragments that don't end a word.
INNER = b"\xff"
#: What of a vocabulary file is supported.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
OTHER, SPACE, LETTER, NUMBER = range(4)
NEW = 4
#: Rows of an Arrow batch that are turned into Python's objects at a time.
SLICE = 500
#: The rank of pairs that don't merge.
NONE = (1 << 31) - 1

_space = re.compile(r"[ \n]")


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones of Latin-1 for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [rest.get(b, chr(b)) for b in range(256)]


def character_classes() -> np.ndarray:
    """Of each code point whether it is white space, a letter, a number, or something else; and with NEW on top, whether Python's tables lack it.

    Letters and numbers are those of the pattern engine that the vocabulary's pattern is written for, as its Unicode version isn't Python's.
    """
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for value, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for piece, _ in pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(every):
            out[np.frombuffer(piece.encode("utf-32-le"), np.uint32)] = value
    out[[ord(c) for c in every if unicodedata.category(c) == "Cn"]] |= NEW
    return out


#: Normal forms and lower case of texts with characters that Python's tables lack; slower, and the same for all others.
_newer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


class Vocabulary:
    """Ids, merges, classes of characters and the table of pairs of a byte-level BPE vocabulary with word ends. It is what travels to the workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, pre, form = said["model"], said["pre_tokenizer"] or {}, said["normalizer"] or {}
        own = model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["ignore_merges"] and not model["dropout"] and not model["continuing_subword_prefix"]
        split = [p["pattern"]["Regex"] for p in pre.get("pretokenizers", ()) if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
        plain = all(a["special"] and not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in said["added_tokens"])
        if not own or form.get("normalizers") != NORMALIZERS or split != [WORDS] or not plain or said["decoder"] is not None:
            raise ValueError(f"{path} isn't a lower-casing byte-level BPE vocabulary with word ends")
        ids = model["vocab"]
        letters = byte_letters()
        names = letters + [x + WORD_END for x in letters]
        if missing := [n for n in names if n not in ids]:
            raise ValueError(f"{path} lacks symbols: {missing[:3]}")
        self.special = {a["content"]: a["id"] for a in said["added_tokens"]}
        self.first = [ids[n] for n in names]  # the ids of the 512 symbols
        self.tokens = [""] * (max(*ids.values(), *self.special.values()) + 1)
        for token, i in (ids | self.special).items():
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.classes = character_classes()
        keys = np.array(sorted(self.ranks), np.int64)
        self.keys, self.key_ranks = keys, np.array([self.ranks[k] for k in keys.tolist()], np.int64)
        # symbols that are neighbours inside a token
        byte = {x: b for b, x in enumerate(letters)}
        self.joined = np.zeros((512, 512), bool)
        for token in ids:
            symbols = [byte[c] for c in token.removesuffix(WORD_END)]
            if token.endswith(WORD_END) and symbols:
                symbols[-1] += 256
            self.joined[symbols[:-1], symbols[1:]] = True

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE for those that don't merge."""
        wanted = (left << 20) | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.key_ranks[at], NONE)

    def merged_together(self, fragments: list[list[int]]) -> tuple[bytes, np.ndarray]:
        """The ids of many short fragments after all merges, one after the other as packed integers, and where each ends.

        Every round does the next merge of each fragment that has one, so there are as many rounds as merges in one fragment at most.
        """
        sizes = np.array([len(f) for f in fragments], np.int64)
        ids = np.fromiter((i for f in fragments for i in f), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(sizes)), sizes)
        done = np.zeros(len(ids), np.int64)
        place = np.arange(len(ids))  # where each symbol began; it stays there in the result
        gone = np.zeros(len(ids), bool)
        done[:] = ids
        made = np.array(self.made, np.int64)
        rank = np.full(len(ids), NONE)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), starts)
            at = best[(best >> 32) != NONE] & 0xFFFFFFFF
            ids[at] = made[rank[at]]
            done[place[at]] = ids[at]
            gone[place[at + 1]] = True
            # what was merged goes, and so do fragments without a further merge
            stays = np.zeros(of[-1] + 1, bool)
            stays[of[at]] = True
            keep = stays[of]
            keep[at + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            ids, of, place, rank, changed = ids[keep], of[keep], place[keep], rank[keep], np.flatnonzero(changed[keep])
            if len(ids):
                paired = changed[changed + 1 < len(ids)]
                rank[changed] = NONE
                paired = paired[of[paired] == of[paired + 1]]
                rank[paired] = self._ranks(ids[paired], ids[paired + 1])
        left = ~gone
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[left], minlength=len(sizes)))
        return done[left].astype("<u4").tobytes(), ends


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Coder:
    """Encodes and decodes texts of a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned integers of 32 bits."""
        return self.encode_all([text])[0]

    def encode_all(self, texts) -> list[bytes]:
        """The ids of each text. Texts are taken together up to about BLOCK characters, and long ones in blocks."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for n, text in enumerate(texts):
            for i, part in enumerate(self.special.split(text) if self.special else [text]) if text else ():
                if i % 2:
                    out[n].append(self.v.special[part].to_bytes(4, "little"))
                    continue
                for block in blocks(part):
                    out[n].append(b"")
                    waiting.append((out[n], len(out[n]) - 1, self.normal(block)))
                    size += len(block)
                    if size >= BLOCK:
                        self._place(waiting)
                        waiting, size = [], 0
        self._place(waiting)
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes | None) -> str | None:
        """The ids' tokens with a space between, which is what decoding is without a decoder."""
        return None if ids is None else " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _place(self, waiting: list) -> None:
        """Encodes the normalised texts of (list, place, text) together, a space between, and puts the ids in their places."""
        if not waiting:
            return
        raw, starts, ends, last = self.fragments(" ".join(text for *_, text in waiting))
        pieces = [raw[a:b] if word_end else raw[a:b] + INNER for a, b, word_end in zip(starts.tolist(), ends.tolist(), last.tolist())]
        if len(self.known) >= MEMORY:
            self.known.clear()
        known = self.known
        new = list({p for p in pieces if p not in known})
        known.update(zip(new, self._encoded(new)))
        ids = [known[p] for p in pieces]
        at = np.cumsum([len(text.encode()) + 1 for *_, text in waiting])
        begin = 0
        for (parts, place, _), end in zip(waiting, np.searchsorted(starts, at).tolist()):
            parts[place] = b"".join(ids[begin:end])
            begin = end
        for p in new:
            if len(p) > SHORT:
                del known[p]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if (self.v.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] & NEW).any():
            return _newer(text)
        # characters are lower-cased by themselves: a last sigma isn't another letter
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def fragments(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """A normalised text's bytes; where its fragments begin and end; and whether each one's end is a word's."""
        raw = text.encode()
        if not raw:
            return raw, *np.zeros((3, 0), np.int64)
        kind = self.v.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] & (NEW - 1)
        # a word ends where the class changes, after each number, and after a contraction
        end = np.append(kind[1:] != kind[:-1], True) | (kind == NUMBER)
        for m in re.finditer(r"'(?:[stmd]|re|ve|ll)", text) if "'" in text else ():
            if not m.start() or kind[m.start() - 1] != OTHER:
                end[m.start() : m.end() - 1] = False
                end[m.end() - 1] = True
        octets = np.frombuffer(raw, np.uint8)
        if len(raw) == len(text):
            ends_word, solid = end, kind != SPACE
        else:
            lead = (octets & 0xC0) != 0x80
            of = np.cumsum(lead) - 1
            ends_word, solid = np.append(lead[1:], True) & end[of], (kind != SPACE)[of]
        symbols = octets + ends_word * np.int32(256)
        cut = ~self.v.joined[symbols[:-1], symbols[1:]] | ~solid[:-1] | ~solid[1:]
        at = np.flatnonzero(np.append(cut, True)) + 1  # ends of fragments, white space included
        begin = np.append(0, at[:-1])
        keep = solid[begin]
        return raw, begin[keep], at[keep], ends_word[at[keep] - 1]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each fragment; INNER ends those that don't end a word."""
        out = [b""] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= SHORT]
        flat, ends = self.v.merged_together([self._symbols(pieces[i]) for i in short])
        begin = 0
        for i, end in zip(short, (4 * ends).tolist()):
            out[i] = flat[begin:end]
            begin = end
        for i, p in enumerate(pieces):
            if len(p) > SHORT:
                ids = merged(self._symbols(p), self.v.ranks, self.v.made)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _symbols(self, piece: bytes) -> list[int]:
        first = self.v.first
        if piece[-1:] == INNER:
            return [first[b] for b in piece[:-1]]
        ids = [first[b] for b in piece]
        ids[-1] = first[256 + piece[-1]]
        return ids


def blocks(text: str):
    """The text in parts of about BLOCK characters, each but the first beginning at a space or line feed."""
    at = 0
    while at < len(text):
        found = _space.search(text, at + BLOCK)
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


def merged(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The ids after all merges: the one of lowest rank first, of equal ones the leftmost. The queue holds ranks with places below."""
    n = len(ids)
    queue = [rank << 40 | i for i in range(n - 1) if (rank := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
    if not queue:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapify(queue)
    while queue:
        top = heappop(queue)
        rank, i = top >> 40, top & 0xFFFFFFFFFF
        j = after[i]
        # out of date if either side has been merged since
        if ids[i] < 0 or j >= n or ranks.get(ids[i] << 20 | ids[j]) != rank:
            continue
        new = ids[i] = made[rank]
        ids[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := ranks.get(new << 20 | ids[k])) is not None:
                heappush(queue, found << 40 | i)
        h = before[i]
        if h >= 0 and (found := ranks.get(ids[h] << 20 | new)) is not None:
            heappush(queue, found << 40 | h)
    return [i for i in ids if i >= 0]


_coders: dict = {}


def _coder(shared) -> Coder:
    """The worker's coder of a vocabulary, made once."""
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.value)
    return _coders[shared.id]


def _by_slices(column: pa.Array, kind: pa.DataType, each) -> pa.Array:
    """each() over an Arrow column, SLICE rows at a time: a batch is never whole in Python's objects."""
    parts = [pa.array(each(column.slice(at, SLICE).to_pylist()), kind) for at in range(0, len(column), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


class _Shared:
    """A broadcast vocabulary, and a name for it that is the same in every task."""

    def __init__(self, spark, path: str):
        self.broadcast, self.id = spark.sparkContext.broadcast(vocabulary(path)), path

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with the text's ids as one binary of little-endian unsigned 32-bit integers, never null; and, under the name `decoded`, what decode() makes of these, by the same workers."""
    shared = _Shared(df.sparkSession, path or default_vocabulary())
    kind = pa.struct([("ids", pa.binary()), *([("decoded", pa.string())] if decoded else [])])

    def both(texts: list) -> list[dict]:
        coder = _coder(shared)
        return [{"ids": x, "decoded": coder.decode(x)} if decoded else {"ids": x} for x in coder.encode_all(texts)]

    @F.arrow_udf("ids binary, decoded string" if decoded else "ids binary")
    def encoded(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, kind, both)

    # not deterministic for the optimiser, or every use of the column would encode anew
    got = df.withColumn("_loom_coded", encoded.asNondeterministic()(F.col(text)))
    return got.withColumns({ids: F.col("_loom_coded.ids")} | ({decoded: F.col("_loom_coded.decoded")} if decoded else {})).drop("_loom_coded")


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text that such ids stand for."""
    shared = _Shared(df.sparkSession, path or default_vocabulary())

    @F.arrow_udf("string")
    def decoded(packed: pa.Array) -> pa.Array:
        return _by_slices(packed, pa.string(), lambda some: map(_coder(shared).decode, some))

    return df.withColumn(text, decoded.asNondeterministic()(F.col(ids)))


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, decoded="decoded")
    return coded.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
