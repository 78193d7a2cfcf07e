"""Best-fit packing of token sequences.

Bounded-space online best fit: a packer holds a fixed number of open bins, keyed by their
free space in a bitset, so the tightest bin that still takes a piece is one shift and one
lowest-set-bit away. When a bin too many is open, the fullest closes.

Documents are tokenized in Arrow batches; only the description of each piece (some 40 bytes)
is shuffled, never text. Pieces are dealt at random, each row for itself, to groups of about
``GROUP_TOKENS`` tokens, so no key decides the size of a group and the groups grow in number
with the input; a group is a stream in random order, and each piece is placed as it comes.

Edge cases: null and empty texts are a document of the single end token; documents longer
than a sequence are cut into full pieces and a last one, however long they are; repeated rows
are packed as often as they come, each dealt for itself; of bins that are equally full the
one opened or filled last takes the piece or closes; an empty table gives an empty result; a
null doc_id is kept as null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.llm.common import parts, saved, slim, table

SEQ_LEN = 2048
#: Tokens of one packing group: some 8,000 sequences, beside which its open bins' space is little.
GROUP_TOKENS = 1 << 24
#: Pieces of one packing group at most, for corpora of tiny documents.
GROUP_PIECES = 1 << 18
#: Bins a packer holds open.
OPEN_BINS = 256
#: Runs of letters whose ids a Python worker remembers, and how long they may be.
CACHE_WORDS, LONGEST = 150_000, 64
#: Bytes of text that are tokenized at once.
TEXT_BYTES = 8 << 20

_loaded: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """Byte-pair merges of many words at once: in each round every word makes its best merge."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, description: str):
        model = json.loads(description)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)  # rank by place among the sorted keys
        self.keys, self.made = keys[self.order], np.array([vocab[a + b] for a, b in pairs], np.int32)
        letters = list(_byte_letters().values())
        self.inner, self.last = (np.zeros(512, np.int32) for _ in range(2))
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + end]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], self.NONE)

    def ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers; words are written as byte-level vocabularies do."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols, word = self.inner[codes], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        tails = ends[lengths > 0] - 1
        symbols[tails] = self.last[codes[tails]]
        done_symbols, done_words = [], []
        ranks = np.full(len(symbols), self.NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        ranks[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(word))))
            rest = best == self.NONE  # words that have no merge left
            if rest.any():
                done_symbols.append(symbols[rest])
                done_words.append(word[rest])
                more = ~rest
                symbols, word, ranks, best = symbols[more], word[more], ranks[more], best[more]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == best)
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])]  # the leftmost of equals
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            at = at - np.arange(len(at))  # each merge before has taken one place
            touched = np.concatenate([at, at[at > 0] - 1])
            touched = touched[touched + 1 < len(symbols)]
            same = word[touched] == word[touched + 1]
            ranks[at] = self.NONE
            ranks[touched[same]] = self._ranks(symbols[touched[same]], symbols[touched[same] + 1])
            ranks[touched[~same]] = self.NONE
        if not done_words:
            return [b""] * len(words)
        all_words, flat = np.concatenate(done_words), np.concatenate(done_symbols)
        flat = flat[np.argsort(all_words, kind="stable")].astype(np.uint32).tobytes()
        edges = (4 * np.cumsum(np.concatenate([[0], np.bincount(all_words, minlength=len(words))]))).tolist()
        return [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class WordTokenizer:
    """Ids of whole texts, by way of their distinct words.

    The tokenizer splits at white space before any merge, so a text's ids are its words' ids
    one after the other. A batch's texts are split and their words made distinct in Arrow; a
    word that is a run of Latin letters and then ASCII marks is two units to the tokenizer,
    so its letters go to the merges directly, without normalizing, and are remembered; any
    other word goes to the tokenizer whole.
    """

    #: Letters that lower-case one to one and that NFC keeps, then marks; the apostrophe has rules of its own.
    PLAIN = r"^(?P<letters>[a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
    #: Texts whose ids are put together at once.
    TEXTS = 500

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merges = tokenizer.encode_batch_fast, Merges(tokenizer.to_str())
        self.letters: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.names = _byte_letters()

    def batch(self, own: pa.Array) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is empty."""
        own = own.fill_null("")
        special = pc.match_substring(own, "<|")  # may hold special tokens, which lower-casing would change
        apart = dict(zip(np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist(), self._whole(own.filter(special).to_pylist()), strict=True))
        own = pc.if_else(special, "", own)
        split = pc.ascii_split_whitespace(pc.ascii_lower(own))
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        index = coded.indices.to_numpy()
        written = self._words(coded.dictionary)
        sizes = np.fromiter(map(len, written), np.int64, len(written)) // 4
        flat, starts = np.frombuffer(b"".join(written), np.uint32), np.cumsum(sizes) - sizes
        for at in range(0, len(own), self.TEXTS):
            bounds = offsets[at : at + self.TEXTS + 1]
            part = index[bounds[0] : bounds[-1]]
            n = sizes[part]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(starts[part] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
            edges = (4 * ends[bounds - bounds[0]]).tolist()
            yield from (apart[i] if i in apart else ids[a:b] for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False), at))

    def _whole(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.encode(words, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words."""
        found = pc.extract_regex(words, self.PLAIN)
        letters, marks = found.field("letters").dictionary_encode(), found.field("marks").dictionary_encode()
        runs = letters.dictionary.to_pylist()
        first = [self.letters.get(r) for r in runs]
        new = [i for i, ids in enumerate(first) if ids is None]
        for at in range(0, len(new), 10_000):
            some = [runs[i] for i in new[at : at + 10_000]]
            made = self.merges.ids([r.lower() if r.isascii() else "".join(map(self.names.get, r.lower().encode())) for r in some])
            for i, r, ids in zip(new[at:], some, made, strict=False):
                first[i] = ids
                if len(r) <= LONGEST:
                    if len(self.letters) >= self.cache_words:
                        self.letters.clear()
                    self.letters[r] = ids
        second = self._whole(marks.dictionary.to_pylist())
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(words)
        a, b = letters.indices.fill_null(0).to_numpy().tolist(), marks.indices.fill_null(0).to_numpy().tolist()
        for i in np.flatnonzero(plain).tolist():
            out[i] = first[a[i]] + second[b[i]]
        odd = np.flatnonzero(~plain).tolist()
        for at in range(0, len(odd), 1000):
            some = odd[at : at + 1000]
            for i, ids in zip(some, self._whole([words[i].as_py() for i in some]), strict=True):
                out[i] = ids
        return out

    def ids(self, text: bytes) -> bytes:
        """One text's ids."""
        return next(self.batch(pa.array([text.decode("utf-8", "replace")], pa.string())))


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut at seq_len."""
    end = struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for batch in parts(batches, TEXT_BYTES):
            rows: list[list] = [[] for _ in schema]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tok.batch(batch.column("text").cast(pa.string())), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    own = ids[at : at + 4 * seq_len]
                    for column, value in zip(rows, (doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return slim(docs, "doc_id", "text").mapInArrow(cut, out)


class Packer:
    """Bounded-space online best fit over bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = 0
        self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece; the tightest open bin takes it, else a new one."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        number = own.pop()
        if not own:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack(found: DataFrame, seq_len: int = SEQ_LEN, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...), which must be stored, as two passes read them."""
    total = found.agg(F.sum("length").alias("t"), F.count("*").alias("n")).first()
    groups = max(1, math.ceil((total["t"] or 0) / group_tokens), math.ceil(total["n"] / group_pieces))
    columns = found.columns
    row = F.xxhash64(F.monotonically_increasing_id(), "doc_id", "start", "ids_crc32")  # of a stored table: a repeated task numbers its rows alike
    dealt = found.withColumn("order", row).withColumn("group", F.pmod(F.shiftrightunsigned("order", 20), F.lit(groups)))
    dealt = dealt.repartitionByRange(groups, "group").sortWithinPartitions("group", "order", "doc_id", "start", "ids_crc32")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            ids, offsets = [], []
            for g, length in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, packer = g, Packer(seq_len, open_bins)
                number, offset = packer.place(length)
                ids.append((g << 32) | number)
                offsets.append(offset)
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return dealt.mapInArrow(fit, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Tokenizes and packs documents: one row per piece with its sequence and offset."""
    return pack(saved(pieces(docs, tokenizer, seq_len), "pieces"), seq_len)


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """(sequence_id, ids binary): the packed sequences themselves, at most seq_len ids each."""
    ids = pieces(docs, tokenizer, seq_len, with_ids=True).select("doc_id", "start", "ids_crc32", "ids").dropDuplicates(["doc_id", "start", "ids_crc32"])
    key = [packed[c].eqNullSafe(ids[c]) for c in ("doc_id", "start", "ids_crc32")]
    own = packed.join(ids, key).select("sequence_id", F.struct("offset", "ids").alias("part"))
    joined = F.array_sort(F.collect_list("part"))  # a sequence holds at most seq_len ids
    return own.groupBy("sequence_id").agg(joined.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
