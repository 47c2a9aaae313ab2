"""Byte-level BPE with a public vocabulary: frequent words through a transducer, others by merges.

All words of the corpus are counted; the most frequent ones and their ids are compiled into a
minimal acyclic transducer (``lexicon``), which is broadcast - its size is bounded by the number
of words - and memory-mapped by the Python workers. Words outside it are merged exactly. Texts
are not shuffled; the only shuffle is that of the word counts.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, trimmed, whole_texts
from .lexicon import Lexicon, compile_lexicon

LEXICON_WORDS = 262_144
LONGEST_WORD = 48  # bytes; longer words are merged
MEMO_WORDS = 200_000  # words that a worker remembers between lookups
TEXTS_AT_ONCE = 128
COUNTED_AT_ONCE = 400_000  # distinct words counted before they are handed on
NEVER = 1 << 40  # the rank of pairs that are not merged
#: Fixed value: how byte-level BPE splits text before it merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII and Latin letters only, where the classes are short lists.
_LETTER, _SPACE = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", " \t\n\r\x0b\x0c"
PLAIN_WORDS = rf" ?[{_LETTER}]++| ?[0-9]++|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}{_LETTER}0-9]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
BEYOND_PLAIN = f"[^\x00-\x1b\x20-\x7e{_LETTER}]"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others get characters from 256 on in turn."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table by ids, byte ids and the bytes of every id; plain data that can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, bytes_of = spec["model"]["vocab"], {c: b for b, c in byte_symbols().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.single = [ids[c] for _, c in sorted(byte_symbols().items())]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [ids[a + b] for a, b in pairs]
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in ids.items():
            self.bytes[i] = bytes(bytes_of[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()

    def merge_word(self, word: bytes) -> bytes:
        """Ids of one word, packed: the pair of lowest rank, leftmost first, is merged until no
        pair is in the table. A heap keeps a word of n bytes at n log n steps."""
        single, rank = self.single, self.rank.get
        ids = [single[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        ranks = [rank(a << 32 | b, NEVER) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], NEVER)
        return pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int]) -> bytes:
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(ids) and (m := self.rank.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[j], self.made[m]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def _cut(vocabulary: Vocabulary):
    """A function from text to words; special tokens come as words of their own."""
    general, plain, beyond = regex.compile(WORDS).findall, re.compile(PLAIN_WORDS).findall, re.compile(BEYOND_PLAIN).search

    def find(text: str) -> list[str]:
        return general(text) if beyond(text) else plain(text)

    if not vocabulary.special:
        return find
    special = re.compile("(" + "|".join(re.escape(t) for t in sorted(vocabulary.special, key=len, reverse=True)) + ")")

    def cut(text: str) -> list[str]:
        if not special.search(text):
            return find(text)
        return [w for i, part in enumerate(special.split(text)) for w in ([part] if i % 2 else find(part))]

    return cut


def word_counts(docs: DataFrame, shared: Broadcast, text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts, counted map-side before the shuffle; ``shared`` is the vocabulary."""
    whole_texts(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = _cut(shared.value), Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py() or ""))
                if len(seen) >= COUNTED_AT_ONCE:
                    yield handed()
        yield handed()

    return docs.select(text_col).mapInArrow(trimmed(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, shared: Broadcast, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The most frequent words of all texts, ``words`` at most, compiled; ``shared`` is the vocabulary. Counts are
    ranked by classes of a sixteenth of a doubling: a class is taken whole or not. One task compiles the
    words taken, as many as ``words`` bounds, so the driver gets a small histogram and the finished
    automaton, whatever the number of partitions."""
    kind = F.floor(F.log2("n") * 16).cast("int")
    counts = word_counts(docs, shared, text_col).filter((F.octet_length("word") <= LONGEST_WORD) & (F.col("n") > 1))
    counts = stored(counts.select("word", kind.alias("class")), "words")
    taken, least = 0, None
    for r in sorted(counts.groupBy("class").count().collect(), reverse=True):
        if (taken := taken + r["count"]) > words:
            break
        least = r["class"]
    if least is None:
        return compile_lexicon({})

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        top = [t for batch in batches for t in batch.column(0).to_pylist()]
        data = compile_lexicon({w: vocabulary.merge_word(w) for t in top if t not in vocabulary.special for w in [t.encode()]})
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["lexicon"])

    one = counts.filter(F.col("class") >= least).select("word").repartition(1)  # many tasks read the counts, one gets the words taken
    return bytes(one.mapInArrow(trimmed(compiled), "lexicon binary").first()[0])


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    words: int = LEXICON_WORDS,
    round_trip: bool = False,
) -> DataFrame:
    """``carry`` columns, ``n_tokens long, token_ids binary`` (little-endian unsigned 32 bit), one
    row per row of ``docs``; with ``round_trip`` also ``decoded``, as ``decode`` makes it from the
    ids, in the same pass.

    Special tokens of the vocabulary that stand in a text become their ids, none are added.
    Null and empty texts have no tokens; a very long word is merged with a heap; repeated rows,
    null ids and an empty table need nothing special; other columns are ignored. The session's
    Arrow batches stay small afterwards, see ``whole_texts``: the result may be read at any time.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))
    automaton = spark.sparkContext.broadcast(build_lexicon(docs, shared, text_col, words))
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        lexicon, cut = Lexicon.from_bytes(automaton.value), _cut(vocabulary)
        specials = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.special.items()}
        memo: dict[str, bytes] = dict(specials)

        def learn(new: list[str]) -> None:
            raw = [w.encode() for w in new]
            for w, b, found in zip(new, raw, lexicon.find(raw), strict=True):
                memo[w] = vocabulary.merge_word(b) if found is None else found

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column(part.num_columns - 1).to_pylist()
                split = [cut(t) if t else [] for t in texts]
                if len(memo) > MEMO_WORDS:
                    memo = dict(specials)
                distinct = set().union(*split)
                learn([w for w in distinct if w not in memo])
                ids = [b"".join(map(memo.__getitem__, words)) for words in split]
                columns = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())}
                if round_trip:
                    columns["decoded"] = _texts(ids, vocabulary.bytes)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns.values()], [*part.schema.names[:-1], *columns])

    kept = docs.select(*carry, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    more = ", decoded string" if round_trip else ""
    return kept.mapInArrow(trimmed(run), f"{schema}{', ' if schema else ''}n_tokens long, token_ids binary{more}")


def _texts(ids: list[bytes], bytes_of: list[bytes]) -> pa.Array:
    """Packed ids to text; bytes that are not UTF-8 become U+FFFD."""
    pick = bytes_of.__getitem__
    return pa.array([b"".join(map(pick, array("I", x))).decode("utf-8", "replace") for x in ids], pa.string())


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` with ``decoded string`` beside all other columns, in place of one of that name;
    special tokens are kept, bytes that are not UTF-8 become U+FFFD. Null ids are no tokens and
    decode to an empty text, as empty ones do; very long ones, repeated rows, null documents and
    an empty table need nothing special. The session's Arrow batches stay small afterwards, see
    ``whole_texts``: the result may be read at any time."""
    whole_texts(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path).bytes)
    others = [c for c in encoded.columns if c not in ("token_ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = _texts(part.column(part.num_columns - 1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    src = encoded.select(*others, F.coalesce("token_ids", F.lit(b"")).alias("token_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(trimmed(run), f"{schema}, decoded string")
