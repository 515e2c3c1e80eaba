"""Token ids of a whole corpus by a public byte-level BPE.

The corpus's frequent words (pieces of the splitting pattern) are compiled into a minimal acyclic transducer: an automaton
over their bytes that shares prefixes and suffixes and sums outputs along a path to the word's number, which leads to its
ids. It is written once to the shared folder and memory-mapped by all tasks of a machine (broadcast where the
folder can't be mounted). Distinct words of a batch walk it
together, one byte at a time, in NumPy. Words it does not hold are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from marchland.session import mounted, new_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON_WORDS = 50_000
WORD_BYTES = 64
FLUSH_WORDS = 200_000
#: Fixed value: the splitting pattern of the vocabulary, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _splitter():
    import regex

    return regex.compile(PATTERN).findall


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: a fixed table, read where the driver runs and sent to the tasks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merger:
    """Exact merges of one word by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.ranks = ranks
        self._long = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def ids(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        return self._long._encode_single_piece(word)


class Transducer:
    """Arrays of the automaton: transitions as sorted keys state * 256 + byte with target and output, final states, and the
    ids of each word number."""

    FIELDS = ("keys", "target", "output", "final", "offsets", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """Words must be distinct; they are added in byte order, and finished states are shared with equal ones."""
        order = sorted(range(len(words)), key=words.__getitem__)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]

        def finish(depth: int, word: bytes) -> None:
            for i in range(len(path) - 1, depth, -1):
                state = path[i]
                mark = (final[state], tuple(edges[state].items()))
                same = register.setdefault(mark, state)
                if same != state:
                    edges[path[i - 1]][word[i - 1]] = same
            del path[depth + 1 :]

        last = b""
        for k in order:
            word = words[k]
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            finish(common, last)
            for byte in word[common:]:
                edges.append({}), final.append(False)
                edges[path[-1]][byte] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = word
        finish(0, last)
        # number the states that are left, count the words below each, and sum the counts of smaller transitions
        number, stack, count = {0: 0}, [0], {}
        while stack:
            for t in edges[stack.pop()].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        todo = [(0, False)]
        while todo:
            s, ready = todo.pop()
            if s in count:
                continue
            if ready:
                count[s] = int(final[s]) + sum(count[t] for t in edges[s].values())
            else:
                todo.append((s, True))
                todo += [(t, False) for t in edges[s].values() if t not in count]
        rows = []
        for s, at in number.items():
            below = int(final[s])
            for byte, t in sorted(edges[s].items()):
                rows.append((at * 256 + byte, number[t], below))
                below += count[t]
        rows.sort()
        flags = np.zeros(len(number), bool)
        flags[[at for s, at in number.items() if final[s]]] = True
        sizes = np.array([len(ids[k]) for k in order], np.int64)
        flat = np.array([i for k in order for i in ids[k]], np.int32)
        table = np.array(rows, np.int64).reshape(-1, 3)
        return cls(keys=table[:, 0], target=table[:, 1], output=table[:, 2], final=flags, offsets=np.append(0, np.cumsum(sizes)), ids=flat)

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for name in self.FIELDS:
            np.save(os.path.join(folder, name + ".npy"), getattr(self, name))

    @classmethod
    def load(cls, folder: str) -> Transducer:
        return cls(**{name: np.load(os.path.join(folder, name + ".npy"), mmap_mode="r") for name in cls.FIELDS})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it is not held."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((sizes > 0) & (sizes <= WORD_BYTES))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            key = state[live] * 256 + text[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            total[live] += self.output[at]
            depth += 1
            ended = sizes[live] == depth
            done = live[ended]
            hit = done[self.final[state[done]]]
            out[hit] = total[hit]
            live = live[~ended]
        return out


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each piece of the pattern occurs in the corpus, those of at most WORD_BYTES bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(), Counter()

        def out() -> pa.RecordBatch:
            short = [(w, n) for w, n in seen.items() if len(w) <= WORD_BYTES and len(w.encode()) <= WORD_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(split(t))
            if len(seen) > FLUSH_WORDS:
                yield out()
                seen.clear()
        yield out()

    return texts.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame, ranks: dict[bytes, int], text: str = "text", words: int = LEXICON_WORDS) -> Transducer:
    """The ``words`` most frequent words (ties by code point) compiled on the driver: at most words × WORD_BYTES bytes."""
    top = [r["word"] for r in word_counts(texts, text).where("n > 1").orderBy(F.desc("n"), "word").limit(words).select("word").collect()]
    merge = Merger(ranks)
    raw = [w.encode() for w in top]
    return Transducer.build(raw, [merge.ids(w) for w in raw])


def _placed(spark, built: Transducer):
    """Where tasks find the transducer: a folder to map where the shared folder is a mounted one, else the arrays themselves."""
    folder = mounted(spark, new_path(spark, "lexicon"))
    if folder is not None:
        built.save(folder)
        return folder, None
    return None, spark.sparkContext.broadcast({name: getattr(built, name) for name in Transducer.FIELDS})


def _opened(folder: str | None, arrays) -> Transducer:
    if folder is not None:
        return Transducer.load(folder)
    return Transducer(**arrays.value)  # a store that can't be mapped: the arrays came with the task


def encode_batch(texts: list[str | None], split, held: Transducer, merge: Merger) -> tuple[np.ndarray, np.ndarray]:
    """(end of each text's ids, all ids)."""
    codes: dict[str, int] = {}
    per_text, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            mine = [codes.setdefault(w, len(codes)) for w in split(t)]
            per_text.append(np.array(mine, np.int64))
            sizes[i] = len(mine)
    if not codes:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
    raw = [w.encode() for w in codes]
    number = held.numbers(raw)
    unseen = {i: merge.ids(raw[i]) for i in np.flatnonzero(number < 0)}
    length = np.empty(len(raw), np.int64)
    known = number >= 0
    length[known] = held.offsets[number[known] + 1] - held.offsets[number[known]]
    extra = np.array([x for ids in unseen.values() for x in ids], np.int32)
    start = np.empty(len(raw), np.int64)
    start[known] = held.offsets[number[known]]
    if unseen:
        n = np.fromiter(map(len, unseen.values()), np.int64, len(unseen))
        length[list(unseen)] = n
        start[list(unseen)] = len(held.ids) + np.cumsum(n) - n
    pool = np.concatenate([held.ids, extra])
    words = np.concatenate(per_text)
    reps = length[words]
    at = np.repeat(start[words] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    ends = np.append(0, np.cumsum(reps))[np.append(0, np.cumsum(sizes))]
    return ends, pool[at]


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS, ids: str = "ids") -> DataFrame:
    """All rows and columns of ``df`` and their token ids, without special tokens, in the column ``ids``.

    An empty text and a null text have the empty list. The strings of special tokens are ordinary text. A column that is
    already called ``ids`` is replaced. Whole texts are encoded, however long; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ranks = read_ranks(vocabulary)
    folder, arrays = _placed(spark, lexicon(df, ranks, text, words))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, merge = _splitter(), _opened(folder, arrays), Merger(shared.value)
        for b in batches:
            kept = [i for i, c in enumerate(b.schema.names) if c != ids]
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                ends, flat = encode_batch(part.column(part.schema.get_field_index(text)).to_pylist(), split, held, merge)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], lists], [*[b.schema.names[i] for i in kept], ids])

    fields = [f for f in df.schema.fields if f.name != ids]
    return df.mapInArrow(run, StructType([*fields, StructField(ids, ArrayType(IntegerType(), False))]))


def token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS, tokens: str = "tokens") -> DataFrame:
    """All rows and columns of ``df`` and their number of tokens; null and empty texts have none."""
    return encode(df, text, vocabulary, words, "_ids").withColumn(tokens, F.size("_ids").cast("long")).drop("_ids")
