"""Byte-pair encoding with segment trees over adjacent pair ranks, and decoding.

A word's adjacent pairs are the leaves of a tree of minima. A leaf holds
``rank * leaves + place``, so the root is the leftmost pair of the lowest
rank. A merge changes three leaves, each with a logarithmic update, until the
root holds no pair. The words of a batch that need as many leaves are merged
together: one row of an array per word.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.recent import Recent
from rowferry.plans.session import ship_package

#: Words in a generation of a worker's memory.
CACHED_WORDS = 100_000
#: Characters of the texts whose new words are merged together, and ids in a batch that goes back to Spark.
BATCH_CHARS, BATCH_IDS = 500_000, 500_000
#: Rows of an Arrow batch that are turned into Python objects together.
ROWS = 500
#: Words of more bytes than this are merged one by one.
WIDEST = 64

_NO_PAIR = np.int64(1) << 40

# Where the Unicode tables of Python and of its ``regex`` module differ from those of the tokenizers library.
#: Code points that are letters or numbers in ``regex`` and neither in the library.
NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Code points that have a lower case in the library only: first, last, and what the first becomes.
LOWER_CASE = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)

_LOWERED = {code: code - first + target for first, last, target in LOWER_CASE for code in range(first, last + 1)}
_RARE_LETTERS = "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in NO_LETTERS)
_RARE = regex.compile(f"[{_RARE_LETTERS}" + "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last, _ in LOWER_CASE) + "]")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _latin(text: str) -> bool:
    """Whether no code point is above 255: a copy, where a search for rare ones looks at each."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Vocabulary:
    """A tokenizer file: lower-casing byte-level BPE with a suffix at word ends.

    Letters, numbers and lower case are the library's: those of the installed
    Unicode tables but for the code points listed above.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        characters = _byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in characters], np.int64)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.merged = np.array([vocab[left + right] for left, right in pairs], np.int64)
        keys = np.array([(vocab[left] << 32) | vocab[right] for left, right in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in chain(vocab.items(), self.special.items()):
            self.tokens[number] = token
        self.token_array = np.array(self.tokens, dtype=object)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(part["pattern"]["Regex"] for part in spec["pre_tokenizer"]["pretokenizers"] if part["type"] == "Split")
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.piece = regex.compile(pattern)
        # The same for texts with code points of which the tables differ.
        for kind in "LN":
            pattern = pattern.replace(rf"[\p{{{kind}}}]", rf"[\p{{{kind}}}--[{_RARE_LETTERS}]]")
        pattern = pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[^\p{{White_Space}}[\p{{L}}\p{{N}}--[{_RARE_LETTERS}]]]")
        self.rare_piece = regex.compile("(?V1)" + pattern)
        self.recent = Recent(CACHED_WORDS, self.learn)
        self._long: list[str] = []

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    # ------------------------------------------------------------ merging

    def merge_rows(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Merge rows of symbols, counts[i] of them in row i; the row's width is a power of two. The ids as bytes."""
        n, leaves = ids.shape
        rows = np.arange(n)
        after = np.tile(np.arange(1, leaves + 1), (n, 1))
        before = np.tile(np.arange(-1, leaves - 1), (n, 1))
        tree = np.full((n, 2 * leaves), _NO_PAIR)
        places = np.arange(leaves - 1)
        if leaves > 1:
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            real = (rank >= 0) & (places + 1 < counts[:, None])
            tree[:, leaves : 2 * leaves - 1] = np.where(real, rank * leaves + places, _NO_PAIR)
        width = leaves // 2
        while width:
            children = tree[:, 2 * width : 4 * width]
            tree[:, width : 2 * width] = np.minimum(children[:, 0::2], children[:, 1::2])
            width //= 2
        while True:
            rows = rows[tree[rows, 1] < _NO_PAIR]
            if not len(rows):
                break
            rank, at = np.divmod(tree[rows, 1], leaves)
            gone = after[rows, at]
            follower = after[rows, gone]
            ids[rows, at] = self.merged[rank]
            ids[rows, gone] = -1
            after[rows, at] = follower
            inside = follower < counts[rows]
            before[rows[inside], follower[inside]] = at[inside]
            self._update(tree, rows, leaves, gone, np.full(len(rows), _NO_PAIR))
            self._update(tree, rows, leaves, at, self._leaf(ids, rows, leaves, at, follower, inside))
            previous = before[rows, at]
            some = previous >= 0
            r, p = rows[some], previous[some]
            self._update(tree, r, leaves, p, self._leaf(ids, r, leaves, p, at[some], np.ones(len(r), bool)))
        kept = ids >= 0
        kept &= np.arange(leaves) < counts[:, None]
        flat, ends = ids[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[start:end] for start, end in zip([0, *ends[:-1]], ends)]

    def _leaf(self, ids, rows, leaves, at, follower, inside):
        rank = self.ranks(ids[rows, at], ids[rows, np.minimum(follower, leaves - 1)])
        return np.where(inside & (rank >= 0), rank * leaves + at, _NO_PAIR)

    @staticmethod
    def _update(tree, rows, leaves, at, value):
        node = at + leaves
        tree[rows, node] = value
        while leaves > 1:
            node >>= 1
            leaves >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_long(self, ids: list[int]) -> bytes:
        """The same for one long word, with plain lists."""
        n, none, rank_of = len(ids), float("inf"), self.rank_of
        leaves = 1 << (n - 1).bit_length()
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = rank_of.get((ids[i] << 32) | ids[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(at):
            rank = rank_of.get((ids[at] << 32) | ids[after[at]]) if ids[at] >= 0 and after[at] < n else None
            node = leaves + at
            tree[node] = none if rank is None else rank * leaves + at
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = after[at]
            ids[at], ids[gone] = int(self.merged[rank]), -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            update(gone)
            update(at)
            if before[at] >= 0:
                update(before[at])
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with the bytes of its ids; a special token has one."""
        yield from ((word, np.int32(self.special[word]).tobytes()) for word in words if word in self.special)
        words = [word for word in words if word not in self.special]
        if not words:
            return
        raw = [word.encode() for word in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        starts = ends - lengths
        low = 0
        leaves = 1
        while leaves <= WIDEST:
            chosen = np.flatnonzero((lengths > low) & (lengths <= leaves))
            for part in np.array_split(chosen, max(1, len(chosen) * leaves // 500_000)):
                if len(part):
                    offset = np.arange(leaves)
                    ids = symbols[np.minimum(starts[part][:, None] + offset, len(symbols) - 1)]
                    yield from zip((words[i] for i in part.tolist()), self.merge_rows(ids, lengths[part]))
            low, leaves = leaves, leaves * 2
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            self._long.append(words[i])
            yield words[i], self.merge_long(symbols[starts[i] : ends[i]].tolist())

    # ------------------------------------------------------------ texts

    def _normalised(self, text: str) -> tuple[str, regex.Pattern]:
        """The text as words are cut from it, and the pattern that cuts them."""
        piece = self.piece
        if not text.isascii():
            # Sigma at a word's end has a lower case of its own in Python, not in the tokenizer.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if not _latin(text) and _RARE.search(text):
                text, piece = text.translate(_LOWERED), self.rare_piece
        return text.lower(), piece

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of words; a special token is a word of its own, which no other word equals."""
        for segment in self.special_pattern.split(text) if "<|" in text else (text,):
            if segment in self.special:
                yield [segment]
            elif len(segment) <= BATCH_CHARS:
                text, piece = self._normalised(segment)
                yield piece.findall(text)
            else:
                text, piece = self._normalised(segment)
                found = (match.group() for match in piece.finditer(text))
                while part := list(islice(found, BATCH_CHARS // 8)):
                    yield part

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if size + len(text) > BATCH_CHARS:
                yield from self._encode_waiting(waiting)
                waiting, size = [], 0
            if len(text) <= BATCH_CHARS:
                waiting.append(list(chain.from_iterable(self._pieces(text))))
                size += len(text)
            else:
                parts = [self._encode_waiting([words]) for words in self._pieces(text)]
                yield np.concatenate([np.empty(0, np.int32), *chain.from_iterable(parts)])
        yield from self._encode_waiting(waiting)

    def _encode_waiting(self, waiting: list[list[str]]) -> list[np.ndarray]:
        known = self.recent.know(chain.from_iterable(waiting))
        ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in waiting]
        for word in self._long:  # what is remembered is bounded in bytes, as its words are short
            known.pop(word, None)
        self._long = []
        return ids

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Tokens joined by spaces: the file names no decoder."""
        return " ".join(self.token_array[ids].tolist()) if len(ids) else ""


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# ---------------------------------------------------------------- Spark


def list_batches(keys: pa.RecordBatch, lists: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """The rows of keys, each with a list of ids, in batches of bounded size."""
    start, waiting, size = 0, [], 0

    def made():
        offsets = np.cumsum([0, *map(len, waiting)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *waiting])))
        part = keys.slice(start, len(waiting))
        return pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, name])

    for ids in lists:
        if waiting and size + len(ids) > BATCH_IDS:
            yield made()
            start, waiting, size = start + len(waiting), [], 0
        waiting.append(ids)
        size += len(ids)
    if waiting:
        yield made()


def with_texts(vocab: Vocabulary, batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with the text of their ids, the column at that place, as ``decoded``; few rows at a time if they are long."""
    lists = batch.column(at)
    ends = lists.offsets.to_numpy()
    start, upto = 0, 0
    while start < len(batch):
        while upto < len(batch) and (upto == start or ends[upto + 1] - ends[start] <= BATCH_IDS):
            upto += 1
        ids = lists.values.slice(ends[start], ends[upto] - ends[start]).to_numpy(zero_copy_only=False)
        texts = [vocab.decode(ids[ends[i] - ends[start] : ends[i + 1] - ends[start]]) for i in range(start, upto)]
        rows = batch.slice(start, upto - start)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "decoded"])
        start = upto


def encode(spark: SparkSession, docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The given columns of docs and ``ids``, the token ids of the whole text (null: of an empty text).

    With decoded, also that column, the text of the ids, made in the same step.
    Special tokens written in a text become their ids, as in the library.
    Rows are independent: repeated rows, nulls in other columns and an empty
    table pass through. ``path`` is the tokenizer file, present on all executors.
    """
    ship_package(spark)
    # The text has a name of its own, so that it may be among the columns.
    chosen = docs.select(*[docs[c] for c in columns], docs["text"].alias("_text_to_encode"))
    n = len(columns)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS)):
                texts = part.column(n).to_pylist()
                for made in list_batches(part.select(range(n)), vocab.encode_batch(texts), "ids"):
                    yield from with_texts(vocab, made, n) if decoded else (made,)

    fields = chosen.schema.fields[:-1]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "ids array<int>", *["decoded string"] * decoded])
    return chosen.mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """The same rows with ``decoded``, the text of ``ids``; null ids count as none."""
    ship_package(spark)
    chosen = encoded.select(*encoded.columns, F.coalesce("ids", F.array().cast("array<int>")).alias("_ids_to_decode"))
    n = len(encoded.columns)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS)):
                yield from (made.select([*range(n), n + 1]) for made in with_texts(vocab, part, n))

    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields], "decoded string"]
    return chosen.mapInArrow(run, ", ".join(fields))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(spark, docs, path, decoded=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
