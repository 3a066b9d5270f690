"""Best-fit packing of token pieces into sequences of a fixed capacity.

Bulk-synchronous: documents (pieces) and gaps stand as runs of equal size, of which
there are some multiples of ``capacity`` however many documents there are. Sizes are
gone through in bands, longest first. In a band, documents and gaps are range-sorted
over tasks, and every task sweeps its range: each document, by rank, takes its
successor among the gaps, and a narrowed gap stands at its new size at once. Documents
whose range has no gap left then compete, by rank, for the gaps that other ranges have
left over, and open new sequences where there is none; the gaps that remain go on to
the next band. No run is brought to the driver before all are placed, and no piece
ever: pieces get their ranks within a size by a salted sort in the cluster, and find
their places in the intervals of ranks that the runs were given.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import cut, fresh

CAPACITY = 2048
#: Words that a worker keeps the ids of, and characters that it encodes at a time.
KEPT_WORDS, RUN_CHARS = 250_000, 2_000_000
#: Longer words are left to the library, whose merging stays fast on them.
LONGEST = 400
#: Lower ends of the bands of sizes, as shares of the capacity; tasks that a band's range is dealt to.
BANDS, RANGES = (1 / 2, 1 / 8, 0), 8
#: Kinds of runs.
DOCUMENT, GAP, PLACED = 0, 1, 2

#: Fixed value: how the tokenizer file parts a text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased words of the characters below, and the end of a word.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+|\n")
_PLAIN = re.compile(r"[\t\x0b\x0c\r\x21-\x7e\xa1-\xac\xae-\xff]*").fullmatch


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, then the rest in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Byte pairs merged by rank, words at a time, for a byte-level vocabulary whose words end in a suffix.

    The suffix stands as a space behind the word. A merger by ranks of results equals
    the file's merges if every token comes out of its own merge; that is checked.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        import tiktoken

        byte = _byte_of()
        char = {b: c for c, b in byte.items()}
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(suffix)) + b" " * t.endswith(suffix)
        tokens = [(bytes([b]), vocab.get(char[b], -1)) for b in range(256)] + [(bytes([b, 32]), vocab[char[b] + suffix]) for b in range(256) if char[b] + suffix in vocab]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        tokens += [(raw(x) + raw(y), vocab[x + y]) for x, y in pairs]
        self.ranks = {t: i for i, (t, _) in enumerate(tokens)}
        self.sound = len(self.ranks) == len(tokens) and min(i for t, i in tokens[256:]) >= 0 and all(self._parts(raw(x) + raw(y)) == [raw(x), raw(y)] for x, y in pairs)
        self.ids = np.array([i for _, i in tokens], np.int32)
        self.line_end = self.ranks[b"\n"]
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=self.ranks, special_tokens={})

    def _parts(self, token: bytes) -> list[bytes]:
        """The last two parts that merges before the token's own leave of it."""
        own, none = self.ranks[token], len(self.ranks)
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low >= own:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        found = " ".join(_PARTS.findall("\n".join(words).lower() + "\n")).replace("\n ", "\n")
        ids = np.array(self.encoding.encode_ordinary(found), np.int64)
        ends = np.flatnonzero(ids == self.line_end)
        return self.ids[np.delete(ids, ends)], np.diff(ends, prepend=-1) - 1


class WordCoder:
    """Texts to ids by a ``tokenizers`` file.

    Where the file's pre-tokenizer drops white space, what stands between spaces and
    line ends is encoded once and looked up: no token reaches over white space there,
    nor does a normaliser. Words of Latin-1 characters go through ``Merger`` where the
    file is of its kind, all others through the library. For any other file whole texts
    are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        first = (form.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        normal = (form.get("normalizer") or {}).get("normalizers", [{"type": ""}])
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern", {}).get("Regex") == PARTS
        local = {x["type"] for x in normal} <= {"NFC", "NFKC", "Lowercase", "Replace"} and all(x.get("pattern", {}).get("Regex") == r"\s+" for x in normal if x["type"] == "Replace")
        added = [x["content"] for x in form.get("added_tokens", [])]
        strips = any(x["lstrip"] or x["rstrip"] for x in form.get("added_tokens", [])) or any(c.isspace() for x in added for c in x) or not all(x[:2] == "<|" and x[-1] == ">" for x in added)
        self.by_word = bool(drops and local and not strips and not form.get("post_processor"))
        self.merger = self._merger(form) if self.by_word and [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] else None
        self._forget()

    @staticmethod
    def _merger(form: dict) -> Merger | None:
        rest, model = form["pre_tokenizer"]["pretokenizers"][1:], form["model"]
        odd = model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or not model.get("end_of_word_suffix")
        if model["type"] != "BPE" or odd or [x["type"] for x in rest] != ["ByteLevel"] or rest[0].get("use_regex") or rest[0].get("add_prefix_space"):
            return None
        made = Merger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        return made if made.sound else None

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if len(w) <= LONGEST and _PLAIN(w) and "<|" not in w] if self.merger else []
        some = set(plain)
        ids, sizes = [self.ids], [self.size]
        if plain:
            found, n = self.merger.encode(plain)
            ids.append(found)
            sizes.append(n)
        others = [w for w in words if w not in some] if len(plain) < len(words) else []
        for at in range(0, len(others), 20_000):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(others[at : at + 20_000], add_special_tokens=False)]
            ids.append(np.array([i for x in found for i in x], np.int32))
            sizes.append(np.array([len(x) for x in found], np.int64))
        self.known.update(zip([*plain, *others], range(len(self.size), len(self.size) + len(words)), strict=True))
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.begin = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after the other, and how many each text has."""
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        new = [w for w in words if w not in self.known]
        if new and len(self.known) > KEPT_WORDS:
            self._forget()
            new = list(words)
        if new:
            self._learn(new)
        known = self.known
        at = np.fromiter((known[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.size[at]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.begin[at] - before, size) + np.arange(size.sum())]
        offsets = split.offsets.to_numpy()
        return ids, np.add.reduceat(size, offsets[:-1] - offsets[0]) if len(texts) else size


@functools.lru_cache(2)
def _coder(path: str) -> WordCoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCoder(path)


def release() -> None:
    """Give memory that Arrow and the C library hold in reserve back, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_runs(batches: Iterable[pa.RecordBatch], chars: int = RUN_CHARS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids (of any type) and whole texts (null: empty) of a table's first two columns, some ``chars`` bytes at a time.

    Meanwhile the worker looks for no reference cycles: millions of words and few
    containers would be looked through again and again.
    """
    gc.disable()
    try:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars)) + 1
                n = min(upto, len(texts)) - at
                yield batch.column(0).slice(at, n), texts.slice(at, n)
                at += n
    finally:
        gc.enable()
        release()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and ``end``, cut every ``capacity`` ids.

    Ids may have any type that Arrow carries. Null texts count as empty and have the
    end only; repeated rows give their pieces each; an empty table stays empty.
    """
    kind = docs.schema[id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for keys, texts in text_runs(batches):
            ids, sizes = coder.encode(texts)
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            whole = np.full(ends[-1], end, "<u4")
            body = np.ones(ends[-1], bool)
            body[ends - 1] = False
            whole[body] = ids
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            first = ((ends - sizes)[doc] + start) * 4
            data = memoryview(whole).cast("B")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id, text).mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Run = tuple[int, int, int]


def sweep(documents: list[Run], gaps: list[Run], capacity: int = CAPACITY, first_new: int | None = None, step: int = 1) -> tuple[list[tuple[int, int, int, int, int]], list[Run], list[Run]]:
    """Best fit of runs: what was placed (size, first rank, how many, first sequence, offset), the documents left, the gaps left.

    A run is a size, where it begins (a document's rank in its size; a gap's sequence)
    and how many follow. Longest sizes first; each takes the smallest gaps that hold
    it, as many documents as gaps there are, and so on upwards. With ``first_new``
    documents without a gap open sequences from that number on, ``step`` apart, and so
    are the sequences of all runs.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for size, first, n in sorted(gaps, reverse=True):
        room[size].append((first, n))
    placed, over = [], []
    for size, rank, left in sorted(documents, reverse=True):
        g = size
        while left and g <= capacity:
            if not room[g]:
                g += 1
                continue
            first, n = room[g].pop()
            k = min(n, left)
            placed.append((size, rank, k, first, capacity - g))
            if k < n:
                room[g].append((first + k * step, n - k))
            room[g - size].append((first, k))
            rank, left = rank + k, left - k
            g = g - size if g - size >= size else g
        if left and first_new is None:
            over.append((size, rank, left))
        elif left:
            fits = capacity // size
            n = have = -(-left // fits)
            for layer in range(fits):
                k = min(have, left)
                if k:
                    placed.append((size, rank, k, first_new, layer * size))
                if k < have:
                    room[capacity - layer * size].append((first_new + k * step, have - k))
                rank, left, have = rank + k, left - k, k
            if have:
                room[capacity - fits * size].append((first_new, have))
            first_new += n * step
    return placed, over, [(g, first, n) for g in range(1, capacity + 1) for first, n in room[g]]


def _swept(capacity: int, band: int, opens: bool):
    """A task's sweep over the runs of its range; runs that don't take part (a range below 0) stay as they are."""
    step = len(BANDS)
    names = ["kind", "size", "first", "n", "sequence", "offset"]

    def work(t: pa.Table) -> pa.Table:
        if t.column("range")[0].as_py() < 0:
            return t.select(names)
        rows = list(zip(*(t.column(c).to_pylist() for c in names[:4]), strict=True))
        of = lambda kind: [r[1:] for r in rows if r[0] == kind]
        placed, documents, gaps = sweep(of(DOCUMENT), of(GAP), capacity, band if opens else None, step)
        out = [(PLACED, *r) for r in placed] + [(DOCUMENT, *r, None, None) for r in documents] + [(GAP, *r, None, None) for r in gaps]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    return work


def placements(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``size, first, n, sequence, offset``: the places of ``counts`` (``length``, ``n``).

    ``n`` documents of a size, by rank from ``first`` on, stand at ``offset`` in
    sequences that follow each other ``len(BANDS)`` apart. A plan of two small exchanges
    a band; its runs are some multiples of ``capacity``.
    """
    none = F.lit(None).cast("long")
    runs = counts.select(F.lit(DOCUMENT).cast("long").alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), none.alias("sequence"), none.alias("offset"))
    top = capacity
    for band, share in enumerate(BANDS):
        low = int(capacity * share)
        width = max(1, -(-(top - low) // RANGES))
        taking = ((F.col("kind") == DOCUMENT) & F.col("size").between(low + 1, top)) | ((F.col("kind") == GAP) & (F.col("size") > low))
        nth = F.least(F.floor((F.col("size") - low - 1) / width), F.lit(RANGES - 1)).cast("int")
        waiting = (-1 - F.pmod(F.xxhash64("kind", "size", "first"), F.lit(RANGES))).cast("int")
        for opens, place in ((False, nth), (True, F.lit(0))):
            runs = runs.withColumn("range", F.when(taking, place).otherwise(waiting)).groupBy("range").applyInArrow(_swept(capacity, band, opens), "kind long, size long, first long, n long, sequence long, offset long")
        top = low
    return runs.where(F.col("kind") == PLACED).drop("kind")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` with sequence_id and offset; it has doc_id, piece, length and ids_crc32, lengths from 1 to ``capacity``.

    Other columns stay, whatever their names (a sequence_id or offset is replaced).
    Equal rows are packed as often as they occur; an empty table stays empty. The same
    table always gets the same sequences.
    """
    spark = parts.sparkSession
    parts = parts.drop("sequence_id", "offset")
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt, rank, base, n = (fresh(parts, c) for c in ("_salt", "_rank", "_base", "_n"))
    names = parts.columns
    salted = parts.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    by_salt = cut(salted.groupBy("length", salt).agg(F.count("*").alias(n)))
    found = cut(placements(by_salt.groupBy("length").agg(F.sum(n).alias("n")), capacity))
    plan = np.array(sorted(map(tuple, found.select("size", "first", "sequence", "offset").collect())), np.int64).reshape(-1, 4)  # some multiples of `capacity`
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = by_salt.select("length", salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    order = Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn(rank, F.row_number().over(order)).join(bases.hint("merge"), ["length", salt])
    ranked = ranked.select(*names, (F.col(base) + F.col(rank) - 1).alias(rank))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    step = len(BANDS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for b in batches:
            nth = b.column(b.num_columns - 1).to_numpy()
            at = np.searchsorted(keys, (b.column(b.schema.get_field_index("length")).to_numpy() << 44) + nth, "right") - 1
            placed = [pa.array(plan[at, 2] + (nth - plan[at, 1]) * step), pa.array(plan[at, 3])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *placed], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces with their sequences.

    Null texts count as empty and still get an end id; repeated rows are packed each;
    an empty table stays empty; other columns of ``docs`` don't matter.
    """
    return pack(cut(pieces(docs, path, capacity, id, text)), capacity)
