"""SentencePiece BPE encoding on a relational lattice, and decoding.

A text is one blank, then its characters, blanks written as U+2581. It falls
into words at every pair of characters that no piece holds side by side: no
piece reaches across, so words are encoded one by one.

1. Each block of documents (a run of an input partition) becomes its distinct
   words and, for each document, references to them.
2. Words of all blocks meet. The substrings, of at most the longest piece, of
   each distinct one are exploded and equi-joined to the piece table: the edges
   of the lattice.
3. Edges are grouped by word and folded with ``aggregate``.
4. Pieces are joined to the blocks' words, meet the block again, and documents
   get their pieces. A word has at most one row for each block.

The vocabulary is one of byte-pair merges. The best path by the sum of its
scores (Viterbi) is another segmentation than the merges give for two words in
three, so the fold follows the merges: its state is where each piece ends, and
each step joins the two neighbours whose union is the edge of highest score,
the leftmost of equal ones. That gives the library's pieces exactly. Characters
without a piece become the pieces of their bytes.

A step of that fold looks at all edges, so its time grows with the square of a
word. A word of more than LONGEST characters (a text without blanks, say) isn't
exploded: the task that has it takes the same merges from a heap of the edges
between neighbours, in about linear time and memory.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as tk
from factloom.llm.pii import let

#: The vocabulary file, a SentencePiece model of kind BPE with byte pieces.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
#: Bytes of text whose words are looked up together.
BLOCK_BYTES = 32 << 20
#: Partitions of distinct words, and of blocks, for each of the session's shuffle partitions.
PARTS = 4
#: Characters of a word up to which ``aggregate`` folds it.
LONGEST = 100
_PAIRS = 1 << 22
U64 = np.uint64


class Vocabulary(NamedTuple):
    pieces: list[str]
    ids: list[int]
    ranks: list[int]  # 0 for the highest score; equal for equal scores
    longest: int
    byte: int  # the piece of byte 0
    surface: list[str]  # for each id the hex of its bytes


def vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    ids = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = sorted({model.get_score(i) for i in ids}, reverse=True)
    rank = {s: r for r, s in enumerate(scores)}
    pieces = [model.id_to_piece(i) for i in ids]
    byte = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
    if sorted(byte) != list(range(256)) or any(byte[b] != byte[0] + b for b in byte):
        raise ValueError(f"{path} has no row of byte pieces")
    surface = [""] * len(every)
    for b, i in byte.items():
        surface[i] = f"{b:02X}"
    for i, p in zip(ids, pieces, strict=True):
        surface[i] = p.encode().hex().upper()
    return Vocabulary(pieces, ids, [rank[model.get_score(i)] for i in ids], max(map(len, pieces)), byte[0], surface)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    return (h ^ (h >> np.uint32(15))) & np.uint32(_PAIRS - 1)


def _pair_table(pieces: list[str]) -> np.ndarray:
    """Which pairs of neighbours some piece may hold; a false yes only leaves words longer."""
    table = np.zeros(_PAIRS, bool)
    for p in pieces:
        c = np.array([ord(x) for x in p], np.uint32)
        table[_pair(c[:-1], c[1:])] = True
    return table


_POWERS = tk._Powers(0xA24BAED4963EE407, pow(0xA24BAED4963EE407, -1, 2**64))


def _characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points with the blank in front of each text that isn't empty, first one of each text)."""
    chars, first = [], [0]
    text = buf.tobytes()
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if j > i:
            chars.append(text[i:j].decode("utf-8", "replace"))
        first.append(first[-1] + (len(chars[-1]) + 1 if j > i else 0))
    codes = np.frombuffer(("▁" + "▁".join(chars) if chars else "").encode("utf-32-le"), np.uint32).copy()
    codes[codes == 0x20] = BLANK
    return codes, np.array(first, np.int64)


def _utf8(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of code points as strings."""
    to = np.concatenate(([0], np.cumsum(size)))
    flat = codes[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
    width = 1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(width)))[to].astype(np.int32)
    data = flat.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data))


def _words(codes: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, hash) of the words."""
    n = len(codes)
    cut = np.ones(n, bool)
    if n:
        cut[1:] = ~pairs[_pair(codes[:-1], codes[1:])]
        cut[first[:-1][first[:-1] < n]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, n))
    up, down = _POWERS.get(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(0x9E3779B97F4A7C15)) * up[:n], out=sums[1:], dtype=U64)
    return start, size, tk.mix((sums[start + size] - sums[start]) * down[start] + size.astype(U64))


def _blocks(docs: DataFrame, pairs: np.ndarray, block_bytes: int) -> DataFrame:
    """to (the block's name, from its content), words and docs: packed ids, nulls, words of each
    document and references to the words, the frequent ones in low numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(pairs))

    @tk.tidy
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.unpackbits(shared.value).astype(bool)
        held, size = [], 0

        def row() -> pa.RecordBatch:
            hashes = np.concatenate([x[0] for x in held])
            base = np.concatenate(([0], np.cumsum([len(x[0]) for x in held])))
            _, at, to = np.unique(hashes, return_index=True, return_inverse=True)
            order = np.argsort(-np.bincount(to, weights=np.concatenate([x[5] for x in held])), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            place = place[to]
            first = hashes[at[order]][:8].tobytes()
            words = pa.concat_arrays([x[1] for x in held]).take(pa.array(at[order]))
            del hashes, to
            counts = np.concatenate([x[4] for x in held]).astype(np.uint32)
            ids = pa.concat_arrays([x[3] for x in held])
            refs, n = np.empty(sum(len(x[2]) for x in held), np.uint32), 0
            for b, x in zip(base.tolist(), held, strict=False):
                refs[n : n + len(x[2])] = place[b : b + len(x[0])][x[2]]
                n += len(x[2])
                x.clear()  # a block's references are held once
            blob = tk.pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), counts, refs)
            del refs
            name = hashlib.blake2b(blob, digest_size=8, key=first).digest()  # the same whenever the block is made
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name, "little") >> 1]), tk.lists(np.array([len(words)]), words), pa.array([_squeezed(blob)], pa.binary())], names=["to", "words", "docs"])

        for rows, buf, offsets in tk.pieces(batches, "text"):
            codes, first = _characters(buf, offsets)
            start, length, h = _words(codes, first, pairs)
            own, at, to, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            held.append([own, _utf8(codes, start[at], length[at]), to.astype(np.uint32), rows.column("doc_id"), np.diff(np.searchsorted(start, first)), times.astype(np.uint32)])
            size += len(buf)
            del codes, start, length, h, own, at, to, times
            if size >= block_bytes:
                yield row()
                held, size = [], 0
                tk.give_back()
        if held:
            yield row()

    return docs.mapInArrow(block, "to long, words array<string>, docs binary")


def _squeezed(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def _whole(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def folded(size: Column, edges: Column) -> Column:
    """Sizes of the pieces of a word of ``size`` characters, from its edges
    (rank, start, end; places from 1) in order of rank and start."""
    ends = F.concat(F.array(F.lit(0)), F.sequence(F.lit(2), size + 1), F.array(F.lit(0)))

    def step(ends: Column, _: Column) -> Column:
        fits = F.filter(edges, lambda e: ends[ends[e["start"]]] == e["end"])

        def joined(e: Column) -> Column:
            middle = ends[e["start"]]
            return let(middle, lambda m: F.transform(ends, lambda x, i: F.when(i == e["start"], e["end"]).when(i == m, 0).otherwise(x)))

        return let(fits, lambda f: F.when(F.size(f) == 0, ends).otherwise(let(f[0], joined)))

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(size - 1, F.size(edges)), F.lit(1))), ends, step)
    return F.filter(F.transform(done, lambda x, i: F.when(x > 0, x - i).otherwise(0)), lambda n: n > 0)


def segmented(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """word and sizes (of its pieces; null for a word of more than LONGEST characters)
    for each distinct word of words(to, at, word), which are partitioned by word."""
    spark = words.sparkSession
    several = [(p, r) for p, r in zip(vocab.pieces, vocab.ranks, strict=True) if len(p) > 1]
    pieces = F.broadcast(spark.createDataFrame(several, "piece string, rank int"))  # the vocabulary
    own = words.groupBy("word").agg(F.min("to").alias("home"), F.min("at").alias("place")).where("home IS NOT NULL AND place IS NOT NULL")  # reads what the join reads: one exchange for both
    folds = F.length("word") <= LONGEST
    own = own.withColumn("size", F.when(folds, F.length("word")).otherwise(1))
    starts = own.select("word", "size", F.explode(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1)))).alias("start"))
    spans = starts.select("word", "start", F.explode(F.expr(f"sequence(1, least({vocab.longest}, size - start + 1))")).alias("n")).where("n > 1 OR start = 1")
    edges = spans.withColumn("piece", F.expr("substring(word, start, n)")).join(pieces, "piece", "left").where("rank IS NOT NULL OR n = 1")
    edge = F.when(F.col("n") > 1, F.struct("rank", "start", (F.col("start") + F.col("n")).alias("end")))
    lattice = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    sizes = F.when(~folds, None).when(F.size("edges") == 0, F.array_repeat(F.lit(1), F.length("word"))).otherwise(folded(F.length("word"), F.col("edges")))
    return lattice.select("word", sizes.alias("sizes"))


def encode(docs: DataFrame, path: str = MODEL, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and ids, the pieces of the text.

    A null or empty text has no pieces. Rows are encoded one by one; repeated
    ones give as many results. U+2581 in a text is taken for a blank. A text of
    any length is encoded whole, in about linear time even without a blank. A
    task holds the distinct words and references of one block, and one document.
    Other columns, whatever their names, play no part.
    """
    spark = docs.sparkSession
    vocab = vocabulary(path)
    n = tk.partitions(spark)
    blocks = _blocks(tk.narrow(docs, id_col, text_col), _pair_table(vocab.pieces), block_bytes)
    words = blocks.select("to", F.posexplode("words").alias("at", "word")).where("word IS NOT NULL").repartition(PARTS * n, "word")
    known = spark.sparkContext.broadcast((*_lookup(vocab), vocab.byte, dict(zip(vocab.pieces, vocab.ranks, strict=True))))  # the vocabulary
    longest = vocab.longest
    number = np.uint16 if len(vocab.surface) <= 1 << 16 else np.uint32

    @tk.tidy
    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *table, ranks = known.value  # the vocabulary
        for b in batches:
            many, ids = _piece_ids(b.column("word"), _all_sizes(b.column("word"), b.column("sizes"), ranks, longest), *table)
            ends = np.concatenate(([0], np.cumsum(many))) * number().itemsize
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype(number).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("word"), packed], names=["word", "found"])

    @tk.tidy
    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _assembled(batches, number)

    tk.small_batches(spark, 2048)  # of words, and of documents
    pieces = segmented(words, vocab).mapInArrow(identified, "word string, found binary")
    found = words.join(pieces.hint("shuffle_hash"), "word").select("to", "at", "found", F.lit(None).cast("binary").alias("docs"))
    both = found.unionByName(blocks.select("to", F.lit(None).cast("int").alias("at"), F.lit(None).cast("binary").alias("found"), "docs"))
    both = both.repartitionById(PARTS * n, (F.col("to") % (PARTS * n)).cast("int")).sortWithinPartitions("to", F.col("at").asc_nulls_last())
    return both.mapInArrow(assembled, "doc_id long, ids array<int>")


def _assembled(batches: Iterator[pa.RecordBatch], number: type) -> Iterator[pa.RecordBatch]:
    """Documents' pieces: a block's words come first in their order, its documents after them."""
    many, ids = [], []
    for b in batches:
        at, i = b.column("at"), 0
        for end in [*np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False)).tolist(), len(at)]:
            found = b.column("found").slice(i, end - i)
            if end > i:
                to = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
                many.append(np.diff(to) // number().itemsize)
                ids.append(np.frombuffer(found.buffers()[2], np.uint8)[to[0] : to[-1]].view(number) if to[-1] > to[0] else np.zeros(0, number))
            if end < len(at):
                yield from _documents(tk.unpack(_whole(b.column("docs")[end].as_py())), many, ids)
                many, ids = [], []
            i = end + 1


def _documents(docs: list[np.ndarray], many: list[np.ndarray], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids, null, counts, refs = docs
    size = np.concatenate([np.zeros(0, np.int64), *many]).astype(np.int64)
    values = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
    start = np.cumsum(size) - size
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    i = 0
    while i < len(counts):  # a few documents at a time
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 18), "right")) - 1)
        r = refs[ends[i] : ends[j]]
        to = np.concatenate(([0], np.cumsum(size[r])))
        flat = values[np.repeat(start[r] - to[:-1], size[r]) + np.arange(to[-1])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i:j].view(np.int64), mask=null[i:j] > 0), tk.lists(np.diff(to[ends[i : j + 1] - ends[i]]), pa.array(flat))], names=["doc_id", "ids"])
        i = j


def _lookup(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the pieces, their ids)."""
    h = _run_hashes(np.frombuffer("".join(vocab.pieces).encode("utf-32-le"), np.uint32), np.array([len(p) for p in vocab.pieces], np.int64))
    by = np.argsort(h)
    return h[by], np.array(vocab.ids, np.int32)[by]


def _run_hashes(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    up, down = _POWERS.get(len(codes))
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(0x9E3779B97F4A7C15)) * up[: len(codes)], out=sums[1:], dtype=U64)
    start = end - size
    return tk.mix((sums[end] - sums[start]) * down[start] + size.astype(U64))


def merged(word: str, ranks: dict[str, int], longest: int) -> list[int]:
    """Sizes of the pieces of a word: always the neighbours whose union has the
    best rank are joined, the leftmost of equal ones. An edge waits in a heap
    until it is taken, or one of its ends is gone."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts here; end 0: none does
    waiting = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(waiting)

    def offer(i: int, e: int) -> None:
        if e - i <= longest and (rank := ranks.get(word[i:e])) is not None:
            heapq.heappush(waiting, (rank, i, e))

    while waiting:
        _, i, e = heapq.heappop(waiting)
        middle = end[i]
        if not 0 < middle < e or end[middle] != e:
            continue
        end[i], end[middle] = e, 0
        if e < n:
            before[e] = i
            offer(i, end[e])
        if i:
            offer(before[i], e)
    return [e - i for i, e in enumerate(end) if e]


def _all_sizes(words: pa.Array, sizes: pa.Array, ranks: dict[str, int], longest: int) -> pa.Array:
    """sizes, and those of the words that have none yet."""
    if not sizes.null_count:
        return sizes
    known, missing = sizes.to_pylist(), sizes.is_null().to_pylist()
    return pa.array([merged(words[i].as_py(), ranks, longest) if gone else known[i] for i, gone in enumerate(missing)], pa.list_(pa.int32()))


def _piece_ids(words: pa.Array, sizes: pa.Array, hashes: np.ndarray, ids: np.ndarray, byte: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of pieces of each word, all pieces) from the sizes of the words' pieces."""
    size = sizes.flatten().to_numpy().astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(np.diff(sizes.offsets.to_numpy()))))
    text = "".join(words.to_pylist())
    h = _run_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), size)
    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    own = np.where(hashes[place] == h, ids[place], -1)
    unknown = np.flatnonzero(own < 0)
    many = np.ones(len(own), np.int64)
    start = np.cumsum(size) - size
    raw = [text[i : i + n].encode() for i, n in zip(start[unknown].tolist(), size[unknown].tolist(), strict=True)]
    many[unknown] = [len(x) for x in raw]
    to = np.concatenate(([0], np.cumsum(many)))
    out = np.repeat(own, many).astype(np.int32)
    for k, x in zip(to[unknown].tolist(), raw, strict=True):
        out[k : k + len(x)] = np.frombuffer(x, np.uint8).astype(np.int32) + byte
    return np.diff(to[ends]), out


def decode(ids: Column, vocab: Vocabulary) -> Column:
    """The text of an array of pieces: their bytes one after the other, U+2581
    as a blank, without the first one. Control pieces are nothing; null is null."""
    surface = F.lit(vocab.surface)
    raw = F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(surface, i + 1)), "")).cast("string")
    return let(F.translate(raw, chr(BLANK), " "), lambda t: F.when(t.startswith(" "), F.substring(t, F.lit(2), F.length(t))).otherwise(t))
