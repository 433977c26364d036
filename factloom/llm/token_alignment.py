"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut one blank and the text into tokens, each of which stands
for a run of bytes. Every byte offset where a token of either side ends closes
an elementary interval, which lies in exactly one token of each side: one
overlap. Offsets where both sides end close a group; each token of a group is
linked with each token of the group's other side.

No token of either side reaches across the front of a single blank that stands
before something other than white space. There a text falls into words, and a
block of documents encodes and aligns each of its distinct words once:

1. A task cuts a block of texts into words, aligns the distinct ones, and
   writes the documents' figures, their references to words, the words' links,
   and in how many of its documents each pair of ids is linked.
2. Pairs of all blocks meet once and are counted; each A id's highest count
   (one row for each entry of the vocabulary at most) is broadcast.
3. Counts go back to the blocks that hold the pair, and documents are summed.

Blocks travel, not documents' pairs: a pair that stands in every document is
one row for each block. Words are told apart by 64-bit hashes; two of them
agree with a chance of about 2**-64.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import graphs
from factloom.llm import textkit as tk

U64 = np.uint64
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose words are aligned together.
BLOCK_BYTES = 2 << 20
#: Links expanded at once.
SLICE = 1 << 22
#: Links of a group up to which its product is expanded as it is; a larger one's ids are made distinct first.
LARGE = 256
#: First bytes of a character that is no white space, whatever follows.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
#: The words of a byte-level vocabulary, as its file format defines them.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer(NamedTuple):
    encode: Callable[[list[str]], list[list[int]]]  # of words that begin with a blank
    sizes: np.ndarray  # bytes of each id
    surface: list[bytes]


def _tokenizer(encode: Callable[[list[str]], list[list[int]]], surface: list[bytes]) -> Tokenizer:
    return Tokenizer(encode, np.array([len(s) for s in surface], np.int64), surface)


def byte_level(path: str) -> Tokenizer:
    """A byte-level vocabulary (JSON) whose ids are in the order of its merges; special tokens are left out."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    cut, model = told["pre_tokenizer"], told["model"]
    if told["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or model["type"] != "BPE":
        raise ValueError(f"{path} isn't a plain byte-level vocabulary")
    # printable characters stand for themselves, the other bytes for the characters from U+0100
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    bytes_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    if sorted(ranks.values()) != list(range(len(ranks))) or any(len(s) != 1 for s, i in ranks.items() if i < 256):
        raise ValueError(f"the ids of {path} aren't in the order of its merges")
    for i, merge in enumerate(model["merges"]):
        if model["vocab"]["".join(merge) if isinstance(merge, list) else merge.replace(" ", "", 1)] != 256 + i:
            raise ValueError(f"the ids of {path} aren't in the order of its merges")
    core = tiktoken.Encoding("words", pat_str=_BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})
    return _tokenizer(lambda words: [core.encode_ordinary(w) for w in words], sorted(ranks, key=ranks.__getitem__))


def pieces(path: str) -> Tokenizer:
    """A SentencePiece vocabulary, which puts a blank in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in n.lstrip("▁") for n in names):
        raise ValueError(f"{path} has pieces that reach across words")
    surface = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return _tokenizer(lambda words: model.encode([w[1:] for w in words], num_threads=1), surface)


_LOADED: dict[tuple[str, str], tuple[Tokenizer, Tokenizer]] = {}


def _tokenizers(a: str, b: str) -> tuple[Tokenizer, Tokenizer]:
    """Both, read once by each worker."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = byte_level(a), pieces(b)
    return _LOADED[a, b]


class Aligned(NamedTuple):
    """Tokens over the same bytes; group g has A tokens a_cut[g]:a_cut[g + 1], B tokens likewise, and ends at byte ends[g]."""

    ends: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    overlap_ends: np.ndarray
    a_owner: np.ndarray
    b_owner: np.ndarray


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Elementary intervals of two token sequences with the same total size, their owners, and groups."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ends = _sorted_distinct(np.concatenate((a_ends, b_ends)))  # union1d, which hashes large arrays and is slower then
    a_owner, b_owner = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    both = (a_ends[a_owner] == ends) & (b_ends[b_owner] == ends) if len(ends) else np.zeros(0, bool)
    zero = np.zeros(1, np.int64)
    return Aligned(ends[both], np.concatenate((zero, a_owner[both] + 1)), np.concatenate((zero, b_owner[both] + 1)), ends, a_owner, b_owner)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, … of size[i] values each, one after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _links(found: Aligned, a_ids: np.ndarray, b_ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair of ids, links) of all groups, ascending by group; a pair may stand in several rows of a group."""
    na, nb = np.diff(found.a_cut), np.diff(found.b_cut)
    size = na * nb
    total = np.cumsum(np.where(size <= LARGE, size, 0))
    i = 0
    while i < len(size):
        j = i if size[i] > LARGE else int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right"))
        large = np.flatnonzero(size[i : max(j, i + 1)] > LARGE)
        j = i + int(large[0]) if len(large) else max(j, i + 1)
        if i == j:
            (a, a_times), (b, b_times) = (np.unique(x, return_counts=True) for x in (a_ids[found.a_cut[i] : found.a_cut[i + 1]], b_ids[found.b_cut[i] : found.b_cut[i + 1]]))
            step = max(1, SLICE // len(b))
            for k in range(0, len(a), step):
                pair = (a[k : k + step, None].astype(U64) << U64(32) | b[None, :].astype(U64)).ravel()
                yield np.full(len(pair), i), pair, (a_times[k : k + step, None] * b_times[None, :]).ravel()
            i += 1
            continue
        a = np.repeat(_ranges(found.a_cut[i:j], na[i:j]), np.repeat(nb[i:j], na[i:j]))
        b = _ranges(np.repeat(found.b_cut[i:j], na[i:j]), np.repeat(nb[i:j], na[i:j]))
        yield np.repeat(np.arange(i, j), size[i:j]), a_ids[a].astype(U64) << U64(32) | b_ids[b].astype(U64), np.ones(len(a), np.int64)
        i = j


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a blank before each text, start of each word and the end, first word of each text); an empty text has none."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    to = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + (sizes > 0), out=to[1:])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    text = np.ones(len(out), bool)
    text[to[full]] = False
    out[text] = buf
    at = np.flatnonzero(out[:-1] == 0x20)
    at = at[_SOLID[out[at + 1]] & ((at == 0) | (out[at - 1] != 0x20))]
    starts = _sorted_distinct(np.concatenate((at, to[full])))
    return out, np.append(starts, len(out)), np.searchsorted(starts, to)


def _distinct(buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct word, distinct word of each place)."""
    hashes, i = [np.zeros(0, U64)], 0
    while i < len(edges) - 1:  # a megabyte of words at a time, or one longer word
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + tk.CHUNK_BYTES, "right")) - 1)
        hashes.append(tk.slice_hash(buf[edges[i] : edges[j]], edges[i:j] - edges[i], edges[i + 1 : j + 1] - edges[i]))
        i = j
    _, at, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return at, which


def _encoded(side: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids of each text); few lists of Python numbers exist at a time."""
    flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(texts), 1 << 13):
        ids = side.encode(texts[i : i + (1 << 13)])
        counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts[-1].sum())))
    return np.concatenate(flat), np.concatenate(counts)


def _same_bytes(side: Tokenizer, ids: np.ndarray, count: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Whether each word's tokens have its bytes."""
    first = np.concatenate(([0], np.cumsum(count)))
    size = np.concatenate(([0], np.cumsum(side.sizes[ids])))
    want = np.fromiter(map(len, words), np.int64, len(words))
    same = size[first[1:]] - size[first[:-1]] == want
    told, whole = b"".join([side.surface[i] for i in ids.tolist()]), b"".join(words)
    if same.all() and told == whole:
        return same
    at = np.concatenate(([0], np.cumsum(want)))
    return np.array([bool(s) and told[size[i] : size[j]] == words[k] for k, (s, i, j) in enumerate(zip(same, first[:-1], first[1:], strict=True))], bool) if len(at) > 1 else same


class _Entries:
    """The distinct words of a block, aligned; a word that some side doesn't give back byte by byte isn't ok."""

    def __init__(self, words: list[bytes], sides: tuple[Tokenizer, Tokenizer]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        (a, na), (b, nb) = (_encoded(s, texts) for s in sides)
        del texts
        self.ok = _same_bytes(sides[0], a, na, words) & _same_bytes(sides[1], b, nb, words)
        if not self.ok.all():  # only words that are ok are aligned
            a, b = a[np.repeat(self.ok, na)], b[np.repeat(self.ok, nb)]
            na, nb = na * self.ok, nb * self.ok
        found = align(sides[0].sizes[a], sides[1].sizes[b])
        bytes_end = np.cumsum(np.where(self.ok, np.fromiter(map(len, words), np.int64, len(words)), 0))
        self.groups_end = np.searchsorted(found.ends, bytes_end, "right")
        n_groups = np.diff(self.groups_end, prepend=0)
        overlaps = np.diff(np.searchsorted(found.overlap_ends, bytes_end, "right"), prepend=0)
        size = np.concatenate(([0], np.cumsum(np.diff(found.a_cut) * np.diff(found.b_cut))))
        links = np.diff(size[self.groups_end], prepend=0)
        self.figures = np.stack([na, nb, n_groups, links, overlaps], 1)
        word_of = np.repeat(np.arange(len(words)), n_groups)
        parts = [(word_of[g], p, t) for g, p, t in _links(found, a, b)]
        self.link_word, self.link_pair, self.link_times = (np.concatenate(x) if parts else np.zeros(0, kind) for x, kind in zip(zip(*parts, strict=True) if parts else ((), (), ()), (np.int64, U64, np.int64), strict=True))
        self.words_told = self._told(found, a, b)

    def _told(self, found: Aligned, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Each word's groups as text."""
        na, nb = np.diff(found.a_cut), np.diff(found.b_cut)
        told = np.empty(len(na), object)
        single = (na == 1) & (nb == 1)
        pairs, which = np.unique(a[found.a_cut[:-1][single]].astype(U64) << U64(32) | b[found.b_cut[:-1][single]].astype(U64), return_inverse=True)
        told[single] = np.array([b"%d|%d" % (p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], object)[which] if len(pairs) else None
        for g in np.flatnonzero(~single).tolist():
            told[g] = b"%s|%s" % tuple(b",".join([b"%d" % i for i in ids[cut[g] : cut[g + 1]].tolist()]) for ids, cut in ((a, found.a_cut), (b, found.b_cut)))
        groups = told.tolist()
        ends = self.groups_end.tolist()
        return [b";".join(groups[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
_DOC = "struct<doc_id:bigint," + ",".join(f"{f}:bigint" for f in FIGURES) + ",groups_sha256:string>"
_BLOCK = f"block long, docs array<{_DOC}>, refs binary, pairs array<bigint>, holders array<int>"


def _block(number: int, ids: pa.Array, buf: np.ndarray, offsets: np.ndarray, sides: tuple[Tokenizer, Tokenizer]) -> pa.RecordBatch:
    whole, edges, first = _words(buf, offsets)
    at, which = _distinct(whole, edges)
    data = whole.tobytes()
    words = [data[i:j] for i, j in zip(edges[at].tolist(), edges[at + 1].tolist(), strict=True)]
    entries = _Entries(words, sides)
    docs = len(offsets) - 1
    if not entries.ok.all():
        # a document with such a word is one word itself: only all its bytes decide whether it has tokens
        doc_of = np.repeat(np.arange(docs), np.diff(first))
        alone = np.unique(doc_of[~entries.ok[which]])
        words += [data[i:j] for i, j in zip(edges[first[alone]].tolist(), edges[first[alone + 1]].tolist(), strict=True)]
        entries = _Entries(words, sides)
        stays = ~np.isin(doc_of, alone)
        doc_of, which = np.concatenate((doc_of[stays], alone)), np.concatenate((which[stays], len(at) + np.arange(len(alone))))
        order = np.argsort(doc_of, kind="stable")
        doc_of, which = doc_of[order], which[order]
        first = np.searchsorted(doc_of, np.arange(docs + 1))
    doc_of = np.repeat(np.arange(docs), np.diff(first))
    sums = np.zeros((docs, len(FIGURES)), np.int64)
    np.add.at(sums, doc_of, entries.figures[which])
    told, places = entries.words_told, which.tolist()
    digests = [hashlib.sha256(b";".join([told[w] for w in places[i:j]])).hexdigest() if n else "" for i, j, n in zip(first[:-1].tolist(), first[1:].tolist(), sums[:, 0].tolist(), strict=True)]

    # each document's distinct words, and the distinct pairs of its words
    held = np.sort(doc_of * max(len(words), 1) + which)
    last = np.flatnonzero(np.append(held[1:] != held[:-1], True)) if len(held) else held
    used, times = held[last], np.diff(last, prepend=-1)
    used_doc, used_word = used // max(len(words), 1), used % max(len(words), 1)
    pairs, local = np.unique(entries.link_pair, return_inverse=True)
    word_first = np.searchsorted(entries.link_word, np.arange(len(words) + 1))
    holders = np.zeros(len(pairs), np.int64)
    size = word_first[used_word + 1] - word_first[used_word]
    total = np.cumsum(size)
    doc_ends = np.searchsorted(used_doc, np.arange(docs), "right")  # documents' last entries: slices end there
    i = 0
    while i < len(used):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right"))
        j = int(doc_ends[used_doc[min(max(j, i + 1), len(used)) - 1]])
        held = _sorted_distinct(np.repeat(used_doc[i:j], size[i:j]) * max(len(pairs), 1) + local[_ranges(word_first[used_word[i:j]], size[i:j])])
        np.add.at(holders, held % max(len(pairs), 1), 1)
        i = j
    refs = tk.pack(*(x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (np.bincount(used_doc, minlength=docs), used_word, times, np.diff(word_first), local, entries.link_times)))
    structs = pa.StructArray.from_arrays([ids, *(pa.array(sums[:, k]) for k in range(len(FIGURES))), pa.array(digests, pa.string())], names=["doc_id", *FIGURES, "groups_sha256"])
    lists = [tk.lists(np.array([docs]), structs), pa.array([refs], pa.binary()), tk.lists(np.array([len(pairs)]), pa.array(pairs.view(np.int64))), tk.lists(np.array([len(pairs)]), pa.array(holders, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], names=["block", "docs", "refs", "pairs", "holders"])


def _blocks(a_path: str, b_path: str, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _tokenizers(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            return _block(number, ids, np.concatenate([h[1] for h in held]), np.concatenate(([0], np.cumsum(sizes))), sides)

        for rows, buf, offsets in tk.pieces(batches, "text"):
            if held and sum(len(h[1]) for h in held) + len(buf) > block_bytes:
                yield block()
                number, held = number + 1, []
            held.append((rows.column("doc_id"), buf, offsets))
        if held:
            yield block()

    return tk.tidy(run)


_OUT = "doc_id long, " + ", ".join(f"{f} long" for f in FIGURES) + ", groups_sha256 string, n_best long, count_sum long"


def _summed(key: tuple, blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents, with the counts of its pairs."""
    schema = pa.schema([("doc_id", pa.int64()), *((f, pa.int64()) for f in FIGURES), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    if not blocks.num_rows:
        return schema.empty_table()
    row = blocks.combine_chunks()
    docs = row.column("docs").chunk(0).flatten()
    n_used, word, times, n_links, local, links = tk.unpack(row.column("refs")[0].as_py())
    pairs = np.asarray(row.column("pairs").chunk(0).flatten())
    where = np.searchsorted(pairs, counts.column("pair").to_numpy())
    values = np.zeros((2, len(pairs)), np.int64)
    values[0, where], values[1, where] = counts.column("best").to_numpy(), counts.column("total").to_numpy()
    word_of = np.repeat(np.arange(len(n_links)), n_links)
    doc_of = np.repeat(np.arange(len(n_used)), n_used)
    sums = []
    for v in values:
        by_word = np.zeros(len(n_links), np.int64)
        np.add.at(by_word, word_of, v[local.astype(np.int64)] * links.astype(np.int64))
        by_doc = np.zeros(len(n_used), np.int64)
        np.add.at(by_doc, doc_of, by_word[word.astype(np.int64)] * times.astype(np.int64))
        sums.append(pa.array(by_doc))
    return pa.Table.from_arrays([*(docs.field(i) for i in range(docs.type.num_fields)), *sums], schema=schema)


def token_links(docs: DataFrame, a_path: str = BYTE_MODEL, b_path: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best
    and count_sum of every document: its tokens by both tokenizers, the groups
    they form, links between tokens of a group, elementary intervals, a digest
    of the groups (``a1,a2|b1;a3|b2,b3``), links whose pair of ids is linked in
    as many documents as any pair of its A id, and the sum of these counts over
    all links.

    Null and empty texts, and texts whose tokens of one side don't have the
    bytes of a blank and the text (say, because U+2581 stands in it), have no
    tokens: zeros and the empty string. Equal rows and equal doc_ids stay rows
    of their own, each counting as a document; a null doc_id stays null. Other
    columns of docs are not read, whatever their names; an empty table gives an
    empty one. A text longer than a block is a block by itself. A group's
    distinct ids are expanded into pairs in slices; what a task holds is the
    distinct pairs of a block.
    """
    spark = docs.sparkSession
    store = graphs.Tables(spark)
    blocks = store.written(tk.narrow(docs, id_col, text_col).mapInArrow(_blocks(a_path, b_path, block_bytes), _BLOCK))
    rows = blocks.select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    totals = rows.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.shiftright("pair", 32))
    totals = store.written(totals)
    most = totals.groupBy("a").agg(F.max("total").alias("most"))  # one row for each entry of A's vocabulary at most
    scored = totals.join(F.broadcast(most), "a").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    back = rows.select(F.col("block").alias("to"), "pair").join(scored, "pair").select("to", "pair", "total", "best")
    return blocks.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_summed, _OUT)
