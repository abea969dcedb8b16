"""Links between the tokens of two tokenizers, where both end at the same byte.

Every text is encoded by both. The running sums of token lengths are the ends of the tokens; a
dictionary from end to index is made for either side, the intersection of their keys in order
holds the ends that both share, and these slice both id lists into groups. Inside a group every token of one side is
linked with every token of the other.

Every document passes on its distinct linked id pairs with the number of their links. A pair's count is the number of
documents that hold it. Pairs that hold at least a share of ``1 / head`` of all entries can be no more than
``head`` and are broadcast; the documents' other pairs are joined with their counts, where no pair has many rows. Sums go back to the documents by a row number.

Side A is a byte-level BPE file in JSON, which gets a space and the text; side B a sentence-piece model, which adds the
space itself. Strings of special tokens are plain text. A text that is null or empty, or that either side does not give back byte
for byte, has no tokens and zeros. Repeated rows are aligned each and count as documents each; an empty table
gives no rows; other columns are not read. Both files travel to the workers as bytes.

Byte-level ids are ranks: a pair of tokens that merges earlier has the smaller id. So texts of Latin letters are encoded by
tiktoken from the ranks of the same file, which gives the same ids in a quarter of the time; texts with characters ``BEYOND`` those, where
the libraries' Unicode tables could differ, and files whose ids are no ranks take the library that the file is made for.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm import text as T
from plumbrow.session import settle

HEAD = 1 << 21
BUFFER = 4_000_000  # pairs that a task pools before it passes them on
END = (1 << 63) - 1  # above every pair
WIDE = 1 << 12  # links of one group that are expanded one by one
BEYOND = re.compile("[\u0250-\U0010ffff]")  # characters outside the blocks of Latin letters
#: Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = ", ".join(f"{c} long" for c in COUNTS) + ", groups string, groups_sha256 string, pairs binary, times binary"


def byte_characters() -> dict[str, int]:
    """Byte-level BPE spells a byte as itself if it is printable, the others as the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass(frozen=True)
class Files:
    """Contents of the two vocabulary files."""

    a: bytes
    b: bytes

    @classmethod
    def read(cls, a: str, b: str) -> Files:
        contents = []
        for path in (a, b):
            with open(path, "rb") as file:
                contents.append(file.read())
        return cls(*contents)


class Byte:
    """Byte-level BPE: ids of space and text."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(content.decode())
        self.full.encode_special_tokens = True
        table, spelt = json.loads(content), byte_characters()
        special = {t["content"] for t in table["added_tokens"]}
        vocabulary = {k: i for k, i in table["model"]["vocab"].items() if k not in special}
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in table["added_tokens"])]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(spelt[c] for c in token)
        for t in table["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        joined = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in table["model"]["merges"]]
        kind = table["pre_tokenizer"] or {}
        ranked = joined == sorted(joined) and max(vocabulary[c] for c in spelt) < joined[0] and not table["normalizer"]
        self.fast = None
        if ranked and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space"):
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocabulary.values()}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [
            None if self.fast is None or BEYOND.search(t) else self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts
        ]
        late = [n for n, ids in enumerate(out) if ids is None]
        if late:
            for n, e in zip(late, self.full.encode_batch([" " + texts[n] for n in late], add_special_tokens=False)):
                out[n] = np.array(e.ids, np.uint32)
        return out


class Piece:
    """Sentence pieces: ids of the text, before which the model puts a space."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


class Side:
    """A vocabulary's bytes, and its ids in decimal with each separator."""

    def __init__(self, model: Byte | Piece, ends_group: str):
        self.model, self.size = model, len(model.bytes)
        self.bytes = pa.array(model.bytes, pa.large_binary())
        self.lengths = np.array([len(b) for b in model.bytes], np.int64)
        self.spelt = [f"{i}{separator}" for separator in (",", ends_group) for i in range(self.size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, or none where the tokens do not give back the text."""
        out = self.model.encode(texts)
        joined = self.bytes.take(pa.array(np.concatenate([np.empty(0, np.uint32), *out])))
        data, at = bytes(joined.buffers()[2] or b""), 0
        for n, text in enumerate(texts):
            length = int(self.lengths[out[n]].sum())
            if data[at : at + length] != b" " + text.encode():
                out[n] = out[n][:0]
            at += length
        return out


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """For every end that both sides share, in order: the number of tokens up to it on either side."""
    index_a, index_b = (dict(zip(ends, range(1, len(ends) + 1))) for ends in (ends_a, ends_b))
    shared = list(filter(index_a.__contains__, index_b))  # ends only rise, so a dictionary holds them in order
    return list(map(index_a.__getitem__, shared)), list(map(index_b.__getitem__, shared))


def spelled(spelt: pa.Array, size_a: int, size_b: int, ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> bytes:
    """Groups as ``a1,a2|b1;a3|b2,b3``. ``spelt`` holds the ids of A before ``,`` and before ``|``, then those of B before ``,`` and ``;``."""
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[upto_a - 1] = 1
    last_b[upto_b - 1] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.concatenate([[0], upto_b])[group_a]] = ids_a + last_a * size_a
    order[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + last_b * size_b + 2 * size_a
    return bytes(spelt.take(pa.array(order)).buffers()[2])[:-1]


def linked(ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs as ``a * size + b``, and how many links each has."""
    from_a, from_b = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
    n_a, n_b = upto_a - from_a, upto_b - from_b
    links = n_a * n_b
    wide = np.flatnonzero(links > WIDE)
    links[wide] = 0  # pooled by id below
    group = np.repeat(np.arange(len(links)), links)
    place = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    pairs = [ids_a[from_a[group] + place // n_b[group]] * size + ids_b[from_b[group] + place % n_b[group]]]
    times = [np.ones(len(group), np.int64)]
    for g in wide:
        a, times_a = np.unique(ids_a[from_a[g] : upto_a[g]], return_counts=True)
        b, times_b = np.unique(ids_b[from_b[g] : upto_b[g]], return_counts=True)
        pairs.append((a[:, None] * size + b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
    return T.pooled(np.concatenate(pairs), np.concatenate(times))


def _align(a: Side, b: Side, spelt: pa.Array, texts: list[str], keep_groups: bool) -> Iterator[tuple]:
    """A row of ALIGNED for every text."""
    filled = [t for t in texts if t]
    both = zip(a.encode(filled), b.encode(filled))
    for text in texts:
        ids_a, ids_b = next(both) if text else ((), ())
        if not len(ids_a) or not len(ids_b):
            yield 0, 0, 0, 0, "", "", b"", b""
            continue
        ends = (np.cumsum(side.lengths[ids]).tolist() for side, ids in ((a, ids_a), (b, ids_b)))
        upto_a, upto_b = (np.array(x, np.int64) for x in common_ends(*ends))
        ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        groups = spelled(spelt, a.size, b.size, ids_a, ids_b, upto_a, upto_b)
        pairs, times = linked(ids_a, ids_b, upto_a, upto_b, b.size)
        yield (
            len(ids_a), len(ids_b), len(upto_a), int(times.sum()), groups.decode() if keep_groups else "",
            hashlib.sha256(groups).hexdigest(), T.planes(pairs), T.planes(times.astype(np.uint32)),
        )


def align(docs: DataFrame, files: Files, keep: list[str], text: str = "text", keep_groups: bool = False) -> DataFrame:
    """The ``keep`` columns of every row with n_a, n_b, n_groups, n_links, groups (empty without ``keep_groups``),
    groups_sha256 and the distinct linked pairs, packed as byte planes of 64 bits, with 32 bits for their number of links."""
    sent = docs.sparkSession.sparkContext.broadcast((files.a, files.b))
    rows = docs.select(*keep, F.col(text).alias("_text"))
    names = [c.split(" ")[0] for c in ALIGNED.split(", ")]
    types = [pa.int64()] * len(COUNTS) + [pa.string()] * 2 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Side(Byte(sent.value[0]), "|"), Side(Piece(sent.value[1]), ";")
        spelt = pa.array(a.spelt + b.spelt, pa.large_string())
        for batch in batches:
            for piece in T.pieces(batch, "_text"):
                done = zip(*_align(a, b, spelt, piece.column("_text").to_pylist(), keep_groups))
                columns = [pa.array(values, kind) for values, kind in zip(done, types)]
                yield pa.record_batch([piece.column(c) for c in keep] + columns, [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    return rows.mapInArrow(run, ", ".join(x for x in (schema, ALIGNED) if x))


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """pair, a, b, n (documents that hold the pair) and best (no pair of the same a has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            pairs, n = T.pooled(pairs, np.ones(len(pairs), np.int64))
            return pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for blob in batch.column("pairs").to_pylist():
                held.append(T.from_planes(blob, "i8"))
                waiting += len(held[-1])
                if waiting >= BUFFER:
                    yield flush()
                    held, waiting = [], 0
        if held:
            yield flush()

    counted = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = settle(counted.withColumn("a", F.expr(f"pair div {size}")))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # one row an id of side A
    joined = counted.join(F.broadcast(most), "a")
    return joined.select("pair", "a", (F.col("pair") - F.col("a") * size).alias("b"), "n", (F.col("n") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """The rows of a stored ``aligned`` without their pairs, with n_best (links whose pair is best) and count_sum (of the pairs' counts over all links).

    ``counts`` is stored too.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * head >= total
    known = counts.filter(frequent).select("pair", "n", "best").toArrow()
    known = pa.concat_tables([known, pa.table({"pair": [END], "n": [0], "best": [False]}, known.schema)])  # so that every pair has a place
    order = np.argsort(known["pair"].to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy()[order] for c in ("pair", "n", "best")))
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(rest).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            blobs, links = batch.column("pairs").to_pylist(), batch.column("times").to_pylist()
            own = [T.from_planes(b, "i8") for b in blobs]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in own])]).astype(np.int64)
            own = np.concatenate([np.empty(0, np.int64), *own])
            links = np.concatenate([np.empty(0, np.uint32), *(T.from_planes(t, "u4") for t in links)]).astype(np.int64)
            at = np.searchsorted(pair[:-1], own)
            found = pair[at] == own
            sums = [np.concatenate([[0], np.cumsum(links * x[at] * found)]) for x in (best, n)]
            left = np.concatenate([[0], np.cumsum(~found)])[offsets]
            tails = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~found])) for x in (own, links)]
            yield pa.record_batch(
                [batch.column(c) for c in rest] + [pa.array(s[offsets[1:]] - s[offsets[:-1]]) for s in sums] + tails,
                [*rest, "n_best", "count_sum", "tail", "tail_links"],
            )

    told = aligned.select(*rest, "pairs", "times").mapInArrow(
        run, f"{schema}, n_best long, count_sum long, tail array<bigint>, tail_links array<bigint>"
    )
    told = settle(told.withColumn("_row", F.monotonically_increasing_id()))
    each = told.select("_row", F.explode(F.arrays_zip("tail", "tail_links")).alias("x")).select("_row", F.col("x.tail").alias("pair"), "x.tail_links")
    rare = each.join(counts.filter(~frequent).select("pair", "n", "best"), "pair")
    sums = rare.groupBy(F.col("_row").alias("_of")).agg(
        F.sum(F.when(F.col("best"), F.col("tail_links")).otherwise(0)).alias("more_best"), F.sum(F.col("tail_links") * F.col("n")).alias("more_sum")
    )
    return told.join(sums, F.col("_row") == F.col("_of"), "left").select(
        *rest, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


def link_tokens(docs: DataFrame, files: Files, keep: list[str], text: str = "text", keep_groups: bool = False, head: int = HEAD) -> DataFrame:
    """The ``keep`` columns with the counts of every row's tokens, groups and links, and their sums over the corpus's pair counts."""
    aligned = settle(align(docs, files, keep, text, keep_groups))
    return link_sums(aligned, settle(pair_counts(aligned, len(Piece(files.b).bytes))), head)
