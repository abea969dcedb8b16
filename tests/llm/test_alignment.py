"""Token links against plain loops over every token pair."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbrow.llm import alignment
from plumbrow.llm.queries import TOKENIZERS
from plumbrow.sources.views import table

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
ODD = [
    None, "", " ", "a", "  two  spaces ", "Hello wörld\n\n\tTabs\r\n", "<|endoftext|> </s> <s> <0x41> <unk>", "literal ▁ mark", "日本語のテキスト 한국어",
    "emoji 👩‍👩‍👧 ½ ② Ǆ", "á è", "\x00\x01 nul", "x" * 5000, " " * 3000, "=-" * 2000, "1234567890" * 300, "don't we'll I'M", "ß non breaking​",
    "Hello wörld\n\n\tTabs\r\n", "a", "𝒜𝓁𝓅𝒽𝒶 \U0010fffd", "﻿bom",
]


@pytest.fixture(scope="module")
def files():
    return alignment.Files.read(A, B)


def brute(texts):
    """Rows of the query for a list of texts."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    spelt = alignment.byte_characters()
    rows, holders = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(spelt[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or any(b"".join(x) != b" " + text.encode() for x in (bytes_a, bytes_b)):
            rows.append(([], [], [], []))
            continue
        groups, i, j, left, right = [[[], []]], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if left <= right:
                left += len(bytes_a[i])
                groups[-1][0].append(ids_a[i])
                i += 1
            else:
                right += len(bytes_b[j])
                groups[-1][1].append(ids_b[j])
                j += 1
            if left == right and (i < len(ids_a) or j < len(ids_b)):
                groups.append([[], []])
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        holders.update(set(links))
        rows.append((ids_a, ids_b, groups, links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for ids_a, ids_b, groups, links in rows:
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            len(ids_a), len(ids_b), len(groups), len(links), sum(holders[x] == most[x[0]] for x in links), sum(holders[x] for x in links),
            hashlib.sha256(written.encode()).hexdigest() if ids_a else "",
        ))
    return out


def run(spark, files, texts, **settings):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string")
    got = alignment.link_tokens(docs.repartition(3), files, ["doc_id"], **settings).orderBy("doc_id").collect()
    return [tuple(r[c] for c in (*alignment.COUNTS, "n_best", "count_sum", "groups_sha256")) for r in got]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 1])
def test_against_plain_loops(spark, files, sf, head):
    """With a small head, most pairs are joined instead of broadcast."""
    rows = table(spark, sf, "documents").orderBy("doc_id").limit(60).collect()
    texts = ODD + [r["text"] for r in rows]
    assert run(spark, files, texts, head=head) == brute(texts)


def test_wide_groups_are_pooled(spark, files, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert run(spark, files, ODD) == brute(ODD)


def test_both_encoders_give_the_same_ids(spark, files, sf):
    fast = alignment.Byte(files.a)
    full = alignment.Byte(files.a)
    full.fast = None
    assert fast.fast is not None
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").collect()] + [t for t in ODD if t]
    texts += ["".join(map(chr, range(n, n + 16))) for n in range(0, 0x250, 16)]
    texts += [f"{chr(n)} {chr(n)}a 1{chr(n)}'s" for n in range(0x250)]
    assert [list(x) for x in fast.encode(texts)] == [list(x) for x in full.encode(texts)]


def test_groups_are_kept_on_request_and_give_back_the_text(spark, files):
    docs = spark.createDataFrame([(1, "Hello wörld, don't")], "doc_id long, text string")
    row = alignment.align(docs, files, ["doc_id"], keep_groups=True).first()
    a, b = alignment.Byte(files.a), alignment.Piece(files.b)
    groups = [[[int(i) for i in side.split(",")] for side in g.split("|")] for g in row["groups"].split(";")]
    for x, y in groups:
        assert b"".join(a.bytes[i] for i in x) == b"".join(b.bytes[i] for i in y)
    assert b"".join(a.bytes[i] for x, _ in groups for i in x) == " Hello wörld, don't".encode()


def test_empty_table(spark, files):
    assert run(spark, files, []) == []


def test_ids_that_are_no_ranks_take_the_full_library(files):
    import json

    table = json.loads(files.a)
    table["model"]["merges"] = table["model"]["merges"][::-1]
    assert alignment.Byte(json.dumps(table).encode()).fast is None
