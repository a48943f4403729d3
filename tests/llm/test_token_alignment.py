"""Alignment by segments against whole texts tokenised at once."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from marginalia.llm import registry, token_alignment
from marginalia.llm.store import read

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    codes = shown + [256 + k for k in range(256 - len(shown))]
    return {chr(c): b for c, b in zip(codes, shown + [b for b in range(256) if b not in shown], strict=True)}


def brute(docs):
    tok, model, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    tok.encode_special_tokens = True
    rows, held = [], Counter()
    for i, text in docs:
        links, groups, a, b = [], [], [], []
        if text:
            enc = tok.encode(" " + text, add_special_tokens=False)
            a, b = enc.ids, model.encode(text)
            of_a = [bytes(back[c] for c in t) for t in enc.tokens]
            of_b = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(of_a) != b" " + text.encode() or b"".join(of_b) != b" " + text.encode():
                a, b = [], []
            else:
                spans = []
                for tokens in (of_a, of_b):
                    at, out = 0, []
                    for t in tokens:
                        out.append((at, at + len(t)))
                        at += len(t)
                    spans.append(out)
                j0 = 0
                for x, (s, e) in zip(a, spans[0], strict=True):
                    while spans[1][j0][1] <= s:
                        j0 += 1
                    j = j0
                    while j < len(b) and spans[1][j][0] < e:
                        links.append((x, b[j]))
                        j += 1
                last = [-1, -1]
                for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                    cut = [next(k for k in range(at + 1, len(spans[n])) if spans[n][k][1] == end) for n, at in enumerate(last)]
                    groups.append(",".join(map(str, a[last[0] + 1 : cut[0] + 1])) + "|" + ",".join(map(str, b[last[1] + 1 : cut[1] + 1])))
                    last = cut
        rows.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
        held.update(set(links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = [(i, na, nb, ng, len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, ng, ls, g in rows]
    return sorted(out, key=repr)


def found(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=repr)


def of(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return found(registry.op12_token_alignment(spark, str(tmp_path)))


def test_op12(spark, small):
    docs = [(r.doc_id, r.text) for r in read(spark, small, "documents").collect()]
    assert found(registry.op12_token_alignment(spark, small)) == brute(docs)


def test_odd(spark, odd_documents, tmp_path):
    assert of(spark, tmp_path, odd_documents) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])


def test_random_texts(spark, tmp_path, monkeypatch):
    """Every kind of white space, control, special string and script beside every other; small blocks."""
    rng = random.Random(5)
    bits = [*"ab,.'9é漢ß▁́😀\x00\x01\x7f\xa0\x85　 ᠎​﻿\t\n\r\v\f ", "  ", "   ", " \n", "\n ", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "'s", "'t ", "the ", " of", "token", ");\r\n", "à ", "\xa0 \xa0 "]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.choice([1, 2, 3, 8, 40])))) for k in range(1500)]
    docs += [(None, None), (None, ""), (3, "the the"), (3, "the the"), (-1, "word " * 5000), (-2, "a" * 20_000), (-3, "漢字" * 4000)]
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 2000)
    assert of(spark, tmp_path, spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_only_texts_without_tokens(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "a▁b")]
    assert of(spark, tmp_path, spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_empty(spark, tmp_path):
    assert of(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string")) == []


def test_cuts_follow_the_vocabularies():
    cut = token_alignment.Cutter([b"a b", b" c", "é d".encode(), b"  ", b"\xa9 "])
    assert cut.crossed == {b"a", "é".encode(), b"\xa9"}
    data = "a x b x é x ß x \xa0 x".encode()
    import numpy as np

    at = cut.cuts(np.frombuffer(data, np.uint8)).tolist()
    assert [data[:k].decode()[-1] for k in at] == ["x", "b", "x", "x", "ß", "x"]


def test_groups_are_what_the_digests_are_of(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.groups for r in token_alignment.align_documents(docs, A, B).collect()}
    wanted = {r[0]: r[-1] for r in brute([(1, "the cat"), (2, None)])}
    assert rows[2] == wanted[2] == "" and hashlib.sha256(rows[1].encode()).hexdigest() == wanted[1]
